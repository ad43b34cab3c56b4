"""Exact order statistics and quantiles of groups of any size, without holding a large group in one task.

Values are counted into intervals of the range that still holds the wanted rank (by sign, then by magnitude, then evenly, so that few rounds are needed whatever the values), and the range narrows to the least and greatest value of the interval that holds it, until it is
one value. A round reads the values once; what is shuffled are counts of intervals, combined in the tasks. Groups of at most ``whole`` rows are sorted as a
whole instead (a buffer of that size at most), which takes one pass for all of them; both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.lineage import cut

#: Intervals of a round.
INTERVALS = 4096
#: Up to so many ranges are sent to every task of a round; more are joined by key.
SENT_RANGES = 10_000


def _position(p: Column, n: Column, how: str) -> Column:
    at = p * (n - 1)
    return F.bround(at) if how == "nearest" else at


def _narrowed(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """One round: wanted (g, k, below, lo, hi) with the range of the interval that holds rank k, and how many values lie below it."""
    ranges = cut(wanted.select("g", "lo", "hi").distinct())
    near = F.broadcast(ranges) if ranges.count() <= SENT_RANGES else ranges
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    # a range around zero is split by sign; one over magnitudes evenly in their logarithm; any other evenly
    log = F.when(lo > 0, (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo))).otherwise((F.log(-lo) - F.log(-v)) / (F.log(-lo) - F.log(-hi)))
    wide = F.when(lo > 0, hi / 2 > lo).otherwise(lo / 2 < hi)
    share = F.when((lo <= 0) & (hi >= 0), (F.signum(v) + 1) / 4).when(wide, log).otherwise((v - lo) / (hi - lo))
    place = F.greatest(F.least(F.floor(share * INTERVALS), F.lit(INTERVALS - 1)), F.lit(0))
    counts = values.join(near, "g").where(v.between(lo, hi)).groupBy("g", "lo", "hi", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("place")) - F.col("n")
    counts = counts.withColumn("before", before)
    found = wanted.join(counts, ["g", "lo", "hi"]).where("k - below >= before AND k - below < before + n")
    return cut(found.select("g", "k", (F.col("below") + F.col("before")).alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi")))


def order_statistics(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, k, v): the k-th least (from 0) of the values (g, v) of each g, for wanted (g, k, below, lo, hi): all finite values lie from lo to hi, ``below`` are minus infinity."""
    out, state = None, wanted
    while True:
        done = state.where("lo >= hi").select("g", "k", F.col("lo").alias("v"))
        out = done if out is None else out.union(done)
        rest = state.where("lo < hi")
        if rest.isEmpty():
            return out
        state = _narrowed(values, rest)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], how: str = "linear", whole: int = 1 << 20) -> DataFrame:
    """(by..., n, q): the number of values of each group and their quantiles, an array in the order of the probabilities.

    linear: between the values next to position p (n - 1); nearest: the value at that position, halves to even. Null and NaN are no values; a group without values has no row.
    """
    if how not in ("linear", "nearest"):
        raise ValueError("how must be linear or nearest")
    infinite = float("inf")
    values = cut(rows.select(F.struct(*by).alias("g") if by else F.struct(F.lit(0)).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    finite = F.when(F.abs("v") < infinite, F.col("v"))
    totals = cut(values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count_if(F.col("v") == -infinite).alias("low"), F.count_if(F.col("v") == infinite).alias("high")))
    ps = F.array(*(F.lit(float(p)) for p in probabilities))
    asked = totals.select("*", F.posexplode(ps).alias("i", "p")).withColumn("at", _position(F.col("p"), F.col("n"), how))
    asked = asked.select("*", F.floor("at").cast("long").alias("k0"), F.ceil("at").cast("long").alias("k1"))
    small = totals.where(F.col("n") <= whole).select("g")
    large = asked.where(F.col("n") > whole)
    ranks = large.select("g", "n", "lo", "hi", "low", "high", F.explode(F.array("k0", "k1")).alias("k")).distinct()
    k = F.col("k")
    edge = F.when(k < F.col("low"), F.lit(-infinite)).when(k >= F.col("n") - F.col("high"), F.lit(infinite))
    wanted = cut(ranks.select("g", "k", F.col("low").alias("below"), F.coalesce(edge, "lo").alias("lo"), F.coalesce(edge, "hi").alias("hi")))
    at = order_statistics(values, wanted)
    held = values.join(small, "g").groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("v"))
    held = held.join(asked, "g").select("g", "i", "at", "k0", F.get("v", F.col("k0").cast("int")).alias("v0"), F.get("v", F.col("k1").cast("int")).alias("v1"))
    apart = large.join(at.select("g", F.col("k").alias("k0"), F.col("v").alias("v0")), ["g", "k0"]).join(at.select("g", F.col("k").alias("k1"), F.col("v").alias("v1")), ["g", "k1"])
    both = held.unionByName(apart.select("g", "i", "at", "k0", "v0", "v1"))
    part = F.col("at") - F.col("k0")
    q = F.when((part == 0) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise(F.col("v0") * (1 - part) + F.col("v1") * part)
    each = both.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return totals.select("g", "n").join(each, "g").select(*(F.col(f"g.{c}").alias(c) for c in by), "n", "q")
