"""Near copies of different texts: one row of each class of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The classes are those of the exact join in ``ngram_join``, which takes a group of n near copies n tests and stores sets of texts that have a partner at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import ngram_join
from rillflow.llm.common import body, carried, cut


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """One row of each class of near copies, with the columns of docs: that of the least doc_id (a null id comes last; of repeated rows any one).

    Texts without words (null, empty or white space) are one class. Texts of any length are compared whole; an empty table gives an empty table; columns of any name may stand beside.
    """
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, linked = ngram_join.classes(named, percent, words)
    of = rows.join(linked, "key", "left")
    of = of.withColumn("class", F.when(F.col("n") == 0, "none").otherwise(F.coalesce(F.concat(F.lit("r"), F.col("root").cast("string")), F.hex("key"))))
    first = of.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")).select("first.id", "first.key", F.lit(True).alias("first"))
    same = (F.col("a.key") == F.col("b.key")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    counts = rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"))
    # Few rows go, so those that go are looked up, not those that stay; of repeated rows one stays.
    gone = cut(counts.alias("a").join(first.alias("b"), same, "left").where("first IS NULL OR copies > 1").select("a.id", "a.key", F.col("first").isNotNull().alias("many")))
    keyed = carried(docs, F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(body(f"`{text_col}`"))).alias("key"))
    stay = keyed.alias("a").join(gone.alias("b"), same, "left_anti").select("_row")
    many = gone.where("many")
    if not many.isEmpty():
        repeated = keyed.alias("a").join(many.alias("b"), same, "left_semi")
        stay = stay.union(repeated.groupBy("key", "id").agg(F.first("_row").alias("_row")).select("_row"))
    return stay.select("_row.*")
