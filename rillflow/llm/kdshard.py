"""K-d tree partitioning of documents into shards of nearly equal bytes.

Method: a node that is to hold k shards is split along its widest metadata dimension (ranges relative to those
of all rows) at the weighted median, or the (k // 2) / k quantile for odd k, until each leaf is one shard. Weighted medians
are distributed: one aggregation for all nodes of a level sums the bytes in up to ``bins`` intervals of each node and the driver picks the
interval with the median; the search goes on inside it until it is one value, and then among a hash of the id, so
equal values split as finely as others. Only interval sums (at most nodes times bins) reach the driver, and the rows never move.

The law is ``bytes``. Slots within a shard come from counts by partition, not from a sort of a shard.
Equal texts are neighbours in every dimension (they share the least metadata among them, and ties go by the text first), so a group of copies
is cut only where a split has to pass through it: at most one group for each of the splits, however large the groups are.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, offsets, ranked


@dataclass
class Node:
    """shards it is to hold, the first of them, and once split: dimension, value, tie, children."""

    shards: int
    first: int
    dim: str = ""
    value: float = 0.0
    tie: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else [*_leaves(node.left), *_leaves(node.right)]


@dataclass
class _Search:
    """Where a node's weighted quantile still can be: rows of dim within [lo, hi], or of one value and tie within [lo, hi]."""

    target: float
    lo: float
    hi: float
    below: float = 0.0
    value: float | None = None
    done: bool = False


def _split_level(
    at: DataFrame, open_nodes: list[Node], dims: list[str], scale: dict[str, float], bins: int, precision: float
) -> None:
    """Find where each open node (``_node`` is its place in the list) is split, and give it children."""
    ranges = {
        r["_node"]: r
        for r in at.groupBy("_node").agg(
            F.sum("_size").alias("w"), F.min("_tie").alias("tie_lo"), F.max("_tie").alias("tie_hi"),
            *(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)),
        ).collect()
    }
    search: dict[int, _Search] = {}
    for i, node in enumerate(open_nodes):
        node.dim = dims[0]
        if (r := ranges.get(i)) is not None:  # else it has no rows, and any split will do
            node.dim = max(dims, key=lambda d: ((r[f"{d}_max"] - r[f"{d}_min"]) / scale[d], d))
            search[i] = _Search(r["w"] * (node.shards // 2) / node.shards, r[f"{node.dim}_min"], r[f"{node.dim}_max"])
    while todo := {i: s for i, s in search.items() if not s.done}:
        # one job for all nodes: sums of bytes by interval of what is still searched (a row for each open node at most)
        table = at.sparkSession.createDataFrame(
            [(i, dims.index(open_nodes[i].dim), s.value, s.lo, s.hi, (s.hi - s.lo) / bins or 1.0) for i, s in todo.items()],
            "n int, dim int, value double, lo double, hi double, step double",
        )
        dim = F.get(F.array(*dims), F.col("dim"))
        x = F.when(F.col("value").isNull(), dim).otherwise(F.col("_tie"))
        sums = (
            at.join(F.broadcast(table), F.col("_node") == F.col("n"))
            .where(F.col("value").isNull() | (dim == F.col("value")))
            .select("_node", "_size", "lo", "hi", "step", x.alias("x"))
            .where("x >= lo AND x <= hi")
            .groupBy("_node", F.floor((F.col("x") - F.col("lo")) / F.col("step")).alias("bin"))
            .agg(F.sum("_size").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for i, s in todo.items():
            own = sorted((r for r in sums if r["_node"] == i), key=lambda r: r.bin)
            for r in own:
                if s.below + r.w >= s.target or r is own[-1]:
                    break
                s.below += r.w
            shrunk, large = (r.lo, r.hi) != (s.lo, s.hi), r.w > precision * ranges[i]["w"]
            s.lo, s.hi = r.lo, r.hi
            if r.lo < r.hi and large and shrunk:
                continue
            if s.value is None and r.lo == r.hi and r.n > 1 and large:
                s.value, s.lo, s.hi = r.lo, ranges[i]["tie_lo"], ranges[i]["tie_hi"]
                continue
            # the interval goes to the side that leaves the halves nearer to their targets
            to_left = s.target - s.below > s.below + r.w - s.target
            node, s.done = open_nodes[i], True
            if s.value is None:
                node.value, node.tie = (r.hi, 2.0) if to_left else (r.lo, 0.0)
            else:
                node.value, node.tie = s.value, nextafter(r.hi, 2.0) if to_left else r.lo
    for node in open_nodes:
        half = node.shards // 2
        node.left, node.right = Node(half, node.first), Node(node.shards - half, node.first + half)


def kd_tree(
    rows: DataFrame, dims: list[str], shards: int, bins: int = 1024, precision: float = 2e-5
) -> tuple[Node, DataFrame]:
    """The tree over rows with numeric dims, ``_size`` (weight) and ``_tie`` (from 0 to 1, different by row), and the rows
    with their shard. Each level routes the rows one step on, and writes them (numbers only, no texts).

    ``precision``: the share of a node's bytes below which an interval is not searched any further.
    """
    root = Node(shards, 0)
    span = rows.agg(*(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max))).first()
    scale = {d: (span[f"{d}_max"] or 0) - (span[f"{d}_min"] or 0) or 1.0 for d in dims}
    at = rows.withColumn("_first", F.lit(0))
    while open_nodes := [n for n in _leaves(root) if n.shards > 1]:
        # leaves are known by their first shard
        number = F.create_map(*(F.lit(x) for i, n in enumerate(open_nodes) for x in (n.first, i)))
        todo = at.withColumn("_node", F.try_element_at(number, F.col("_first")))
        _split_level(todo.where("_node IS NOT NULL"), open_nodes, dims, scale, bins, precision)
        table = at.sparkSession.createDataFrame(
            [(n.first, dims.index(n.dim), float(n.value), float(n.tie), n.right.first) for n in open_nodes],
            "n int, dim int, value double, tie double, right int",
        )
        d = F.get(F.array(*dims), F.col("dim"))
        goes_right = (d > F.col("value")) | ((d == F.col("value")) & (F.col("_tie") >= F.col("tie")))
        at = cut(
            at.join(F.broadcast(table), F.col("_first") == F.col("n"), "left").select(
                *rows.columns, F.when(goes_right, F.col("right")).otherwise(F.col("_first")).alias("_first")
            )
        )
    return root, at


def shards(
    docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; shards from n_shards, or from target_bytes.

    Dimensions: log2 of the size, each category as a number from its hash, and the id. A null text has 16 bytes
    (the row's own) and CRC 0; null categories and ids are values like any other. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def unit(*c) -> Column:
        return F.pmod(F.xxhash64(*c), F.lit(1 << 52)).cast("double") / float(1 << 52)

    size = (F.octet_length(text) + 16).cast("long")
    dims = ["_d_size", *(f"_d{i}" for i in range(len(categories))), "_d_id"]
    own = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), size.alias("_size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"),
            F.log2(size.cast("double")).alias("_d_size"),
            *(unit(F.col(c).cast("string")).alias(f"_d{i}") for i, c in enumerate(categories)),
            F.coalesce(F.col(id_col).cast("double"), F.lit(-1.0)).alias("_d_id"),
        )
    )
    groups = own.groupBy(F.col("_text").alias("_t")).agg(F.count(F.lit(1)).alias("_copies"), *(F.min(d).alias(f"{d}_least") for d in dims)).where("_copies > 1").drop("_copies")
    low = 1 << 20
    tie = (F.pmod("_text", F.lit(1 << 32)) * low + F.pmod(F.xxhash64("doc_id", "_text"), F.lit(low))).cast("double") / float(low << 32)
    rows = cut(
        own.join(groups, F.col("_text") == F.col("_t"), "left").select(
            "doc_id", "_size", "text_crc32", *(F.coalesce(f"{d}_least", d).alias(d) for d in dims), tie.alias("_tie")
        )
    )
    if n_shards is None:
        n_shards = max(1, -(-(rows.agg(F.sum("_size")).first()[0] or 0) // (target_bytes or 1 << 30)))
    _, placed = kd_tree(rows, dims, n_shards)
    placed = placed.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.col("_first").alias("shard"))
    placed = cut(ranked(placed, "shard"))
    before = offsets(placed, "shard").withColumnsRenamed({"shard": "s", "_part": "p"})
    return placed.join(before, (F.col("shard") == F.col("s")) & (F.col("_part") == F.col("p"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_nth") + F.col("_before")).alias("slot")
    )


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return shards(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
