"""Near-duplicate detection on 64-bit SimHash fingerprints.

Method: a byte-position inverted index with count filtering. A fingerprint is eight bytes at eight positions. Posting lists are keyed by four
positions and the bytes there: with single bytes as keys each of 2,048 lists would hold a share of all rows, and their pairs would grow
with its square. Two fingerprints that differ in at most two bits differ in at most two bytes, so they share at least six positional bytes, and
meet in at least 15 of the 70 lists of each. Pairs that meet are tallied over the lists; those with fewer than 15 are out, the others are
verified bit by bit.

Lists of more than ``list_limit`` different fingerprints (a large group of near copies) aren't paired.
They are linked exactly by the points within one bit of each member: two fingerprints differ in at most
two bits if and only if they have such a point in common, and at most 65 fingerprints have one point.
So the work for a member is fixed whatever the size of its group, and no link is lost: a pair that has a long list in common is linked by such
points, and of any other pair the tally is whole.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import PIECE, body, carried, components, cut, field, map_arrow, map_batches, row_type, slices, space_words, store

POSITIONS = list(combinations(range(8), 4))
LEAST = comb(6, 4)


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles (repeats included), signed; no word: zero."""
    w = space_words(raw.lower())  # bytes.lower changes A-Z only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        part = w[at : min(n, at + PIECE) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of up to 255 ones fit in a byte
            ones += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; a null or wordless text has fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body"))
    return map_batches(rows, run, "doc_id long, fp long")


def links(fps: DataFrame, list_limit: int = 64) -> DataFrame:
    """Edges (a, b) among different fingerprints that connect all those within two bits of each other.

    Within posting lists of up to list_limit fingerprints these are all such pairs; in longer lists
    each point near several fingerprints links them to the least of them.
    """
    def byte(i):
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF))

    def key(n, positions):
        of = F.lit(n << 32)
        for place, i in enumerate(positions):
            of = of.bitwiseOR(F.shiftleft(byte(i), 8 * place))
        return of

    postings = fps.select("fp", F.explode(F.array(*(key(n, p) for n, p in enumerate(POSITIONS)))).alias("key"))
    lists = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(postings.join(lists, "key"))
    short = members.where(F.col("n") <= list_limit)
    pairs = (
        short.select("key", F.col("fp").alias("a"))
        .join(short.select("key", F.col("fp").alias("b")), "key")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= LEAST)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .select("a", "b")
    )
    long = members.where(F.col("n") > list_limit).select("fp").distinct()
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(64))]
    points = (
        long.select("fp", F.explode(F.array(*near)).alias("point"))
        .groupBy("point")
        .agg(F.sort_array(F.collect_list("fp")).alias("all"))
        .where(F.size("all") > 1)
    )
    stars = points.select(F.col("all")[0].alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def _classes(nodes: DataFrame, list_limit: int) -> DataFrame:
    """(fp, least): the least ``first`` among the nodes (fp, first) that can be reached from fp."""
    roots = components(links(nodes.select("fp"), list_limit), "a", "b")
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    return grouped.join(least, "root").select("fp", "least")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, list_limit: int = 64
) -> DataFrame:
    """(doc_id, fp, component_id): the class of each row under links of at most two differing bits.

    component_id is the least doc_id that can be reached, the row's own included. Equal fingerprints
    are one node, so copies cost nothing. A null doc_id keeps its row, and takes no part in minima.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = _classes(nodes, list_limit)
    return rows.join(classes, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, list_limit: int = 64
) -> DataFrame:
    """One row of each class, with the columns of docs: that of the least doc_id (a null id comes last; among repeats, one of them).

    Rows are numbered as they are written to the shared folder. Only numbers and fingerprints go through the grouping; the rows are then
    met by number, so a group of copies of any size is spread evenly.
    """
    from pyspark import TaskContext

    def run(batches):
        uid = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            n = batch.num_rows
            fp = [fingerprint(x or b"", words) for x in field(batch, text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("id"), pa.array(fp, pa.int64()), pa.array(np.arange(uid, uid + n))],
                names=["_row", "id", "fp", "uid"],
            )
            uid += n

    texts = carried(docs, F.col(id_col).cast("long").alias("id"))
    rows = store(map_arrow(texts, run, f"{row_type(docs)}, id long, fp long, uid long"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "uid")
    nodes = cut(rows.groupBy("fp").agg(F.min(order).alias("first")))
    kept = _classes(nodes, list_limit).select(F.col("least.uid").alias("uid")).distinct()
    return rows.join(kept, "uid", "left_semi").select("_row.*")


def hex_digits(col: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
