"""Benchmark decontamination: which words of which documents lie in windows of benchmark items.

Method: a prefix-filtered set join. The sets are the windows (ten consecutive item words; a shorter item is
one window) and the tokens are their word shingles. Shingles are ordered by rarity over all documents, counted
in a first pass. For containment 1 a prefix of one token is necessary: a document that holds a window
holds the window's rarest shingle. The second pass looks up only these prefix shingles; a window whose rarest
shingle occurs in no document is out. The shingle's place in the window fixes where the window would have to
begin (positional bound) and whether it fits into the document (length bound). What is left is verified word by
word, and counted over the union of all verified windows.

The index of the items is shipped to the tasks in blocks of at most ``block_bytes`` of item text, so its size
is bounded whatever the size of the benchmark: more items mean more blocks, and the blocks' hits are merged.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import alnum_words, body, carried, field, map_arrow, map_batches, row_type, slices

HITS = "doc_id long, text_key long, n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>"
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
SIGNED_BASE = np.int64(BASE - (1 << 64))
RESULT = "doc_id long, n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>"


class Index:
    """Windows of one block of items, as word numbers, with their shingles."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = 10, shingle: int = 3):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, raw in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in alnum_words(raw)]
            for at in range(max(1, len(w) - window + 1)) if w else ():
                owner = owners.setdefault(tuple(w[at : at + window]), set())
                if item_id is not None:
                    owner.add(item_id)
        self.window, self.shingle = window, shingle
        self.windows = list(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.widths = sorted({min(shingle, len(w)) for w in self.windows})
        self.codes = np.unique(np.array([c for w in self.windows for c in self._codes_of(w)], dtype=np.int64))

    def _codes_of(self, w: tuple[int, ...]) -> list[int]:
        k = min(self.shingle, len(w))
        return [self._code(w[i : i + k]) for i in range(len(w) - k + 1)]

    def _code(self, w: tuple[int, ...]) -> int:
        """Shorter shingles are filled up with zeros; words are numbered from 1. Codes are taken modulo 2^64: what collides is told apart when words are verified."""
        c = 0
        for x in (*w, *repeat(0, self.shingle - len(w))):
            c = (c * BASE + x) & MASK
        return c - (1 << 64) if c >> 63 else c

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def shingles(self, ids: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """Places and codes of the shingles whose words are all among the items' words, by width."""
        for k in self.widths:
            if len(ids) < k:
                continue
            n = len(ids) - k + 1
            known = ids[:n] > 0
            for i in range(1, k):
                known &= ids[i : n + i] > 0
            at = np.flatnonzero(known)
            code = ids[at]
            for i in range(1, self.shingle):
                code = code * SIGNED_BASE + (ids[at + i] if i < k else 0)
            yield at, code

    def found(self, codes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are in a sorted array, and where."""
        if not len(among):
            return np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.int64)
        place = np.minimum(np.searchsorted(among, codes), len(among) - 1)
        return among[place] == codes, place

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        """Keep, for each window, its rarest shingle (ties: the first); drop windows that occur nowhere."""
        entries = []
        for number, w in enumerate(self.windows):
            codes = self._codes_of(w)
            offset = min(range(len(codes)), key=lambda i: (counts.get(codes[i], 0), i))
            if counts.get(codes[offset], 0):
                entries.append((codes[offset], offset, number))
        entries.sort()
        self.prefix, self.first = np.unique(np.array([e[0] for e in entries], dtype=np.int64), return_index=True)
        self.last = np.append(self.first[1:], len(entries)).astype(np.int64)
        self.offset = np.array([e[1] for e in entries], dtype=np.int64)
        self.number = np.array([e[2] for e in entries], dtype=np.int64)
        self.length = np.array([len(self.windows[e[2]]) for e in entries], dtype=np.int64)
        self.word = np.zeros((len(entries), self.window), dtype=np.int64)
        for row, e in enumerate(entries):
            self.word[row, : len(self.windows[e[2]])] = self.windows[e[2]]

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window (its row in the index) of every occurrence."""
        starts, rows = [], []
        for at, code in self.shingles(ids):
            hit, place = self.found(code, self.prefix)
            at, place = at[hit], place[hit]
            if not len(at):
                continue
            many = self.last[place] - self.first[place]
            row = np.repeat(self.first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            start = np.repeat(at, many) - self.offset[row]
            fits = (start >= 0) & (start + self.length[row] <= len(ids))
            start, row = start[fits], row[fits]
            for i in range(self.window):
                inside = self.length[row] > i
                same = ~inside | (ids[np.minimum(start + i, len(ids) - 1)] == self.word[row, i])
                start, row = start[same], row[same]
            starts.append(start)
            rows.append(row)
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(starts), np.concatenate(rows)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [start, end) merged where they touch or overlap, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """The items as lists of (id, text), each with about block_bytes of text."""
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), body(item_text).alias("body"))
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n)) == b)
        yield [(r.item_id, bytes(r.body)) for r in part.collect()]


def _shingle_counts(docs: DataFrame, index: Index) -> dict[int, int]:
    """Occurrences over all documents of each shingle of the index (no more rows than the index has)."""

    def run(batches):
        total = np.zeros(len(index.codes), dtype=np.int64)
        for batch in slices(batches):
            for raw in batch.column("body"):
                for _, code in index.shingles(index.numbers(alnum_words(raw.as_py()))):
                    hit, place = index.found(code, index.codes)
                    np.add.at(total, place[hit], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index.codes[at]), pa.array(total[at])], names=["code", "n"])

    counts = map_arrow(docs.select("body"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code: r.n for r in counts.collect()}


def _arrow(rows: list[tuple], names: list[str], kinds: list, row: pa.Array | None) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[] for _ in names], kinds)]
    return pa.RecordBatch.from_arrays(columns + ([row] if row is not None else []), names=names + (["_row"] if row is not None else []))


SPANS = pa.list_(pa.int32())
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"


def _digests(docs: DataFrame, index: Index, text_col: str, carry: str) -> DataFrame:
    """The documents' counts and the hash of the ids of their items. The ids of equal sets of windows are joined once in a task, and no list leaves it."""

    def run(batches):
        known: dict[bytes, tuple[int, str]] = {}
        for batch in slices(batches):
            out = []
            texts = field(batch, text_col).cast(pa.binary()) if carry else batch.column("body")
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts):
                ids = index.numbers(alnum_words(raw.as_py() or b""))
                start, row = index.occurrences(ids)
                a, b = union(start, start + index.length[row])
                windows = np.unique(index.number[row])
                key = windows.tobytes()
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    items = sorted({i for n in windows for i in index.owners[n]})
                    known[key] = len(items), sha256(",".join(items).encode()).hexdigest()
                out.append((doc_id, len(ids), int((b - a).sum()), *known[key]))
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
            yield _arrow(out, names, [*[pa.int64()] * 4, pa.string()], batch.column("_row") if carry else None)

    rows = docs.drop("body", "text_key") if carry else docs.select("doc_id", "body")
    return map_arrow(rows, run, DIGEST + (f", {carry}" if carry else ""))


def _hits(docs: DataFrame, index: Index, text_col: str, carry: str | None) -> DataFrame:
    """The documents' hits by one block's index; only those with a hit if carry is None. Texts come from the carried rows if there are any."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        texts = field(batch, text_col).cast(pa.binary()).to_pylist() if carry else batch.column("body").to_pylist()
        for doc_id, key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts):
            ids = index.numbers(alnum_words(raw or b""))
            start, row = index.occurrences(ids)
            if len(start) or carry is not None:
                a, b = union(start, start + index.length[row])
                found = sorted({i for n in np.unique(index.number[row]) for i in index.owners[n]})
                out.append((doc_id, key, len(ids), int((b - a).sum()), a.tolist(), b.tolist(), found))
        names = ["doc_id", "text_key", "n_words", "n_hit", "starts", "ends", "items"]
        kinds = [*[pa.int64()] * 4, SPANS, SPANS, pa.list_(pa.string())]
        return _arrow(out, names, kinds, batch.column("_row") if carry else None)

    rows = docs.drop("body") if carry else docs.select("doc_id", "text_key", "body")
    return map_batches(rows, run, HITS + (f", {carry}" if carry else ""))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_bytes: int = 2 << 20,
    carry: bool = False,
    lists: bool = True,
) -> DataFrame:
    """For each document: n_words, n_hit, the hit intervals [start, end) in words, and the items found; without ``lists`` n_items and
    items_sha256 (of the sorted ids, comma-joined) in place of intervals and items, which many documents with common passages would repeat.

    Null texts have no words, on either side. Items with equal ids count once; an item without an id marks
    words but is in no list. Repeated documents have a row each. With ``carry`` the columns of docs come along in the struct _row.
    """
    text = body(text_col)
    own = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("body")]
    rows = carried(docs, *own) if carry else docs.select(*own)
    result, more = None, []
    blocks = _blocks(items, item_id, item_text, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None and not lists:
        index = Index(first, window, shingle)
        index.order_by_rarity(_shingle_counts(rows, index) if len(index.codes) else {})
        return _digests(rows, index, text_col, row_type(docs) if carry else "")
    for block in chain([first], [] if second is None else [second], blocks):
        index = Index(block, window, shingle)
        index.order_by_rarity(_shingle_counts(rows, index) if len(index.codes) else {})
        if result is None:
            result = _hits(rows, index, text_col, row_type(docs) if carry else "")
        else:
            more.append(_hits(rows, index, text_col, None))
    last = ["_row"] if carry else []
    if not more:
        return result.select("doc_id", "n_words", "n_hit", "starts", "ends", "items", *last)  # one block, so lists are asked for
    for other in more[1:]:
        more[0] = more[0].union(other)
    # equal documents have equal hits, so hits are kept once for each (doc_id, text)
    found = more[0].groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.flatten(F.collect_set("items")).alias("more_items"),
        F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("more_spans"),
    )
    on = (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))
    spans = F.concat(F.arrays_zip("starts", "ends"), F.coalesce("more_spans", F.array()))
    result = result.join(found, on, "left").select(
        "doc_id", "n_words", F.transform(spans, lambda s: s["starts"]).alias("starts"), F.transform(spans, lambda s: s["ends"]).alias("ends"),
        F.concat("items", F.coalesce("more_items", F.array())).alias("items"), *last,
    )

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, n, a, b, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "starts", "ends", "items"))):
            x, y = union(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
            out.append((doc_id, n, int((y - x).sum()), x.tolist(), y.tolist(), sorted(set(found))))
        names = ["doc_id", "n_words", "n_hit", "starts", "ends", "items"]
        return _arrow(out, names, [*[pa.int64()] * 3, SPANS, SPANS, pa.list_(pa.string())], batch.column("_row") if carry else None)

    result = map_batches(result, merge, RESULT + (f", {row_type(docs)}" if carry else ""))
    return result if lists else digest(result).drop("contaminated")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the items, and ``contaminated``, from either form of ``contamination``."""
    if "items" in found.columns:
        ids = F.array_join(F.array_sort("items"), ",")
        found = found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(ids, 256)}).drop("starts", "ends", "items")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), lists=False))
