"""Exact Jaccard join of word n-gram sets by token-combination prefixes; classes of linked texts.

Two texts link if ``100 * intersection >= percent * union`` of their sets of word n-grams (five words, 80 percent, unless asked otherwise). Steps:

1. *Met tokens.* Each task sends the n-grams' hashes, many to a row, to the part of their hash; a part counts for each text how many of its n-grams
   other rows hold too. Of two linked sets, each has at least ``percent`` of its n-grams from the other, so a text with fewer such n-grams links with nothing and goes no further (a text with copies does, once).
   (A part compares 32 bits of each hash; a chance collision can only keep a text that goes later.) The sizes of the sets go the same way, so texts are read once for both, and an
   n-gram takes the same few bytes whatever the number of parts.
2. *Prefixes.* The kept texts' n-grams are ordered by how many texts hold them, the rarest first, and fall into classes by that count: class 1 (rare), 2 and 3.
   Class k is indexed by combinations of k n-grams of one bin, a bin being a hash of the n-gram. A prefix is extended until it has gained more than the text may lack: an n-gram of class 1
   gains one, one of class k from the k-th of its bin on. Two linked texts then share a combination: the text whose prefix ends first lacks fewer of the other's n-grams than it gained.
   The number of bins follows the size of the smaller text, so a text whose partners may have another number posts under both.
3. *Stars.* A combination's texts are first held against one of them, that with the fewest n-grams of its own. Those that link with it need no test with each other: a group of n near copies takes n tests.
4. *Rest.* Texts of a combination that are in different classes so far are paired if sizes, the n-grams they share with anything, and what both share with
   the star's middle leave room for a link; all these pairs are verified on the whole sets. Components follow.

Defined cases: a text of fewer words than n is one n-gram; a null text, or one without words, has an empty set and links with nothing, not with its copies; rows are
never dropped, repeated rows give repeated results and are linked as copies; a null id gets the least id of its class, or null; only the named columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import body, components, cut, map_arrow, slices, space_words, store

#: Up to this many texts an n-gram is of class 1, then of class 2, and beyond the second of class 3.
CLASSES = (32, 1024)
#: Texts to a slice whose n-grams are sent together (their places fit in two bytes), and parts to a task, so that tasks get like shares.
SLICE, SHARE = 512, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; as many words as are met often are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(raw: bytes, words: int, known: _Words) -> np.ndarray:
    """Ascending hashes of the different n-grams of a text."""
    w = space_words(raw.lower())
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    size = min(words, len(w))
    total = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = total * _STEP + h[i : i + len(total)]
    return np.unique(_mix(total))


def _key() -> Column:
    return F.unhex(F.md5(body())).alias("key")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _home(base: np.ndarray, parts: int) -> np.ndarray:
    """The parts that sum up slices of texts, by their first numbers."""
    return (_mix(base.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def sent(texts: DataFrame, words: int, parts: int) -> DataFrame:
    """Of (id, key, text): (part, base, owner, low), a row for each slice of 512 texts and part, with the place in the slice and four bytes of the hash of each n-gram.

    Texts are numbered: a slice's first number is base. So an n-gram takes six bytes, however many parts there are. A row more
    for each slice (ids, keys, n) holds its ids, keys and sets' sizes, and goes to the part that sums the slice up.
    """
    from pyspark import TaskContext

    kind = np.uint16 if parts <= 1 << 16 else np.int64  # numpy sorts 16 bits by counting

    def pieces(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = _Words(), TaskContext.get().partitionId() << 36
        for batch in slices(batches, SLICE):
            each = [grams(raw or b"", words, known) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(x) for x in each], dtype="<u4")
            all_ = np.concatenate(each)
            part = ((all_ >> np.uint64(40)) % np.uint64(parts)).astype(kind)
            order = np.argsort(part, kind="stable")
            count = np.bincount(part, minlength=parts)
            some = np.flatnonzero(count)
            at = np.r_[0, np.cumsum(count[some])]
            owner = np.repeat(np.arange(len(each), dtype="<u2"), sizes)[order]
            none = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[some, _home(np.array([base]), parts)].astype(np.int32)),
                    pa.array(np.full(none + 1, base)),
                    pa.concat_arrays([pieces(owner, at), pa.nulls(1, pa.binary())]),
                    pa.concat_arrays([pieces(all_[order].astype("<u4"), at), pa.nulls(1, pa.binary())]),
                    pa.concat_arrays([pa.nulls(none, pa.list_(pa.int64())), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64()))]),
                    pa.array([None] * none + [b"".join(batch.column("key").to_pylist())], pa.binary()),
                    pa.array([None] * none + [sizes.tobytes()], pa.binary()),
                ],
                names=["part", "base", "owner", "low", "ids", "keys", "n"],
            )
            base += SLICE

    return map_arrow(texts, run, "part int, base long, owner binary, low binary, ids array<long>, keys binary, n binary")


def met(dealt: DataFrame, parts: int) -> DataFrame:
    """(id, key, n, met) of every text: the size of its set, and how many of its n-grams are in another row as well (of copies: all)."""
    kinds = {"part": pa.int32(), "base": pa.int64(), "owner": pa.binary(), "met": pa.binary(), "ids": pa.list_(pa.int64()), "keys": pa.binary(), "n": pa.binary()}

    def batch_of(*rows: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, low, heads = [], [], []
        for batch in batches:
            for p, base, owner, x, ids, keys, n in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "owner", "low", "ids", "keys", "n"))):
                if keys is not None:
                    yield batch_of((p, base, None, None, ids, keys, n))
                else:
                    places.append(owner)
                    low.append(x)
                    heads.append((p, base, len(x) // 4))
        if not heads:
            return
        part, base, each = (np.array(c, dtype=np.int64) for c in zip(*heads))
        owner = np.frombuffer(b"".join(places), dtype="<u2") + np.repeat(base, each)
        token = np.frombuffer(b"".join(low), dtype="<u4").astype(np.uint64) | np.repeat(part.astype(np.uint64) << np.uint64(32), each)
        del places, low, heads
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        held = np.repeat(np.diff(np.r_[first, len(token)]) > 1, np.diff(np.r_[first, len(token)]))  # a text has an n-gram once
        texts, n = np.unique(owner[held], return_counts=True)
        to = _home(texts // SLICE * SLICE, parts)
        order = np.argsort(to, kind="stable")
        texts, n, to = texts[order], n[order].astype("<u4"), to[order]
        at = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)] if len(to) else [0]
        for a, b in zip(at[:-1], at[1:]):
            yield batch_of((int(to[a]), None, texts[a:b].tobytes(), n[a:b].tobytes(), None, None, None))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts, held = [], [], []
        for batch in batches:
            for base, owner, n_met, ids, keys, n in zip(*(batch.column(c).to_pylist() for c in ("base", "owner", "met", "ids", "keys", "n"))):
                if keys is not None:
                    held.append((base, ids, keys, n))
                else:
                    texts.append(owner)
                    counts.append(n_met)
        text, place = np.unique(np.frombuffer(b"".join(texts), dtype="<i8"), return_inverse=True)
        total = np.bincount(place, weights=np.frombuffer(b"".join(counts), dtype="<u4"), minlength=len(text)).astype(np.int64)
        text, total = np.append(text, np.iinfo(np.int64).max), np.append(total, 0)
        for base, ids, keys, n in held:
            own = base + np.arange(len(ids))
            at = np.searchsorted(text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([keys[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()), pa.array(np.frombuffer(n, dtype="<u4").astype(np.int64)), pa.array(np.where(text[at] == own, total[at], 0))],
                names=["id", "key", "n", "met"],
            )

    some = map_arrow(dealt.repartition(max(1, parts // SHARE), "part"), count, "part int, base long, owner binary, met binary, ids array<long>, keys binary, n binary")
    return map_arrow(some.repartition(max(1, parts // SHARE), "part"), add, "id long, key binary, n long, met long")


def _need(n: int, percent: int) -> int:
    """The least intersection of a set of n with any partner."""
    return (n * percent + 99) // 100


def _bins(n: int, percent: int) -> int:
    """Bins of class 2 where the smaller text has n n-grams: a power of two that leaves each such text enough to gain; 0: all classes by single n-grams."""
    if n < 5:
        return 0
    bins = 1 << ((n // 5).bit_length() - 1)
    return bins if _need(5 * bins, percent) > bins + 2 * max(1, bins // 4) else 0


def combinations(n: int, tokens: list[tuple[int, int]], percent: int) -> dict[int, bool]:
    """Combinations of a text's prefix by hash: whether they lie in the short prefix, which is enough against partners that are no smaller.

    tokens: (count, hash) of the n-grams that other texts hold too, ascending; the other of the n are the text's own, and come first.
    """
    out: dict[int, bool] = {}
    goal = n - _need(n, percent) + 1
    short = n + 1 + (-2 * percent * n) // (100 + percent)
    mask, sizes = (1 << 64) - 1, {_bins(k, percent) for k in (_need(n, percent), n)}
    for bins in sizes:
        gain, held = n - len(tokens), {}
        for count, x in tokens:
            if gain >= goal:
                break
            k = 1 + (count > CLASSES[0]) + (count > CLASSES[1]) if bins else 1
            if k == 1:
                out[x] = out.get(x, False) or gain < short
                gain += 1
                continue
            mine = held.setdefault((k, (x >> 20) % (bins if k == 2 else max(1, bins // 4))), [])
            for others in itertools.combinations(mine, k - 1):
                h = bins * 8 + k
                for t in (*others, x):
                    h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 + t) & mask
                h ^= h >> 32
                out[h] = out.get(h, False) or gain < short
            gain += len(mine) >= k - 1
            mine.append(x)
    return out


def posted(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n, met, short): the combinations of sets (node, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for node, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens"))):
                own = sorted((t["df"], t["x"] & ((1 << 64) - 1)) for t in tokens)
                rows += [(h - (1 << 64) if h >> 63 else h, node, n, len(own), s) for h, s in combinations(n, own, percent).items()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["sig", "node", "n", "met", "short"])

    return map_arrow(sets, run, "sig long, node long, n long, met long, short boolean")


def links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Of sets (node, n, all), pairs (a, b) that link, enough to join all that are linked, and the components (node, root) if they are known already."""
    tokens = sets.select("node", "n", F.explode("all").alias("x"))
    shared = tokens.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = tokens.join(shared, "x").groupBy("node", "n").agg(F.collect_list(F.struct("df", "x")).alias("tokens"))
    post = cut(posted(held.where(100 * F.size("tokens") >= percent * F.col("n")), percent))
    lists = post.groupBy("sig").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct(F.expr("n - met").alias("own"), F.col("node").alias("r"))).alias("star")).where("held > 1").select("sig", "star.r")
    post = post.join(lists, "sig")

    def common(pairs: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("all").alias(f"_{s}")), s)
        return pairs.select("a", "b", "na", "nb", F.size(F.array_intersect("_a", "_b")).cast("long").alias("both"))

    linked = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    stars = cut(common(post.where("node <> r").select(F.col("r").alias("a"), F.col("node").alias("b")).distinct()))
    near = components(stars.where(linked), "a", "b")
    seen = post.join(stars.select(F.col("a").alias("r"), F.col("b").alias("node"), "both"), ["r", "node"], "left").join(near, "node", "left")
    seen = seen.select("sig", "node", "n", "short", F.coalesce("root", "node").alias("root"), F.coalesce("both", "n").alias("i"), F.when(F.col("both").isNull(), 0).otherwise(F.col("met") - F.col("both")).alias("e"))
    open_ = seen.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sig")
    seen = cut(seen.join(open_, "sig", "left_semi"))
    a, b = (seen.select("sig", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "short", "root", "i", "e"))) for s in "ab")
    room = f"{100 + percent} * (least(i_a, i_b) + least(e_a, e_b)) >= {percent} * (n_a + n_b)"
    rest = a.where("short_a").join(b, "sig").where(f"root_a <> root_b AND (n_a < n_b OR n_a = n_b AND node_a < node_b) AND {room}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = cut(common(rest).where(linked))
    every = stars.where(linked).select("a", "b").union(more.select("a", "b"))
    return every, near if more.isEmpty() else None


def classes(texts: DataFrame, percent: int = 80, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, text): rows (id, key, n), and the classes (key, root) of linked texts that are not equal, root any text's key of the class.

    key: the MD5 digest of the text as 16 bytes; n: the size of its set.
    """
    spark = texts.sparkSession
    parts = SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.withColumn("key", _key())
    counted = cut(met(sent(keyed, words, parts), parts))
    rows = counted.select("id", "key", "n")
    kept = counted.where(100 * F.col("met") >= percent * F.col("n")).where("n > 0").select("key")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, 64):
            each = [grams(raw or b"", words, known).view(np.int64) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            ends = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in each], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))], names=["key", "n", "all"])

    once = keyed.select("key", "text").join(kept, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = store(map_arrow(once, whole, "key binary, n long, all array<long>").withColumn("node", F.monotonically_increasing_id()))
    pairs, near = links(sets, percent)
    near = near if near is not None else components(pairs, "a", "b")
    names = sets.select("node", "key")
    return rows, near.join(names, "node").select("key", "root")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set, and the least id reachable by links."""
    rows, linked = classes(_read(docs, id_col, text_col), percent, words)
    texts = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    joined = texts.join(linked, "key", "left").where("copies > 1 OR root IS NOT NULL")
    least = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    found = joined.join(least, "root", "left").select("key", F.coalesce("least", "id").alias("component"))
    out = rows.join(found, "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` under five-word Jaccard similarity of 0.8 or more."""
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
