"""Language-model scores from a hierarchical Pitman-Yor model.

Model. Each observed context (a word, or the end before a document) has a restaurant of the words after it; all of them share the root
restaurant of words as parent. The root's base measure is uniform over the V tokens of the training documents and one more for all that are
unseen, the same events as those of the plain base score, so the two compare token by token.

Training. Words are counted, then pairs (context, word); words are known by 64-bit hashes. Seating is sampled by Gibbs sweeps in blocks: the
customers of one dish in one restaurant are seated anew, one by one, given the totals of the sweep before. A pair seen once always has one
table, so only pairs seen more often are kept and sampled; the others follow from the totals of their context and word. Draws are hashes of
pair, sweep and customer, so a task that runs again draws the same, and the seats of a sweep can be drawn again instead of stored. Tables
and probabilities are averaged over the sweeps after the first.

Scale. The most frequent words (at most ``words``, whatever the corpus) have numbers, and every task holds their totals: a sweep over pairs of
such words is one pass without a shuffle. Pairs with another word meet its totals by joins. As those words are rare, no key of a join is hot.
The same holds for scoring: a document's pairs are scored where the text is read as if they had been seen once (in a training document)
or never, with the totals held; what is missing, a rare word's totals or the difference that a pair's own count makes, is met by one join.
The most frequent pairs (at most ``pairs``) are held as well. Results do not depend on these two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import body, crc_mod, discard, map_arrow, slices, store, tidy_shuffles

WORDS = 1 << 19
PAIRS = 1 << 19
BURN = 1
THETA = 1.0
#: Tokens that a task works on at a time, and that one task of a shuffle stands for.
CHUNK = 1 << 20
SHUFFLED = 1 << 21
#: Parts that a task deals its numbers to at once, and parts that the held words' sums are added up in.
FAN = 2048
RANGES = 8


# ---- seating


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 from 64-bit keys (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _few(mean: np.ndarray, most: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Draws of how many of ``most`` unlikely events happen: Poisson by inversion for small means, else normal."""
    u = np.clip(_uniform(key, salt), 1e-12, 1 - 1e-12)
    out = np.zeros(len(mean))
    small = mean < 12
    if small.any():
        p = np.exp(-mean[small])
        total, k, left = p.copy(), np.zeros(small.sum()), u[small]
        for i in range(1, 60):
            more = left > total
            if not more.any():
                break
            k[more] = i
            p = p * mean[small] / i
            total += p
        out[small] = k
    if (~small).any():
        m = mean[~small]
        r = np.sqrt(-2 * np.log(u[~small])) * np.cos(2 * np.pi * _uniform(key[~small], salt + 1))
        out[~small] = np.rint(m + r * np.sqrt(m * np.clip(1 - m / most[~small], 0, 1)))
    return np.clip(out, 0, most)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of each dish when its customers are seated one by one.

    ``new``: (strength + discount * tables of the restaurant) * probability of the dish in the parent, the weight of a new table against
    ``seated - discount * own tables``. The first 32 customers are drawn singly; then each stretch, twice as long as
    the one before, draws how many of its customers open a table.
    """
    t = np.minimum(customers, 1).astype(np.float64)
    n, at = 1, np.flatnonzero(customers > 1)
    while len(at) and n < 32:
        t[at] += _uniform(key[at], salt + n) < new[at] / (new[at] + n - discount * t[at])
        n += 1
        at = at[customers[at] > n]
    while len(at):
        m = np.minimum(customers[at] - n, n).astype(np.float64)
        mean = new[at] * np.log1p(m / (new[at] + n - discount * t[at]))
        t[at] += _few(mean, m, key[at], salt + 64 + 2 * n.bit_length())
        n *= 2
        at = at[customers[at] > n]
    return t


def discount_of(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


# ---- the model


def _uniform_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)  # A-Z count as a-z
#: 64-bit numbers for bytes, and whether a byte parts words.
_VALUE = (_uniform(_BYTE, 1) * 2.0**53).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_SEGMENT, _LONG = 1 << 18, 256
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.append(np.uint64(1), np.full(_SEGMENT + _LONG, 0xD1342543DE82EF95, dtype=np.uint64)))


def _mixed(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _uniform_bits(h + (length.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)


def _word_hashes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and the words of each text.

    A polynomial of the bytes from running sums, so that no word becomes an object; longer words than _LONG bytes are hashed one by one.
    """
    wide = np.int64 if pa.types.is_large_binary(bodies.type) else np.int32
    offsets = np.frombuffer(bodies.buffers()[1], dtype=wide, count=len(bodies) + 1, offset=bodies.offset * np.dtype(wide).itemsize).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bodies), dtype=np.int64)
    data = np.frombuffer(bodies.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    space = _IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # whether something ends and something else begins before a byte
    edge[offsets] = True
    edge[1:-1] |= space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    word = ~space[at[:-1]]
    starts, ends = at[:-1][word], at[1:][word]
    length = ends - starts
    h = np.zeros(len(starts), dtype=np.uint64)
    short = length <= _LONG
    bounds = np.searchsorted(starts, np.arange(0, len(data) + _SEGMENT, _SEGMENT))
    for lo, hi in zip(bounds, bounds[1:]):
        here = np.arange(lo, hi) if short[lo:hi].all() else lo + np.flatnonzero(short[lo:hi])
        if len(here):
            a, b = starts[here], ends[here]
            first = a[0]
            sums = np.zeros(b[-1] - first + 1, dtype=np.uint64)
            np.cumsum(_VALUE[data[first : b[-1]]] * _POWERS[: b[-1] - first], out=sums[1:])
            h[here] = (sums[b - first] - sums[a - first]) * _POWERS[_SEGMENT + _LONG - (a - first)]
    h = _mixed(h, length)
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return h, np.diff(np.searchsorted(starts, offsets))


def _hashes(words: list[bytes]) -> np.ndarray:
    """Of single words; an empty one is END."""
    h, n = _word_hashes(pa.array(words, pa.binary()))
    out = np.full(len(words), _END_HASH)
    out[n > 0] = h
    return out


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _uniform_bits(u * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) ^ w


_END_HASH = _mixed(np.zeros(1, dtype=np.uint64), np.zeros(1))[0]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple]:
    """Whole texts of about ``size`` tokens: (hashes of their different words, the place of each token among these, tokens of each text, the
    rows' other columns). Every text ends with END, so the token before a text's first one is an END in any case."""
    parts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    rest: list[dict] = []
    total = 0

    def chunk() -> tuple:
        coded = pa.array(np.concatenate(parts)).dictionary_encode()
        parts.clear()
        return coded.dictionary.to_numpy(), coded.indices.to_numpy(), np.concatenate(lengths), rest

    for batch in slices(batches):
        h, n = _word_hashes(batch.column("body"))
        every = np.full(len(h) + len(n), _END_HASH)
        every[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        parts.append(every)
        lengths.append(n + 1)
        rest.extend(batch.drop_columns(["body"]).to_pylist())
        total += len(every)
        if total >= size:
            yield chunk()
            lengths, rest, total = [], [], 0
    if lengths:
        yield chunk()


# ---- numbers dealt by key, many to a row

DEALT = "part int, kind int, data array<binary>"


def _packed(x: np.ndarray) -> bytes:
    """8-byte numbers, their bytes by significance, so that equal high bytes stand together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((_uniform_bits(key.view(np.uint64)) >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def _deal(lots, parts: int, fan: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT from lots (kind, 8-byte columns); the first column, an int64, says the part."""
    for kind, columns in lots:
        if not len(columns[0]):
            continue
        part = (_part(columns[0], parts) // fan).astype(np.uint32)
        part = part.astype(np.uint16) if parts // fan < 1 << 16 else part
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in columns]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        last = np.append(first[1:], len(part))
        data = [[_packed(c[a:b]) for c in columns] for a, b in zip(first, last)]
        n = len(first)
        yield _batch(["part", "kind", "data"], part[first].astype(np.int32), np.full(n, kind, dtype=np.int32), pa.array(data, pa.list_(pa.binary())))


def _lots(batches: Iterator[pa.RecordBatch], most: int = 1 << 62) -> Iterator[dict[int, list[np.ndarray]]]:
    """Dealt rows as int64 columns by kind: all of a task at once, or about ``most`` numbers at a time."""
    found: dict[int, list[list[np.ndarray]]] = {}
    n = 0
    for batch in batches:
        kinds, data = batch.column("kind").to_pylist(), batch.column("data")
        for i, kind in enumerate(kinds):
            columns = [_unpacked(x.as_buffer()) for x in data[i].values]
            found.setdefault(kind, []).append(columns)
            n += len(columns[0]) * len(columns)
        if n >= most:
            yield {k: [np.concatenate(c) for c in zip(*v)] for k, v in found.items()}
            found, n = {}, 0
    if found:
        yield {k: [np.concatenate(c) for c in zip(*found.pop(k))] for k in list(found)}


def _fan(parts: int) -> int:
    return 1 if parts <= FAN else FAN


def _regrouped(sources: list, parts: int, run, schema: str) -> DataFrame:
    """``run(lots of one part)`` for each part. sources: (DataFrame, batches -> lots)."""

    def first(lots):
        return lambda batches: _deal(lots(batches), parts, _fan(parts))

    dealt = None
    for df, lots in sources:
        one = map_arrow(df, first(lots), DEALT)
        dealt = one if dealt is None else dealt.union(one)
    return _gathered(dealt, parts, run, schema)


def _gathered(dealt: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """``run(lots of one part)`` for each part of dealt rows. Each part is one task; beyond FAN parts the numbers are dealt in two rounds, else a
    task would make rows of a few numbers."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lots in _lots(batches, 1 << 23):
            yield from _deal(lots.items(), parts)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lots in _lots(batches):
            yield from run(lots)

    if _fan(parts) > 1:
        dealt = map_arrow(dealt.repartitionById(-(-parts // FAN), F.col("part")), again, DEALT)
    return map_arrow(dealt.repartitionById(parts, F.col("part")), end, schema)


def _added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums by key: the place of one row of each key, the keys, the sums."""
    order = np.argsort(key)
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    return order[first], key[order[first]], [np.add.reduceat(v[order], first) for v in values]


class Shared:
    """Values for the tasks of a few jobs, gone from all disks when these are over."""

    def __init__(self, spark: SparkSession, *values):
        self.sent = spark.sparkContext.broadcast(values)

    def __enter__(self):
        return self.sent

    def __exit__(self, *_) -> None:
        self.sent.destroy()


@dataclass
class Held:
    """The words that every task holds, sorted by hash, with their training counts."""

    hashes: np.ndarray
    n: np.ndarray

    def number(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those not held."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _code(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return u.astype(np.int64) << 24 | w


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _vocabulary(docs: DataFrame, parts: int) -> DataFrame:
    """(w, n, held): how often a word stands in the documents to learn from, and whether it does in others."""

    def lots(batches: Iterator[pa.RecordBatch]):
        for h, ids, lengths, rows in _chunks(batches):
            learn = np.repeat(np.array([r["learn"] for r in rows], dtype=bool), lengths)
            yield 0, [_as_long(h), np.bincount(ids[learn], minlength=len(h)), np.bincount(ids[~learn], minlength=len(h))]

    def run(found) -> Iterator[pa.RecordBatch]:
        _, w, (n, m) = _added(*found[0])
        yield _batch(["w", "n", "held"], w, n, m > 0)

    return _regrouped([(docs, lots)], parts, run, "w long, n long, held boolean")


def _top(rows: DataFrame, count: str, most: int) -> int:
    """The least count (at eighths of a power of two) from which on there are no more than ``most`` rows."""
    level = F.ceil(F.log2(F.col(count).cast("double")) * 8).cast("long")
    left, least = most, 2.0**62
    for r in sorted(rows.where(F.col(count) > 0).groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = 2.0 ** ((r.level - 1) / 8)
    return int(least) + 1 if least >= 1 else 1


def _pairs(docs: DataFrame, sent, parts: int) -> DataFrame:
    """(k, u, w, kind, c): pairs with a training count c of two or more, those seen once that occur in other documents as well, and all
    of two rare words. kind: 0 both words are held, 1 the context is rare, 2 the word is, 3 both are. Of kind 0, k is the code of both
    numbers, else a hash of both words u and w."""

    def lots(batches: Iterator[pa.RecordBatch]):
        held = sent.value[0]
        for h, ids, lengths, rows in _chunks(batches):
            number = held.number(h)
            learn = np.repeat(np.array([r["learn"] for r in rows], dtype=bool), lengths)
            before = np.roll(ids, 1)
            u, w = number[before], number[ids]
            top = (u >= 0) & (w >= 0)
            for both in (True, False):
                at = top if both else ~top
                pair = _code(u[at], w[at]) if both else before[at].astype(np.int64) * len(h) + ids[at]
                key, n = np.unique(pair * 2 + learn[at], return_counts=True)
                learned = key & 1 == 1
                pair = key >> 1
                counts = [np.where(learned, n, 0), (~learned).astype(np.int64)]
                if both:
                    yield 0, [pair, *counts]
                else:
                    a, b = h[pair // len(h)], h[pair % len(h)]
                    yield 1, [_as_long(_pair_key(a, b)), *counts, _as_long(a), _as_long(b)]

    def run(found) -> Iterator[pa.RecordBatch]:
        held = sent.value[0]
        for lot, (key, c, m, *words) in found.items():
            at, k, (c, m) = _added(key, c, m)
            if lot:
                u, w = (x[at] for x in words)
                kind = ((held.number(u.view(np.uint64)) < 0) + 2 * (held.number(w.view(np.uint64)) < 0)).astype(np.int32)
            else:
                u = w = np.zeros(len(k), dtype=np.int64)
                kind = np.zeros(len(k), dtype=np.int32)
            keep = (c > 1) | (c == 1) & ((m > 0) | (kind == 3))
            yield _batch(["k", "u", "w", "kind", "c"], *(x[keep] for x in (k, u, w, kind, c)))

    return _regrouped([(docs, lots)], parts, run, "k long, u long, w long, kind int, c long")


@dataclass
class Model:
    """Totals, and what the sweeps after the first leave: arrays by held word, and the table ``rare`` of the other words."""

    n: int
    v: int
    root_discount: float
    discount: float
    held: Held
    pairs: DataFrame
    rare: DataFrame
    parts: int = 1
    strengths: list[np.ndarray] = field(default_factory=list)  # of held contexts, by sweep
    shares: list[np.ndarray] = field(default_factory=list)  # of held words in the root, when the sweep was drawn
    own: np.ndarray | None = None
    p: np.ndarray | None = None
    rest: float = 1.0
    once: float = 0.0  # probability of a word seen once
    sweeps: list[int] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 1 / (self.v + 1)

    @property
    def unseen(self) -> float:
        return self.rest * self.base

    @property
    def own_once(self) -> float:
        return (THETA + self.discount) / (THETA + 1)

    def one(self, n):
        """The share of a context of n tokens that a pair seen once has of its own."""
        return (1 - self.discount) / (THETA + n)


_LOW = (1 << 24) - 1
_SUMS = ("c_u", "c_w", "t_u", "t_w")


def _met(pairs: DataFrame, rare: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with a rare word, with columns of ``rare`` for it: u_x of the context, w_x of the word. A held word is not looked for: the key is then the pair's own."""
    for side, kinds in (("u", (1, 3)), ("w", (2, 3))):
        key = F.when(F.col("kind").isin(*kinds), F.col(side)).otherwise(F.col("k"))
        looked = rare.select(F.col("w").alias("_key"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        pairs = pairs.withColumn("_on", key).join(looked, F.col("_on") == F.col("_key"), "left").drop("_on", "_key")
    return pairs


def _of(batch: pa.RecordBatch, number: np.ndarray, values: np.ndarray, column: str) -> np.ndarray:
    """By pair: the held word's value, or that of the joined column."""
    if column not in batch.schema.names:
        return values[number]
    out = batch.column(column).to_numpy(zero_copy_only=False).astype(np.float64)
    here = number >= 0
    out[here] = values[number[here]]
    return out


def _sides(batch: pa.RecordBatch, held: Held) -> tuple:
    """Hashes and numbers (-1: rare) of the pairs' contexts and words. Pairs of held words have no columns u and w."""
    if "u" not in batch.schema.names:
        k = batch.column("k").to_numpy()
        iu, iw = k >> 24, k & _LOW
        return held.hashes[iu], held.hashes[iw], iu, iw
    u, w = (batch.column(x).to_numpy().view(np.uint64) for x in ("u", "w"))
    return u, w, held.number(u), held.number(w)


def _held_sums(pairs: DataFrame, size: int, tables) -> np.ndarray:
    """c_u, c_w, t_u, t_w by number: counts and tables of pairs(k, c) of held words, summed by context and by word. Tasks add up what they
    read, ranges of numbers are added over tasks, and the driver gets these sums."""
    step = max(1, -(-size // RANGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, size), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                c, t, iu, iw = tables(batch)
                for row, number, value in ((0, iu, c), (1, iw, c), (2, iu, t), (3, iw, t)):
                    np.add.at(sums[row], number, value)
        for part in range(RANGES):
            data = [_packed(x[part * step : (part + 1) * step]) for x in sums]
            yield _batch(["part", "kind", "data"], np.array([part], dtype=np.int32), np.zeros(1, dtype=np.int32), pa.array([data], pa.list_(pa.binary())))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part, more = batch.column("part")[i].as_py(), np.array([_unpacked(x) for x in batch.column("data")[i].as_py()])
                sums = more if sums is None else sums + more
        if part is not None:
            yield _batch(["part", "kind", "data"], np.array([part], dtype=np.int32), np.zeros(1, dtype=np.int32), pa.array([[_packed(x) for x in sums]], pa.list_(pa.binary())))

    rows = map_arrow(map_arrow(pairs.where("kind = 0 AND c > 1").select("k", "c"), run, DEALT).repartitionById(RANGES, F.col("part")), add, DEALT).toArrow()
    out = np.zeros((4, size), dtype=np.int64)
    for part, data in zip(rows.column("part").to_pylist(), rows.column("data").to_pylist()):
        for row, x in enumerate(data):
            out[row, part * step : (part + 1) * step] = _unpacked(x)
    return out


def _rare_sums(pairs: DataFrame, rare: DataFrame, columns: list[str], tables) -> DataFrame:
    """(key, c_u, c_w, t_u, t_w): the same of pairs with a rare word. key: a held word's number or a rare one's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, t, iu, iw = tables(batch)
                zero = np.zeros(len(c), dtype=np.int64)
                key_u, key_w = (np.where(i >= 0, i, batch.column(x).to_numpy()) for i, x in ((iu, "u"), (iw, "w")))
                yield _batch(["key", *_SUMS], key_u, c, zero, t, zero)
                yield _batch(["key", *_SUMS], key_w, zero, c, zero, t)

    met = pairs.where("kind > 0 AND c > 1").select("k", "u", "w", "kind", "c")
    met = _met(met, rare, columns) if columns else met
    rows = map_arrow(met, run, "key long, " + ", ".join(f"{c} long" for c in _SUMS))
    return store(rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in _SUMS)))


def _root_seats(df: DataFrame, discount: float, new: float, sweep: int) -> DataFrame:
    """The rows with the tables t that their customers open in the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, c = batch.column("w").to_numpy().view(np.uint64), batch.column("customers").to_numpy().astype(np.float64)
                t = seat(c, np.full(len(c), new), discount, key, sweep << 10).astype(np.int64)
                yield _batch([*batch.schema.names, "t"], *batch.columns, t)

    return map_arrow(df, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", t long")


def train(docs: DataFrame, sweeps: int = 4, words: int = WORDS) -> Model:
    """The model of those of docs(body, learn) that have ``learn``. At most ``words`` words are held by every task."""
    spark = docs.sparkSession
    length = docs.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    parts = max(1, ceil(length / 6 / SHUFFLED))  # words have six bytes or so
    vocabulary = store(_vocabulary(docs, parts))
    x = vocabulary.agg(
        F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"),
    ).first()
    least = _top(vocabulary, "n", words)
    table = vocabulary.where(F.col("n") >= least).select("w", "n").toArrow()
    h = table.column("w").to_numpy().view(np.uint64)
    order = np.argsort(h)
    held = Held(h[order], table.column("n").to_numpy()[order])
    size = len(held.hashes)
    # words that are neither held nor here were seen once, or never
    rare = store(vocabulary.where((F.col("n") < least) & ((F.col("n") > 1) | (F.col("n") == 1) & F.col("held"))).select("w", "n"))
    discard(vocabulary)
    with Shared(spark, held) as sent:
        pairs = store(_pairs(docs, sent, parts))
        twos, more, apart = pairs.agg(F.count_if(F.col("c") == 2), F.sum(F.when(F.col("c") > 1, F.col("c"))), F.count_if((F.col("kind") > 0) & (F.col("c") > 1))).first()
        d, d_root, base = discount_of(x.n - (more or 0), twos or 0), discount_of(x.one, x.two), 1 / (x.v + 1)
        model = Model(x.n, x.v, d_root, d, held, pairs, rare, parts)
        _sweeps(model, sent, x.v - size - rare.count(), bool(apart), sweeps, base)
    discard(rare)
    return model


def _sweeps(model: Model, sent, n_once: int, apart: bool, sweeps: int, base: float) -> None:
    """Draw all seats and set the averages. n_once: words seen once that are neither held nor in ``rare``; apart: whether pairs with a rare word are sampled."""
    spark, pairs, size, d, d_root = model.pairs.sparkSession, model.pairs, len(model.held.hashes), model.discount, model.root_discount
    n = model.held.n
    zero = F.lit(0).cast("long")

    def sums_of(columns: list[str], tables) -> tuple[np.ndarray, DataFrame | None]:
        sums = _held_sums(pairs, size, tables)
        if not apart:
            return sums, None
        more = _rare_sums(pairs, model.rare, columns, tables)
        own = more.where((F.col("key") >= 0) & (F.col("key") < size)).toArrow()
        for row, name in enumerate(_SUMS):
            sums[row, own.column("key").to_numpy()] += own.column(name).to_numpy()
        return sums, more

    def added(rows: DataFrame, more: DataFrame | None) -> DataFrame:
        if more is None:
            return rows.select("*", *(zero.alias(c) for c in _SUMS))
        return rows.join(more, F.col("w") == F.col("key"), "left").select(rows["*"], *(F.coalesce(c, zero).alias(c) for c in _SUMS))

    def first(batch: pa.RecordBatch):
        _, _, iu, iw = _sides(batch, sent.value[0])
        c = batch.column("c").to_numpy()
        return c, np.ones(len(c), dtype=np.int64), iu, iw

    # the sweep before the first: one table for each dish
    (c_u, c_w, t_u, t_w), more = sums_of([], first)
    singles_u, singles_w = n - c_u, n - c_w
    tables_of, customers, t = singles_u + t_u, singles_w + t_w, np.ones(size)
    state = added(model.rare, more).select("w", "n", (F.col("n") - F.col("c_u")).alias("singles_u"), (F.col("n") - F.col("c_w")).alias("singles_w"), "t_u", "t_w")
    written = store(state.select("w", "n", "singles_u", "singles_w", (F.col("singles_u") + F.col("t_u")).alias("tables"), (F.col("singles_w") + F.col("t_w")).alias("customers"), F.lit(1).cast("long").alias("t")))
    if more is not None:
        discard(more)
    model.rare = written

    def rest_of(root: tuple[float, float]) -> float:
        return (THETA + d_root * root[0]) / (THETA + root[1])

    def totals() -> tuple[float, float]:
        r = model.rare.agg(F.sum("t"), F.sum("customers")).first()
        return float(t.sum() + n_once + (r[0] or 0)), float(customers.sum() + n_once + (r[1] or 0))

    def share(t, customers):
        return (customers - d_root * t) / (THETA + root[1]) + rest_of(root) * base

    root, kept = totals(), []
    averages, rests, once = [np.zeros(size), np.zeros(size)], [], []
    for sweep in range(1, sweeps + 1):
        keep = sweep > min(BURN, sweeps - 1)
        strength, p, names = THETA + d * tables_of, share(t, customers), [f"s{sweep}", f"p{sweep}"]
        model.rare = model.rare.withColumns({names[0]: THETA + d * F.col("tables"), names[1]: share(F.col("t"), F.col("customers"))})
        with Shared(spark, strength, p) as now:

            def seats(batch: pa.RecordBatch, now=now, names=names, sweep=sweep):
                u, w, iu, iw = _sides(batch, sent.value[0])
                c = batch.column("c").to_numpy()
                new = _of(batch, iu, now.value[0], f"u_{names[0]}") * _of(batch, iw, now.value[1], f"w_{names[1]}")
                return c, seat(c.astype(np.float64), new, d, _pair_key(u, w), sweep << 10).astype(np.int64), iu, iw

            (_, _, t_u, t_w), more = sums_of(names, seats)
        tables_of, customers = singles_u + t_u, singles_w + t_w
        new = (THETA + d_root * root[0]) * base
        t = seat(customers.astype(np.float64), np.full(size, new), d_root, model.held.hashes, sweep << 10)
        columns = ["w", "n", "singles_u", "singles_w", *kept, *(names if keep else [])]
        opened = added(model.rare, more).select(*columns, (F.col("singles_u") + F.col("t_u")).alias("tables"), (F.col("singles_w") + F.col("t_w")).alias("customers"))
        former, written = written, store(_root_seats(opened, d_root, new, sweep))
        discard(former, *([] if more is None else [more]))
        model.rare = written
        root = totals()
        if keep:
            model.sweeps.append(sweep)
            model.strengths.append(strength)
            model.shares.append(p)
            averages[0] += tables_of
            averages[1] += share(t, customers)
            rests.append(rest_of(root))
            once.append(share(1, 1))
            at = {f"tables{sweep}": F.col("tables"), f"q{sweep}": share(F.col("t"), F.col("customers"))}
            model.rare = model.rare.withColumns(at)
            kept += [*names, *at]
    number = max(len(rests), 1)
    model.own = (THETA + d * averages[0] / number) / (THETA + n)
    model.p = averages[1] / number
    model.rest, model.once = (float(np.mean(rests)), float(np.mean(once))) if rests else (1.0, 0.0)
    mean = {name: sum((F.col(f"{name}{s}") for s in model.sweeps), F.lit(0.0)) / number for name in ("tables", "q")}
    drawn = [f"{x}{s}" for s in model.sweeps for x in "sp"]
    model.rare = store(model.rare.select("w", "n", *drawn, ((THETA + d * mean["tables"]) / (THETA + F.col("n"))).alias("own"), mean["q"].alias("p")))
    discard(written)


def _differences(batch: pa.RecordBatch, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """What the pairs' own counts add to log10 of their probability in a training document (of two rare words: the whole), and in others."""
    u, w, iu, iw = _sides(batch, m.held)
    c = batch.column("c").to_numpy().astype(np.float64)

    def value(number, values, name, once):
        out = _of(batch, number, values, name)
        return np.where(np.isnan(out), once, out)  # a word that has no row was seen once

    n, own = value(iu, m.held.n.astype(np.float64), "u_n", 1.0), value(iu, m.own, "u_own", m.own_once)
    p = value(iw, m.p, "w_p", m.once)
    key, t = _pair_key(u, w), np.zeros(len(c))
    for s, strength, share in zip(m.sweeps, m.strengths, m.shares):
        # of a pair seen once, any weight leaves one table
        new = np.nan_to_num(_of(batch, iu, strength, f"u_s{s}") * _of(batch, iw, share, f"w_p{s}"))
        t += seat(c, new, m.discount, key, s << 10)
    t /= max(len(m.sweeps), 1)
    score = np.log10((c - m.discount * t) / (THETA + n) + own * p)
    whole = np.where((iu < 0) & (iw < 0), 0.0, np.log10(m.one(n) + own * p))
    return score - whole, score - np.log10(own * p)


#: Lots of the scoring: a pair's difference, the probability of a rare word, the share of the parent in a rare context, a pair of rare
#: words, a rare word's count; a document; answers. Columns: key, uid (even: training) and two numbers; key, uid and five; key and three.
DELTA, WORD, CONTEXT, WHOLE, COUNT, DOCUMENT, ANSWER = range(7)


def _asked(sent, total: float):
    """Batches of (doc_id, body, learn) -> the lots of their documents."""

    def lots(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        m, codes, x, y = sent.value
        held, one, own, p = m.held, m.one(m.held.n), m.own, m.p
        log_base = np.log10((held.n + 1) / total)
        first = TaskContext.get().partitionId() << 37
        for h, ids, lengths, rows in _chunks(batches, CHUNK >> 1):
            number = held.number(h)
            learn_doc = np.array([r["learn"] for r in rows], dtype=bool)
            uids = first + 2 * np.arange(len(rows)) + ~learn_doc
            first += 2 * len(rows)
            learn, uid = np.repeat(learn_doc, lengths), np.repeat(uids, lengths)
            before = np.roll(ids, 1)
            u, w = number[before], number[ids]
            has_u, has_w = u >= 0, w >= 0
            score, base = np.zeros(len(ids)), np.zeros(len(ids))
            base[has_w] = log_base[w[has_w]]
            both = np.flatnonzero(has_u & has_w)
            ub, wb = u[both], w[both]
            score[both] = np.log10(np.where(learn[both], one[ub], 0.0) + own[ub] * p[wb])
            code = _code(ub, wb)
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                here = codes[at] == code
                score[both[here]] += np.where(learn[both[here]], x[at[here]], y[at[here]])
                both, code = both[~here], code[~here]
            yield DELTA, [code, uid[both]]
            rare = np.flatnonzero(~(has_u & has_w))
            if len(rare):
                key = _as_long(_pair_key(h[before[rare]], h[ids[rare]]))
                hu, hw = _as_long(h)[before[rare]], _as_long(h)[ids[rare]]
                uu, ww, train_doc, of = u[rare], w[rare], learn[rare], uid[rare]
                two = (uu < 0) & (ww < 0)
                whole = two & train_doc
                yield DELTA, [key[~whole], of[~whole]]
                yield WHOLE, [key[whole], of[whole]]
                yield COUNT, [hw[whole], of[whole]]
                word = (ww < 0) & ~two
                yield WORD, [hw[word], of[word], np.where(train_doc[word], one[uu[word]], 0.0), own[uu[word]]]
                context = (uu < 0) & ~two
                yield CONTEXT, [hu[context], of[context], p[ww[context]]]
                apart = two & ~train_doc  # without a part of its own the probability is a product
                yield WORD, [hw[apart], of[apart], np.zeros(apart.sum()), np.ones(apart.sum())]
                yield CONTEXT, [hu[apart], of[apart], np.ones(apart.sum())]
            starts = np.cumsum(lengths) - lengths
            base, score, known = (np.add.reduceat(z, starts) for z in (base, score, has_w.astype(np.int64)))
            ids_null = np.array([r["doc_id"] is None for r in rows])
            doc_ids = np.array([r["doc_id"] or 0 for r in rows], dtype=np.int64)
            yield DOCUMENT, [uids, uids, doc_ids, lengths, 2 * known + ids_null, base, score]

    return lots


def _told(sent):
    """Batches of pairs -> lots of answers."""

    def lots(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                x, y = _differences(batch, sent.value[0])
                yield ANSWER, [batch.column("k").to_numpy(), x, y, np.zeros(len(x))]

    return lots


def _told_of_words(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if batch.num_rows:
            yield ANSWER, [batch.column("w").to_numpy(), *(batch.column(c).to_numpy().astype(np.float64) for c in ("n", "own", "p"))]


def _scored(found: dict[int, list[np.ndarray]], m: Model, total: float):
    """Lots of one part's sums by document: uid and base, score and known tokens to add. Those of documents go through."""
    key, *values = found.pop(ANSWER, [np.zeros(0, dtype=np.int64)] * 4)
    order = np.argsort(key)
    key, (x, y, z) = key[order], (v.view(np.float64)[order] for v in values)
    uids, bases, scores_of, knowns = [], [], [], []
    for kind, (asked, uid, *more) in found.items():
        if kind == DOCUMENT:
            yield kind, [asked, uid, *more]
            continue
        at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
        hit = key[at] == asked if len(key) else np.zeros(len(asked), dtype=bool)
        training = uid & 1 == 0
        if kind == DELTA:
            uid, at, training = uid[hit], at[hit], training[hit]
            score, base, known = np.where(training, x[at], y[at]), None, None
        else:

            def told(v, seen, unseen, at=at, hit=hit, training=training):
                out = np.where(training, seen, unseen)
                out[hit] = v[at[hit]]
                return out

            n = told(x, 1.0, 0.0)
            a = more[0].view(np.float64) if more else None
            if kind == WORD:
                score = np.log10(a + more[1].view(np.float64) * told(z, m.once, m.unseen))
            elif kind == CONTEXT:
                score = np.log10(np.where(training, m.one(n), 0.0) + told(y, m.own_once, 1.0) * a)
            else:
                score = told(x, 0.0, 0.0) if kind == WHOLE else np.zeros(len(uid))
            base, known = (np.log10((n + 1) / total), (n > 0).astype(np.int64)) if kind in (WORD, COUNT) else (None, None)
        uids.append(uid)
        scores_of.append(score)
        bases.append(np.zeros(len(uid)) if base is None else base)
        knowns.append(np.zeros(len(uid), dtype=np.int64) if known is None else known)
    if uids and len(uid := np.concatenate(uids)):
        _, uid, sums = _added(uid, *map(np.concatenate, (bases, scores_of, knowns)))
        yield DELTA, [uid, *sums]


def _whole(found: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Documents of one part with all their sums."""
    if DOCUMENT not in found:
        return
    uid, _, doc_id, n, known, base, score = found[DOCUMENT]
    order = np.argsort(uid)
    uid, doc_id, n, known, base, score = (x[order] for x in (uid, doc_id, n, known, base.view(np.float64), score.view(np.float64)))
    null, known = known & 1 == 1, known >> 1
    if DELTA in found:
        of, more_base, more_score, more_known = found[DELTA]
        at = np.searchsorted(uid, of)
        np.add.at(base, at, more_base.view(np.float64))
        np.add.at(score, at, more_score.view(np.float64))
        np.add.at(known, at, more_known)
    yield _batch(["doc_id", "n_tokens", "n_known", "base_score", "score"], pa.array(doc_id, mask=null), n, known, base, score)


def scores(
    docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, pairs: int = PAIRS, sweeps: int = 4
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, learning from those with ``train_on``.

    A null text is empty: its one token is the end. Repeated rows are scored (and counted) each. With nothing to learn from, all
    probabilities are one: there is one event, the unseen. ``words`` and ``pairs``: how many every task holds at most (words: below 2^24).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body"), F.coalesce(train_on, F.lit(False)).alias("learn"))
    with tidy_shuffles(spark):
        model = train(rows.select("body", "learn"), sweeps, words)
        total = float(model.n + model.v + 1)
        bare = replace(model, pairs=None, rare=None)
        light = replace(bare, strengths=[], shares=[], sweeps=[])
        least = _top(model.pairs.where("kind = 0"), "c", pairs)
        held_pair = F.expr(f"kind = 0 AND c >= {least}")
        drawn = [f"{x}{s}" for s in model.sweeps for x in "sp"]
        with Shared(spark, bare) as sent:

            def held_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield _batch(["k", "x", "y"], batch.column("k"), *_differences(batch, sent.value[0]))

            top = map_arrow(model.pairs.where(held_pair).select("k", "c"), held_answers, "k long, x double, y double").toArrow()
            codes = top.column("k").to_numpy()
            order = np.argsort(codes)
            rest = model.pairs.where(~held_pair)
            with Shared(spark, light, codes[order], *(top.column(c).to_numpy()[order] for c in ("x", "y"))) as asked:
                sources = [
                    (rows, _asked(asked, total)),
                    (rest.where("kind = 0").select("k", "c"), _told(sent)),
                    (_met(rest.where("kind > 0").select("k", "u", "w", "kind", "c"), model.rare, ["n", "own", "p", *drawn]), _told(sent)),
                    (model.rare.select("w", "n", "own", "p"), _told_of_words),
                ]
                parts = model.parts
                sums = _regrouped(sources, parts, lambda lots: _deal(_scored(lots, asked.value[0], total), parts, _fan(parts)), DEALT)
                found = store(_gathered(sums, parts, _whole, "doc_id long, n_tokens long, n_known long, base_score double, score double"))
        discard(model.pairs, model.rare)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = F.coalesce(crc_mod("doc_id", 7), F.lit(0))
    return scores(docs, rest != 2).select(
        "doc_id", (rest == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
