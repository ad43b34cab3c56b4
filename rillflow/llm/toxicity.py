"""Toxicity scores by logistic regression with FTRL-proximal updates.

Method: binary features are hashed word n-grams (one and two words) and skip-grams (two words with one between). FTRL-proximal keeps a
learning rate for each coordinate and drives the weights of uninformative features to exactly zero by L1, so what is
left is a short list of (feature, weight) that every task can hold.

The fit uses at most ``train_rows`` labelled rows (a documented parameter), chosen by a hash of the id; their feature sets come from whole
texts on the executors. A feature set has at most ``2 ** BITS`` members however long the text is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import PIECE, alnum_words, body, crc_mod, map_batches

BITS = 22


class _Hashes(dict):
    """CRC of each word, kept while there are not too many different words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


_hashes = _Hashes()


def grams(raw: bytes) -> list[np.ndarray]:
    """Hashed features of the whole text, with repeats, in pieces."""
    words = alnum_words(raw)
    shift, out = np.uint32(32 - BITS), []
    for at in range(0, len(words), PIECE):
        part = words[at : at + PIECE + 2]
        h = np.fromiter(map(_hashes.__getitem__, part), dtype=np.uint32, count=len(part))
        own = h[:PIECE] * np.uint32(0x9E3779B1)
        out.append(own >> shift)
        for gap, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
            a, b = h[: min(PIECE, len(h) - gap)] if len(h) > gap else h[:0], h[gap : gap + PIECE]
            out.append(((a * np.uint32(factor) ^ (a >> np.uint32(13))) + b * np.uint32(0x27D4EB2F)) * np.uint32(0x9E3779B1) >> shift)
    return out


def features(raw: bytes) -> np.ndarray:
    parts = grams(raw)
    return np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    _dense: np.ndarray | None = None

    def score(self, raw: bytes) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, dtype=np.float32)
            self._dense[self.index] = self.weight
        hit: set[int] = set()
        for part in grams(raw):
            hit.update(part[self._dense[part] != 0].tolist())
        z = self.bias + float(sum(self._dense[i] for i in sorted(hit)))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    def __getstate__(self):
        return self.index, self.weight, self.bias

    def __setstate__(self, state):
        self.index, self.weight, self.bias = state
        self._dense = None


def fit(
    rows: list[tuple[np.ndarray, int]], epochs: int = 20, alpha: float = 3.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0
) -> Model:
    """FTRL-proximal over the rows, in the order given, ``epochs`` times. Without rows every score is one half."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    def bias() -> float:  # not regularized
        return -zb / ((beta + nb**0.5) / alpha)

    for _ in range(epochs):
        for i, label in rows:
            w, b = weights(i), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
            old = nb
            nb += g * g
            zb += g - (nb**0.5 - old**0.5) / alpha * b
    index = np.flatnonzero(np.abs(z) > l1)
    return Model(index.astype(np.int32), weights(index).astype(np.float32), float(bias()))


def sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Feature sets and labels of at most train_rows rows of docs(doc_id, body) with a label, by the least hashes of the id, and what
    to add to the bias: up to half the rows have label 1, so the sample's odds differ from those of all labels.
    """
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {0: 0, 1: 0} | {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not sum(total.values()):
        return [], 0.0
    quota = {1: min(total[1], max(train_rows // 2, train_rows - total[0]))}
    quota[0] = min(total[0], train_rows - quota[1])
    limit = {k: int(min(1.0, (1.1 * quota[k] + 50) / max(1, total[k])) * (1 << 30)) for k in quota}
    place = F.pmod("order", F.lit(1 << 30))
    known = known.withColumn("order", F.xxhash64(F.lit(11), "doc_id"))
    known = known.where(place < F.when(F.col("label") == 1, limit[1]).otherwise(limit[0]))
    picked = docs.join(F.broadcast(known), "doc_id").select("body", "label", "order")  # about train_rows ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [features(raw).tobytes() for raw in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(sets, pa.binary())], names=["order", "label", "features"])

    rows, seen = [], {0: 0, 1: 0}
    got = map_batches(picked, run, "order long, label int, features binary").collect()
    for r in sorted(got, key=lambda r: (r.order, bytes(r.features))):
        if seen[r.label] < quota[r.label]:
            seen[r.label] += 1
            rows.append((np.frombuffer(bytes(r.features), dtype=np.int32), r.label))
    shift = np.log((total[1] + 1) / (total[0] + 1)) - np.log((seen[1] + 1) / (seen[0] + 1))
    return rows, float(shift)


def toxicity(
    docs: DataFrame, labels: DataFrame, train_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs, fitted on the rows of ``labels`` (all of them may be used).

    A null text is empty; empty texts get the score of the bias alone. A doc_id labelled twice counts once, with its largest label.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen, shift = sample(rows, known, train_rows)
    model = fit(chosen)
    model.bias += shift

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(raw) for raw in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
            names=["doc_id", "score", "predicted"],
        )

    return map_batches(rows, run, "doc_id long, score double, predicted int")


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = crc_mod("doc_id", 5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(rest != 0)
    return toxicity(docs, labels).select("doc_id", (F.coalesce(rest, F.lit(1)) == 0).alias("held_out"), "score", "predicted")
