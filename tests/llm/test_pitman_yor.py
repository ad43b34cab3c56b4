import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rillflow.llm import pitman_yor as py


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def plain(rows):
    """rows: (doc_id, text, learn) -> (n_tokens, n_known, train_tokens, base)."""
    c = Counter(w for _, t, learn in rows if learn for w in words(t))
    n, v = sum(c.values()), len(c)
    return [
        (i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t, _ in rows
    ]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(df, **more):
    from rillflow.llm.common import crc_mod

    got = py.scores(df, F.coalesce(crc_mod("doc_id", 7), F.lit(0)) != 2, **more).collect()
    want = sorted(plain([(r.doc_id, r.text, not held(r.doc_id)) for r in df.collect()]), key=str)
    got = sorted(got, key=lambda r: str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3))))
    want = sorted(want, key=lambda r: str((*r[:4], round(r[4], 3))))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:4] == w[:4] and abs(g.base_score - w[4]) < 1e-6 * max(1, abs(w[4])) and np.isfinite(g.score)
    return {r.doc_id: r for r in got}


def key(w):
    return int(py._hashes([b"" if w is None else w.encode()])[0])


def seats(customers, weight, discount, k, salt):
    return int(py.seat(np.array([float(customers)]), np.array([weight]), discount, np.array([k], dtype=np.uint64), salt)[0])


class Plain:
    """The same model with dicts, pair by pair: every pair is sampled, none is left out or taken together."""

    def __init__(self, texts, sweeps=4):
        texts = [[None, *words(t)] for t in texts]
        self.c = Counter(p for t in texts for p in zip(t, t[1:]))
        self.n = Counter(w for t in texts for w in t[1:])
        of = Counter(self.c.values())
        self.d = py.discount_of(of[1], of[2])
        of = Counter(self.n.values())
        d0 = py.discount_of(of[1], of[2])
        self.base = 1 / (len(self.n) + 1)
        hashes = {w: key(w) for w in self.n}
        pair = {p: int(py._pair_key(np.array([hashes[p[0]]], dtype=np.uint64), np.array([hashes[p[1]]], dtype=np.uint64))[0]) for p in self.c}
        t, root = dict.fromkeys(self.c, 1), dict.fromkeys(self.n, 1)
        self.kept = []
        for sweep in range(1, sweeps + 1):
            tables, customers = Counter(), Counter()
            for (u, w), k in t.items():
                tables[u] += k
                customers[w] += k
            all_tables, all_customers = sum(root.values()), sum(customers.values())
            p = {w: (customers[w] - d0 * root[w] + (py.THETA + d0 * all_tables) * self.base) / (py.THETA + all_customers) for w in self.n}
            t = {q: seats(c, (py.THETA + self.d * tables[q[0]]) * p[q[1]], self.d, pair[q], sweep << 10) for q, c in self.c.items()}
            tables, customers = Counter(), Counter()
            for (u, w), k in t.items():
                tables[u] += k
                customers[w] += k
            root = {w: seats(customers[w], (py.THETA + d0 * all_tables) * self.base, d0, hashes[w], sweep << 10) for w in self.n}
            all_tables, all_customers = sum(root.values()), sum(customers.values())
            rest = (py.THETA + d0 * all_tables) / (py.THETA + all_customers)
            p = {w: (customers[w] - d0 * root[w]) / (py.THETA + all_customers) + rest * self.base for w in self.n}
            if sweep > min(py.BURN, sweeps - 1):
                self.kept.append((t, tables, p, rest))

    def mean(self, f):
        return sum(map(f, self.kept)) / max(len(self.kept), 1)

    def probability(self, u, w):
        n = self.n[u]
        p = self.mean(lambda s: s[2].get(w, s[3] * self.base))
        own = self.mean(lambda s: (py.THETA + self.d * s[1][u]) / (py.THETA + n))
        c = self.c[u, w]
        return (c - self.d * self.mean(lambda s: s[0][u, w])) / (py.THETA + n) + own * p if c else own * p

    def score(self, text):
        w = [None, *words(text)]
        return sum(log10(self.probability(*p)) for p in zip(w, w[1:]))


def test_scores_equal_those_of_a_plain_sampler(spark):
    rng = np.random.default_rng(3)
    every = [f"w{int(x)}" for x in rng.zipf(1.3, 4000) if x < 400]
    rows = [(i, " ".join(every[i * 25 : i * 25 + 25])) for i in range(120)] + [(900, None), (901, "never seen here w1 w2 never seen")]
    model = Plain([t for i, t in rows if not held(i)])
    want = {i: model.score(t) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in ({}, {"words": 40, "pairs": 30}, {"words": 5, "pairs": 0}, {"words": 0}):
        got = check(df, **most)
        assert all(abs(got[i].score - s) < 1e-6 * max(1, abs(s)) for i, s in want.items()), most


def test_words_have_hashes_of_their_own():
    rng = np.random.default_rng(0)
    texts = ["", " \t", "One tWo\nthree", "é" * 300 + " x\x0by", "z" * 600_000 + " a " + "Z" * 600_000, "b " * 300_000]
    texts += ["".join(map(chr, rng.choice([32, 9, 13, 65, 97, 66, 98, 233, 0x4E2D], 3000))) for _ in range(20)]
    h, n = py._word_hashes(pa.array(["skipped", *texts]).cast(pa.binary()).slice(1))
    want = [words(t)[:-1] for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    of = dict(zip(flat, h.tolist()))
    assert [of[w] for w in flat] == h.tolist() and len(set(of.values())) == len(of)
    assert key("one") == of["one"] and key(None) not in of.values()
    many = [f"{a}{b}".encode() for a in "abcdefghij" for b in range(30_000)]
    assert len(set(py._hashes(many).tolist())) == len(many)


def test_probabilities_sum_to_one():
    model = Plain([f"the cat sat on the mat the {x} of the {y}" for x, y in zip("abcdefghij" * 5, "klmno" * 10)])
    for u in model.n:
        total = sum(model.probability(u, w) for w in model.n) + model.probability(u, "unseen word")
        assert abs(total - 1) < 0.02, (u, total)  # averages of products, against products of averages
    assert set(model.n) == {u for u, _ in model.c}  # every observed word is a context


def test_base_is_exact_and_the_model_beats_it(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    small = check(df, words=3000, pairs=500)
    large = check(df)
    assert all(abs(small[i].score - large[i].score) < 1e-6 * abs(large[i].score) + 1e-6 for i in large)
    unseen = [r for i, r in large.items() if held(i)]
    gain = sum(r.score - r.base_score for r in unseen) / sum(r.n_tokens for r in unseen)
    print("gain a token on held-out documents", gain)
    assert gain > 0.3


def test_seating_matches_the_process(spark):
    rng = np.random.default_rng(1)
    c, a, d = 400, 3.0, 0.4

    def simulate():
        t = 1
        for n in range(1, c):
            t += rng.random() < a / (a + n - d * t)
        return t

    want = np.mean([simulate() for _ in range(2000)])
    key = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    got = py.seat(np.full(4000, c), np.full(4000, a), d, key, 0)
    assert abs(got.mean() - want) < 0.25 and got.min() >= 1 and got.max() <= c


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One one"), (4, "One one"), (None, "null id"), (5, "é" * 9000 + " x\x00y " + "w " * 70_000), (9, "held out? maybe")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("uid", F.lit("x")).withColumn("c", F.lit(0))
    check(df)
    check(df, words=0)
    none = py.scores(df, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
    assert py.scores(df.limit(0), F.lit(True)).count() == 0
