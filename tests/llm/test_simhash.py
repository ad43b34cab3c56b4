import random
import re

import xxhash
from pyspark.sql import functions as F

from rillflow.llm import simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == fps
    assert {k: v[1] for k, v in got.items()} == plain_classes(fps)


def test_dense_groups_link_the_same_by_points_and_by_pairs(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(40, 52), rng.randint(0, 4))) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    for limit in (0, 8, 10_000):
        edges = simhash.links(df, limit).collect()
        assert all(bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= 4 for e in edges)
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        want = plain_classes({f[0]: f[0] & (1 << 64) - 1 for f in signed})
        assert {f: roots.get(f, f) for (f,) in signed} == want


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One TWO", "d"), (4, "One TWO", "d"), (None, "one two", "e"),
            (6, "É é " * 40_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("x"))
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert len(got) == 7
    assert [r[2] for r in got if r[0] in (1, 2, 3)] == [1, 1, 1] and [r[1] for r in got if r[0] == 2] == [0]
    assert {r[2] for r in got if r[0] in (4, None)} == {4}
    assert next(r[1] for r in got if r[0] == 6) & (1 << 64) - 1 == plain_fingerprint("É é " * 40_000)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
