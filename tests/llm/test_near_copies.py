import random
from itertools import combinations

import corpus_pipeline
from rillflow.llm import near_copies
from tests.llm.test_ngram_join import plain

SCHEMA = "doc_id long, text string, id string, key string, many string"


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in rows], SCHEMA)
    out = near_copies.representatives(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_one_row_of_each_class_stays(spark):
    rng, rows = random.Random(2), []
    for g in range(8):
        base = [f"g{g}_{i}" for i in range(60)]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    want = {c for _, _, c in plain(rows)}
    assert {i for i, _ in kept(spark, rows)} == want and len(want) < len(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "only without an id here now"), (None, "only without an id here now"), (9, None), (8, ""), (7, " \n"), (1, long), (2, long + " end"), (3, "short one"), (3, "another short")]
    assert kept(spark, rows) == sorted([(4, "a b c d e f"), (None, "only without an id here now"), (7, " \n"), (1, long), (3, "short one"), (3, "another short")], key=str)
    assert kept(spark, []) == []


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_against_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sets = {r.doc_id: five_words(r.text) for r in docs.collect()}
    least = {i: i for i in sets}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any(sets[a] != sets[b] for a, b in pairs)  # some are no exact copies
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = corpus_pipeline.near_dedup_exact(spark, docs, d)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(least.values()))
    assert near_copies.representatives(docs.limit(0)).count() == 0
