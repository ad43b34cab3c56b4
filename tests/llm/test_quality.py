import re
from collections import Counter

from pyspark.sql import functions as F

from rillflow.llm import quality


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice), failed)


def test_counts_match_brute_force_and_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_counts(docs).collect()}
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {k: v[:6] for k, v in got.items()} == want
    assert not any(v[5] and v[6] for v in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    passed = {k: v[6] for k, v in got.items() if not v[5] and k in labels}
    good, bad = ([kept for k, kept in passed.items() if labels[k] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark):
    rep = " ".join(f"w{i % 9}" for i in range(3000))
    texts = [None, "", " \n\t", "a\x0bb\x0cc\rd  e\n\n a b\na b", rep, "é" * 50_000, "x y\nx y\n\nx y ", "## |<> $%& *", "w " * 8, "w " * 9, "w " * 40]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("_m_", F.lit(1)).withColumn("n", F.lit(2)).withColumn("k_lang", F.lit(3))
    got = quality.quality_counts(docs).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert tuple(r)[1:7] == plain(texts[r.doc_id]), r
    assert quality.quality_counts(docs.limit(0)).count() == 0
