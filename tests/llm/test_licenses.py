import re
from math import ceil

from pyspark.sql import functions as F

from rillflow.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text):
    w = words(text)
    phrases, blocks = [], []
    for t in lic.PHRASES:
        p = words(t.text)
        phrases += [(s, t.label) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    for t in lic.NOTICES:
        p = words(t.text)
        need = ceil(t.threshold * len(set(p)) - 1e-9)
        for s in range(0, len(w), len(p)):
            share = len(set(p) & set(w[s : s + 2 * len(p)]))
            if share >= need:
                blocks.append((s, t.label, share / len(set(p))))
    return len(w), sorted(phrases), sorted(blocks)


def check(docs):
    want = sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=str)
    got = sorted(
        (
            (r.doc_id, r.n_words, sorted(zip(r.phrase_starts, r.phrase_labels)), sorted(zip(r.block_starts, r.block_labels, r.block_scores)))
            for r in lic.license_scan(docs).collect()
        ),
        key=str,
    )
    assert got == want
    return got


def test_documents_match_brute_force(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert any(r[2] for r in got)


def test_notices_and_odd_rows(spark):
    texts = [None, "", "...", "MIT License, mit-license CC BY cc  by", "gnu GNU General Public License", "license " * 3000]
    for t in lic.NOTICES:
        w = t.text.split()
        texts += ["x y z " * 30 + t.text + " q" * 80, " ".join(w[: len(w) * 9 // 10]), " ".join(w[: len(w) // 2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = check(docs.union(docs.limit(4)))
    assert {label for r in got for _, label, _ in r[3]} == {t.label for t in lic.NOTICES}
    assert lic.license_scan(docs.limit(0)).count() == 0
