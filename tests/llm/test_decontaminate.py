import hashlib
import re

from pyspark.sql import functions as F

from rillflow.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=10):
    w, hit, found, places = words(text), set(), set(), {}
    for item_id, item in items:
        x = words(item)
        for at in range(max(1, len(x) - window + 1)) if x else ():
            part = tuple(x[at : at + window])
            n = len(part)
            if n not in places:
                places[n] = {}
                for s in range(len(w) - n + 1):
                    places[n].setdefault(tuple(w[s : s + n]), []).append(s)
            for s in places[n].get(part, ()):
                hit.update(range(s, s + n))
                found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **more):
    texts = [(i.item_id, i.text) for i in items.collect()]
    want = sorted((r.doc_id, *plain(r.text, [(i.item_id, i.text) for i in items.collect()])) for r in docs.collect())
    got = sorted(map(tuple, d.digest(d.contamination(docs, items, **more)).collect()))
    assert got == want
    assert sorted(map(tuple, d.digest(d.contamination(docs, items, lists=False, **more)).collect())) == want
    return got


def test_documents_match_brute_force_in_one_block_and_in_many(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = check(spark, docs, items)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    check(spark, docs, items, block_bytes=4000)


def test_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "one"), (2, "two three"), (3, "a a a a a a a a a a a a"), (4, None), (5, "..."), (10, "ONE"), (6, "é ü 10 x")],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit("clash"))
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "One, two-three; one"), (4, "a " * 9), (5, "a " * 5000), (5, "a " * 5000), (6, "b É Ü Ü 10 x")]
        + [(7, "b é ü 10 x")],
        "doc_id long, text string",
    ).withColumn("item_id", F.lit(0)).withColumn("n", F.lit(0))
    for size in (8 << 20, 5):
        check(spark, docs, items, block_bytes=size)
    check(spark, docs, items.limit(0))
    assert d.contamination(docs.limit(0), items).count() == 0


def test_many_items_share_a_passage_and_one_is_long(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"head {i} " + passage) for i in range(2000)] + [(5000, " ".join(f"long{i}" for i in range(60_000)))]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{passage} tail {i}") for i in range(300)] + [(900, " ".join(f"long{i}" for i in range(300, 400)))], "doc_id long, text string")
    got = {r.doc_id: r for r in d.digest(d.contamination(docs, items, lists=False)).collect()}
    ids = ",".join(sorted(str(i) for i in range(2000)))
    assert all(r.n_hit == 14 and r.n_items == 2000 and r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest() for i, r in got.items() if i < 300)
    assert (got[900].n_hit, got[900].n_items) == (100, 1)
