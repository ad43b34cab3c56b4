import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rillflow.llm import kdshard


def check(docs, n, slack):
    rows = kdshard.shards(docs, n).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(n))
    even, largest = sum(sizes.values()) / n, max(r.size for r in rows)
    assert all(abs(sizes[s] - even) <= slack * largest for s in range(n))


def test_shards_are_nearly_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    check(docs, 40, 3)
    check(docs, 7, 3)


def test_ties_and_odd_rows(spark):
    rows = [(i % 400, "same text", "s", "en") for i in range(800)] + [(None, None, None, None), (None, "", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs = docs.withColumn("size", F.lit("clash")).withColumn("_node", F.lit(1))
    check(docs, 8, 4)
    check(docs.limit(1), 4, 5)
    assert kdshard.shards(docs.limit(0), 4).count() == 0
    assert kdshard.shards(docs, target_bytes=5000).select("shard").distinct().count() >= 4


def test_few_groups_of_equal_texts_are_cut(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kdshard.shards(docs, 40).select("doc_id", "shard").join(docs.select("doc_id", "text"), "doc_id")
    groups = got.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).where("n > 1").collect()
    cut = [g for g in groups if g.shards > 1]
    print(len(groups), "groups of copies,", len(cut), "in several shards")
    assert groups and len(cut) <= 39
