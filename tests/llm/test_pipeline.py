from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import packing
from tests.llm import test_decontaminate, test_quality, test_simhash
from tests.llm.test_packing import plain_ids


def test_stages_against_plain_versions(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    frames = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        frames.append(docs)
    source = spark.read.parquet(f"{d}/documents.parquet")
    assert all(f.columns == source.columns for f in frames[:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in [source, *frames[:-1]]]
    assert set(rows[1]) == {i for i, r in rows[0].items() if r.text and any(c.isalpha() for c in r.text)}
    failed = {i for i, r in rows[1].items() if test_quality.plain(r.text)[5]}
    assert failed <= set(rows[1]) - set(rows[2])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert not [i for i in set(rows[1]) - set(rows[2]) - failed if labels.get(i) == 1]
    classes = test_simhash.plain_classes({i: test_simhash.plain_fingerprint(r.text) for i, r in rows[2].items()})
    assert set(rows[3]) == set(classes.values())
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert set(rows[4]) == {i for i, r in rows[3].items() if not test_decontaminate.plain(r.text, items)[-1]}
    pieces = Counter((r.doc_id, r.length) for r in frames[-1].collect())
    assert pieces == Counter((i, length) for i, r in rows[4].items() for _, length in packing.cuts(len(plain_ids(r.text)), 1024))
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, d).collect()} == {tuple(r)[:5] for r in frames[-1].collect()}


def test_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(400))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, long, None, None, 9), (None, long, None, None, 9), (4, long + " x", "en", None, 1), (4, long + " x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("_row", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("score", F.lit(2)).withColumn("body", F.lit(3)).withColumn("_m_", F.lit(4))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert stage(spark, docs.limit(0), d).count() == 0
    assert 1 <= docs.count() <= 2


def test_the_prediction_is_the_language_of_kept_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    blank = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    kept = corpus_pipeline.language(spark, blank, d)
    assert kept.where("lang IS NULL").count() == 0 and kept.where("doc_id % 4 = 0").count() > 0
    letters = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), d).collect()} == letters
