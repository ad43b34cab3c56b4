import zlib

import numpy as np
from pyspark.sql import functions as F

from rillflow.llm import toxicity


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op8_query(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].score, t) for k, t in labels.items() if got[k].held_out]
    score, truth = np.array(held).T
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    auc = (rank[truth == 1].mean() - (truth.sum() - 1) / 2) / (truth == 0).sum()
    print("auc", auc, "recall", (score[truth == 1] >= 0.5).mean(), "false alarms", (score[truth == 0] >= 0.5).mean())
    assert auc > 0.9 and (score[truth == 0] >= 0.5).mean() < 0.02 and (score[truth == 1] >= 0.5).mean() > 0.8


def test_sparse_and_whole(spark):
    rows = [(toxicity.features(b"fine words " * 3 + (b"awful" if i % 2 else b"nice")), i % 2) for i in range(200)]
    model = toxicity.fit(rows)
    assert 0 < len(model.index) <= 12
    assert model.score(b"fine words awful") > 0.5 > model.score(b"fine words nice")
    long = b"nothing at all " * 70_000
    assert model.score(long + b" awful") > model.score(long)  # the end of a long text counts


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "awful awful"), (4, "awful awful"), (None, "awful")] + [(10 + i, "nice day" if i % 2 else "awful day") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(10 + i, 1 - i % 2) for i in range(60)] + [(10, 1), (None, 1), (11, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
