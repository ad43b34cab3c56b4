import zlib

from pyspark.sql import functions as F

from rillflow.llm import langid
from rillflow.llm.common import crc_mod


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op4_query(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.98 * len(held)


def test_kernel_is_what_the_folded_matrix_scores(spark):
    import numpy as np

    texts = ["der die das und", "the and that", "les des une", "la el los", "the dog and the cat"]
    masks = [langid.presence(t) for t in texts]
    k = np.array([[(a & b).sum() / np.sqrt(a.sum() * b.sum()) for b in masks] for a in masks])
    assert np.allclose(np.diag(k), 1)
    model = langid.fit([np.packbits(m).tobytes() for m in masks], ["de", "en", "fr", "es", "en"], landmarks=5, ridge=1e-6)
    assert [model.languages[i] for i in model.scores(masks).argmax(axis=1)] == ["de", "en", "fr", "es", "en"]


def test_odd_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate([None, "", "123 ... 9", "the the", "x" * 3_000_000, "Ωμέγα 文字"])]
    rows += [(20 + i, "die der und keit", "de") for i in range(8)] + [(40, "the and", None), (None, "the and", "en"), (3, "the the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    got = langid.predict(docs, crc_mod("doc_id", 4) != 2).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in got} <= {"und", "en", "de"} and all(0 <= r.score <= 1 for r in got)
    none = langid.predict(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predict(docs.limit(0), F.lit(True)).count() == 0
