from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import common, ngram_join
from rillflow.llm.registry import queries
from tests.llm import test_decontaminate, test_simhash
from tests.llm.test_near_copies import five_words

D = "/root/testdata/sf0.001"


def test_whole_query_against_plain_classes(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r.text for r in corpus_pipeline.rules(spark, corpus_pipeline.language(spark, docs, D), D).collect()}
    rows = {i: rows[i] for i in set(test_simhash.plain_classes({i: test_simhash.plain_fingerprint(x) for i, x in rows.items()}).values())}
    sets, least = {i: five_words(x) for i, x in rows.items()}, {i: i for i in rows}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = {i for i in set(least.values()) if not test_decontaminate.plain(rows[i], items)[-1]}
    before = set(common._stored)
    got = queries()["pipeline_five_words"](spark, D)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    assert len(set(common._stored) - before) == 1  # of all that the stages stored, only the rows that the last one reads


def test_bytes_of_an_ngram_do_not_grow_with_the_parts(spark):
    texts = spark.range(0, 600, 1, 2).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.concat(F.lit("w"), (F.col("id") * 40 + i).cast("string")))).alias("text"))
    texts = texts.withColumn("key", ngram_join._key())

    def sent(parts):
        names = ("keys", "counts", "owner", "low", "n")
        rows = ngram_join.sent(texts, 5, parts)
        return sum(rows.agg(*(F.coalesce(F.sum(F.length(n)), F.lit(0)) for n in names if n in rows.columns)).first())

    assert sent(8) == sent(800)
    found = {r.id: (r.n, r.met) for r in ngram_join.met(ngram_join.sent(texts, 5, 800), 800).collect()}
    # neighbours have forty words in common, so 36 n-grams on each side
    assert found == {i: (76, 36 if i in (0, 599) else 72) for i in range(600)}
