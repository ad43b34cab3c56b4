"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written and read again.
All stages but the last return the columns of ``documents`` and only drop rows (the first also sets ``lang``); each is fitted on what its predecessor kept.
Rows without an id are kept apart from others as any other row; repeated rows are near-duplicates of each other, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import decontaminate, langid, near_copies, packing, quality, simhash
from rillflow.llm.common import carried, discard, scratch, store, tidy_shuffles


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the recognised language as their ``lang``; those that are null or without a letter go. If no row is labelled, ``lang`` stays."""
    found = langid.predict(docs, F.lit(True), carry=True, unlabelled="").where("lang_pred <> 'und'")
    lang = F.when(F.col("lang_pred") == "", F.col("_row.lang")).otherwise(F.col("lang_pred"))
    return found.select(F.col("_row").withField("lang", lang).alias("_row")).select("_row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their language and source."""
    rows = quality.measured(carried(docs), "_row.text")
    return quality.judged(rows, "_row.lang", "_row.source", cut_rows=store).where("_kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least id, or of its copies any one."""
    return simhash.representatives(docs)


def near_dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a five-word similarity of 0.8 or more, found exactly."""
    return near_copies.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items, carry=True, lists=False).where("n_hit = 0").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: a row for each piece of a document."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The same with the exact near-duplicate stage; the tests fix the stages above to SimHash links alone.
STAGES_FIVE_WORDS = [*STAGES[:3], ("exact near-dedup", near_dedup_exact), *STAGES[3:]]

#: Kernel classifiers, fingerprints and tokenizers are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages=STAGES) -> DataFrame:
    """All stages over the documents table, each one's rows written to the shared folder for the next; a stage's rows, and what it stored on the way, go once the next has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in stages[:-1]:
        with tidy_shuffles(spark), scratch() as keep:
            kept = keep(store(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = kept
    return stages[-1][1](spark, docs, sf_dir)
