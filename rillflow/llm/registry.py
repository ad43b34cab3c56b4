"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import decontaminate, extract, kdshard, langid, licenses, ngram_join, oracles, packing, panes, pitman_yor, prefix_trie, quality, simhash, toxicity

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.op1_query,
    "op2_license_scan": licenses.op2_query,
    "op3_benchmark_decontamination": decontaminate.op3_query,
    "op4_language_id": langid.op4_query,
    "op5_best_fit_packing": packing.op5_query,
    "op6_html_extraction": extract.op6_query,
    "op7_quality_rules": quality.op7_query,
    "op8_toxicity": toxicity.op8_query,
    "op9_lm_scoring": pitman_yor.op9_query,
    "op10_kd_tree_sharding": kdshard.op10_query,
    "op11_window_panes": panes.op11_query,
    "op12_ngram_jaccard_join": ngram_join.op12_query,
    "op13_prefix_trie": prefix_trie.op13_query,
}
_ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.licenses(),
    "op3_benchmark_decontamination": oracles.decontamination(),
    "op7_quality_rules": oracles.quality(),
    "op11_window_panes": oracles.panes(),
    "op12_ngram_jaccard_join": oracles.jaccard_join(),
    "op13_prefix_trie": oracles.trie(),
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _pipeline_five_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir, corpus_pipeline.STAGES_FIVE_WORDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | {"pipeline": _pipeline, "pipeline_five_words": _pipeline_five_words}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
