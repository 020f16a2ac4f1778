"""The operators' queries at production parameters, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, lm, neardup, packing, quality, rules, search, toxicity, urls
from ._job import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents", spread=True), check=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return lm.score(docs, lm.train(docs), per_token=True)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", spread=True))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return langid.identify(docs, langid.train(docs))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages", spread=True))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents", spread=True))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(rules.ledger(table(spark, sf_dir, "documents", spread=True)))


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablate(rules.ledger(table(spark, sf_dir, "documents", spread=True)))


_ALL = (
    op1_quality_classifier, op2_byte_bpe, op3_toxicity, op4_lm_scoring, op5_exact_top_k, op6_best_fit_packing, op7_language_id, op8_url_filters,
    op9_minhash_near_dedup, op10_quality_rules, quality_rules_ablation,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op5_exact_top_k": search.SQL, "op8_url_filters": urls.SQL, "op10_quality_rules": rules.SQL, "quality_rules_ablation": rules.ABLATION_SQL}
