"""From raw documents to packed training sequences: toxicity, language, near duplicates, packing; each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textruns.llm import langid, neardup, packing, toxicity
from textruns.llm._job import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the model's severity cut. The model is fitted on the labelled documents that this stage is given.

    NULL and empty texts have the severity of the bias and stay, as do NULL ids; repeated rows are decided alike; a severity equal to the cut goes. Without labelled
    documents of both classes all stay. No documents, no rows.
    """
    return toxicity.filter_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with calibrated confidence.

    NULL and empty texts, and those without letters, go; NULL ids stay if their text does; repeated rows are decided alike; a NULL lang is only left out of the
    fit. Without any lang all documents go. No documents, no rows.
    """
    return langid.filter_language(docs, langid.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near duplicates.

    Texts without words and NULL ids are in no group and stay; of rows that repeat a doc_id the one with the smallest text stays. No documents, no rows.
    """
    return neardup.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents, cut to the capacity, by best-two-fit.

    Texts without words stand in no bin; NULL ids and repeated rows are packed like others; of pieces of one length the smallest (doc_id, start) goes first. No
    documents, no bins.
    """
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("language_id", known_language), ("near_dedup", one_of_each_group), ("packing", packed)]

#: Fitted models, signatures and greedy bins have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
