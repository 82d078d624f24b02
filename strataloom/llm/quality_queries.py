"""Queries of problem 8: text statistics, and the documents that are no prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.quality import not_prose, scored_texts
from strataloom.sources.tables import table


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, tail probabilities and outlier score of every document."""
    return scored_texts(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and kind of the documents that are outliers by their tail probabilities and for the larger part no prose."""
    return not_prose(p8_statistics(spark, folder)).select("doc_id", "kind")


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}
