"""Query of problem 6: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.byte_bpe import encode_column
from strataloom.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of every document, by byte_bpe_50k without special tokens."""
    return encode_column(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
