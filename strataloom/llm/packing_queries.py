"""Query of problem 7: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.packing import pack_texts
from strataloom.sources.tables import table


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, piece_no, start, n_tokens and container_id of every document or, beyond the capacity, of its pieces."""
    return pack_texts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p7_containers": p7_containers}
