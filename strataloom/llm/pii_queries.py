"""Queries of problem 5: personal information in records and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.pii import find_types, mask_texts
from strataloom.sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables' texts under one key."""
    records = table(spark, folder, "document_records").select(F.struct(F.lit("document_records").alias("source_table"), F.concat("doc_id", F.lit("#"), F.col("doc_version").cast("string")).alias("record_key")).alias("item"), F.col("text"))
    chunks = table(spark, folder, "chunks").select(F.struct(F.lit("chunks").alias("source_table"), F.col("chunk_id").alias("record_key")).alias("item"), F.col("chunk_text").alias("text"))
    return records.unionByName(chunks)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """source_table, record_key and pii_type of what texts contain in the clear."""
    return find_types(_texts(spark, folder), table(spark, folder, "name_parts"), "item", "text").select("item.source_table", "item.record_key", "pii_type")


def p5_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders for personal information."""
    return mask_texts(_texts(spark, folder), table(spark, folder, "name_parts"), "item", "text").select("item.source_table", "item.record_key", "masked_text", F.to_json("pii_counts").alias("pii_counts"))


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked}
