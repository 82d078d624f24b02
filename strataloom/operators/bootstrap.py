"""From raw corpus to governed documents, chunks and vectors in one plan with several sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.catalog import Catalog, missing_rows
from strataloom.operators.chunking import ChunkStrategy, chunk_documents
from strataloom.operators.contract import DocumentContract, split
from strataloom.operators.migration import embed_chunks
from strataloom.operators.numbering import numbered
from strataloom.operators.sanitize import sanitize_documents
from strataloom.session import cut_lineage, write_shared


@dataclass
class Report:
    valid: int
    invalid: int
    chunks: int
    vectors: int


def document_rows(sanitized: DataFrame) -> DataFrame:
    """Catalog rows of sanitized documents; the hash is that of the sanitized text."""
    return sanitized.select("doc_id", F.lit(1).alias("doc_version"), "title", "metadata.source_uri", "metadata.author", "metadata.classification_level", "metadata.language", F.sha2("text", 256).alias("content_hash"), "pii_masked_flag")


def vector_rows(chunks: DataFrame, model_name: str, model_version: str, collection: str, dimensions: int) -> DataFrame:
    """Catalog rows of vectors, numbered vec_0001 onwards in the order of document and chunk.

    Numbers come from sorted partitions and their offsets, so no task sees all rows."""
    rows = numbered(chunks.select("doc_id", "chunk_index", "chunk_id", "pii_masked_flag"), ["doc_id", "chunk_index", "chunk_id"])
    number = F.col("row_no")
    vec = F.concat(F.lit("vec_"), F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string")))
    return rows.select(
        vec.alias("vector_id"), "chunk_id", F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"), F.lit(collection).alias("collection_name"), F.lit(dimensions).alias("dimension"), "pii_masked_flag")


def run(records: DataFrame, catalog: Catalog, strategy: ChunkStrategy, model_name: str, model_version: str, collection: str, embed, dimensions: int, contract: DocumentContract = DocumentContract()) -> tuple[Report, DataFrame]:
    """Validates, sanitizes, chunks, embeds and then fills the catalog in one transaction; only rows the catalog lacks are added."""
    valid, invalid = split(records, contract)
    documents = cut_lineage(sanitize_documents(valid))
    chunks = cut_lineage(chunk_documents(documents.withColumn("doc_version", F.lit(1)), strategy))
    spark = records.sparkSession
    vectors = write_shared(embed_chunks(chunks, embed, dimensions))  # before any row says that they are there
    with catalog.transaction():
        if missing_rows(spark.createDataFrame([(strategy.strategy_name, strategy.version)], "strategy_name string, strategy_version string"), catalog.table("chunk_strategies"), ["strategy_name", "strategy_version"]).count():
            catalog.insert("chunk_strategies", spark.createDataFrame([(strategy.strategy_name, strategy.version, strategy.splitter_type, strategy.chunk_size_tokens, strategy.chunk_overlap_tokens, strategy.tokenizer)], "strategy_name string, strategy_version string, splitter_type string, chunk_size_tokens int, chunk_overlap_tokens int, tokenizer_name string"))
        if missing_rows(spark.createDataFrame([(model_name, model_version)], "model_name string, model_version string"), catalog.table("embedding_models"), ["model_name", "model_version"]).count():
            catalog.insert("embedding_models", spark.createDataFrame([(model_name, model_version, "local", dimensions)], "model_name string, model_version string, provider string, dimensions int"))
        catalog.insert("documents", missing_rows(document_rows(documents), catalog.table("documents"), ["doc_id", "doc_version"]))
        catalog.insert("chunks", missing_rows(chunks.drop("token_start", "n_tokens"), catalog.table("chunks"), ["chunk_id"]))
        own = catalog.table("vectors").filter(F.col("collection_name") == collection)
        new = missing_rows(vector_rows(chunks, model_name, model_version, collection, dimensions), own, ["chunk_id"])
        added = catalog.insert("vectors", new)
    return Report(documents.count(), invalid.count(), chunks.count(), added), vectors
