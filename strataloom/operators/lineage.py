"""Provenance: where a vector comes from, what a document led to, what is stale, what is orphaned.

Inputs are catalog tables with one row for each key. The model and strategy tables are configuration of a few rows; they
are broadcast below MOST_CONFIG rows and joined by shuffle beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CONFIG = 10_000


def config(df: DataFrame) -> DataFrame:
    """A small table hinted for broadcast once its size is known to be small."""
    return F.broadcast(df) if df.limit(MOST_CONFIG + 1).count() <= MOST_CONFIG else df


def backward(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, models: DataFrame) -> DataFrame:
    """Every vector with its model, chunk and document; pii_masked_flag is true if any of the three says so."""
    v = vectors.select("vector_id", "chunk_id", "model_name", "model_version", "collection_name", "active", F.col("pii_masked_flag").alias("__v"))
    c = chunks.select("chunk_id", "doc_id", "doc_version", "chunk_index", "chunk_hash", "strategy_name", "strategy_version", F.col("pii_masked_flag").alias("__c"))
    d = documents.select("doc_id", "doc_version", "title", "content_hash", F.col("pii_masked_flag").alias("__d"))
    m = config(models.select("model_name", "model_version", "provider", "dimensions"))
    joined = v.join(m, ["model_name", "model_version"]).join(c, "chunk_id").join(d, ["doc_id", "doc_version"])
    return joined.select("vector_id", "collection_name", "active", "model_name", "model_version", "provider", "dimensions", "chunk_id", "chunk_index", "chunk_hash", "strategy_name", "strategy_version", "doc_id", "doc_version", "title", "content_hash", (F.col("__v") | F.col("__c") | F.col("__d")).alias("pii_masked_flag"))


def forward(vectors: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Every document with its chunks in order, each with its vectors by id; missing children are empty lists.

    Flags of documents and chunks are their own, those of vectors are true if any level's is. Vectors are gathered by
    chunk before chunks are gathered by document, so each list is as long as one parent's children."""
    doc = documents.select("doc_id", "doc_version", "title", F.col("pii_masked_flag").alias("document_flag"))
    c = chunks.select("chunk_id", "doc_id", "doc_version", "chunk_index", "strategy_name", "strategy_version", F.col("pii_masked_flag").alias("chunk_flag"))
    v = vectors.select("vector_id", "chunk_id", "model_name", "model_version", "active", F.col("pii_masked_flag").alias("__v"))
    rows = v.join(c.select("chunk_id", "doc_id", "doc_version", "chunk_flag"), "chunk_id").join(doc.select("doc_id", "doc_version", "document_flag"), ["doc_id", "doc_version"])
    vector = F.struct("vector_id", "model_name", "model_version", "active", (F.col("__v") | F.col("chunk_flag") | F.col("document_flag")).alias("pii_masked_flag"))
    by_chunk = rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(vector)).alias("vectors"))
    full = c.join(by_chunk, "chunk_id", "left").withColumn("vectors", F.coalesce("vectors", F.array().cast(by_chunk.schema["vectors"].dataType)))
    chunk = F.struct("chunk_index", "chunk_id", "strategy_name", "strategy_version", F.col("chunk_flag").alias("pii_masked_flag"), "vectors")
    by_doc = full.groupBy("doc_id", "doc_version").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    out = doc.withColumnRenamed("document_flag", "pii_masked_flag").join(by_doc, ["doc_id", "doc_version"], "left")
    return out.withColumn("chunks", F.coalesce("chunks", F.array().cast(by_doc.schema["chunks"].dataType)))


def vector_provenance(lineage: DataFrame, vector_id: str) -> dict:
    """One row of backward() as a dictionary; KeyError if there is none."""
    rows = lineage.filter(F.col("vector_id") == vector_id).limit(1).collect()
    if not rows:
        raise KeyError(f"no vector {vector_id}")
    return rows[0].asDict(recursive=True)


def orphans(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, models: DataFrame) -> DataFrame:
    """(missing, n): vectors without chunk, document or model."""
    marked = (
        vectors.select("vector_id", "chunk_id", "model_name", "model_version")
        .join(chunks.select("chunk_id", "doc_id", "doc_version", F.lit(True).alias("c")), "chunk_id", "left")
        .join(documents.select("doc_id", "doc_version", F.lit(True).alias("d")), ["doc_id", "doc_version"], "left")
        .join(config(models.select("model_name", "model_version", F.lit(True).alias("m"))), ["model_name", "model_version"], "left")
        .agg(F.count_if(F.col("c").isNull()).alias("chunk"), F.count_if(F.col("d").isNull()).alias("document"), F.count_if(F.col("m").isNull()).alias("model"))
    )
    return marked.unpivot([], ["chunk", "document", "model"], "missing", "n")


def latest_strategy(strategies: DataFrame) -> DataFrame:
    """The strategy created last; of several, the one with the largest version as text."""
    return strategies.select("strategy_name", "strategy_version", "created_at").orderBy(F.desc("created_at"), F.desc("strategy_version"), "strategy_name").limit(1)


def stale_by_version(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, model_version: str, strategy_version: str | None = None, strategies: DataFrame | None = None) -> DataFrame:
    """vector_id of vectors of another model version or strategy version, whatever their model's name; inactive ones too."""
    if strategy_version is None:
        rows = latest_strategy(strategies).collect() if strategies is not None else []
        strategy_version = rows[0].strategy_version if rows else ""
    joined = vectors.join(chunks.select("chunk_id", "doc_id", "doc_version", "strategy_version"), "chunk_id").join(documents.select("doc_id", "doc_version"), ["doc_id", "doc_version"], "left_semi")
    return joined.filter((F.col("model_version") != model_version) | (F.col("strategy_version") != strategy_version)).select("vector_id")


def stale_breakdown(vectors: DataFrame, chunks: DataFrame, model_name: str, model_version: str, strategies: DataFrame) -> DataFrame:
    """(model_version, stale, total, stale_percent): stale by name, version or, if there is one, the latest strategy's version."""
    rows = latest_strategy(strategies).collect()
    stale = (F.col("model_name") != model_name) | (F.col("model_version") != model_version)
    if rows:
        stale = stale | (F.col("strategy_version") != rows[0].strategy_version)
    joined = vectors.join(chunks.select("chunk_id", "strategy_version"), "chunk_id")
    counts = joined.groupBy("model_version").agg(F.count_if(stale).alias("stale"), F.count("*").alias("total"))
    return counts.withColumn("stale_percent", F.round(100.0 * F.col("stale") / F.col("total"), 6))


def active_flags(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, active, stale): counts by model and by strategy in one namespace, where equal names add up."""
    n = [F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("stale")]
    models = vectors.groupBy(F.col("model_name").alias("name")).agg(*n)
    strategies = vectors.join(chunks.select("chunk_id", "strategy_name"), "chunk_id").groupBy(F.col("strategy_name").alias("name")).agg(*n)
    return models.unionByName(strategies).groupBy("name").agg(F.sum("active").alias("active"), F.sum("stale").alias("stale"))
