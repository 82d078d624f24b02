"""Lineage events with a vector-dataset facet, and the facet's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalars import uuid5_url

#: Fixed values of the facet.
METRICS = ("Cosine", "Dot", "Euclidean")
REQUIRED = ("model_name", "model_version", "dimension", "strategy_name", "strategy_version", "chunk_size_tokens")


def facet_errors(df: DataFrame) -> DataFrame:
    """df with facet_errors, the rules that its facet columns break."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"required:{c}")) for c in REQUIRED]
    metric = F.when(F.col("distance_metric").isNotNull() & ~F.col("distance_metric").isin(*METRICS), F.lit("enum:distance_metric"))
    sizes = [F.when(F.col(c) < 1, F.lit(f"minimum:{c}")) for c in ("dimension", "chunk_size_tokens")]
    return df.withColumn("facet_errors", F.array_compact(F.array(*missing, metric, *sizes)))


def batch_events(batches: DataFrame, producer: str = "urn:strataloom", source: str = "corpus", run: str = "batch") -> DataFrame:
    """START and COMPLETE events of embedding batches (collection_name, batch_no, facet columns, rows); run names what numbers the batches."""
    run_id = uuid5_url(F.concat_ws(":", F.lit(run), "collection_name", F.col("batch_no").cast("string")))
    facet = F.struct("model_name", "model_version", "dimension", "distance_metric", "strategy_name", "strategy_version", "chunk_size_tokens")
    kinds = batches.withColumn("event_type", F.explode(F.array(F.lit("START"), F.lit("COMPLETE"))))
    event = F.struct(
        F.col("event_type").alias("eventType"), F.struct(run_id.alias("runId")).alias("run"), F.struct(F.lit("strataloom").alias("namespace"), F.concat(F.lit("embed_"), F.col("collection_name")).alias("name")).alias("job"),
        F.array(F.struct(F.lit(source).alias("name"))).alias("inputs"), F.array(F.struct(F.concat(F.lit("vectors_"), F.col("collection_name")).alias("name"), F.struct(facet.alias("vectorEmbedding")).alias("facets"))).alias("outputs"), F.lit(producer).alias("producer"))
    return kinds.select(run_id.alias("run_id"), "event_type", "collection_name", "batch_no", F.to_json(event).alias("event"))
