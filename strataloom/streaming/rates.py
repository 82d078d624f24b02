"""The windowed rate as a stream: the batch expression behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.telemetry import rate


def stream_rate(events: DataFrame, time: str, by: list[str], minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """rate() over a streaming table; rows later than `late` behind the newest are dropped, as
    append and update mode do."""
    return rate(events.withWatermark(time, late), time, by, minutes)


def run_once(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Reads what is there into a table under `place` (of the shared store) and stops; the table's rows.

    In update mode the watermark drops the state of old windows. Each micro-batch writes the rows that it changed as a
    folder of its own, so a repeated batch replaces itself; of a key the row of the last batch counts."""
    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")

    df.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = df.sparkSession.read.schema(schema).option("basePath", f"{place}/rows").parquet(f"{place}/rows/batch=*")
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*df.columns)


def file_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """New Parquet files of a folder whose name fits the pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
