"""Session construction and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "strataloom", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; conf adds to or overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting, else (tests, one machine) a local one."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    else:
        if not re.match(r"local($|\[)", context.master):  # local-cluster too has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
        folder = os.path.join(tempfile.gettempdir(), "strataloom-checkpoints")
        os.makedirs(folder, exist_ok=True)
        context.setCheckpointDir("file://" + folder)
    return context._jsc.sc().getCheckpointDir().get()


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or fewer for small data, but eight at least."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(8, -(-rows // rows_each)))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever their working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads on from there; losing an executor recomputes nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget_at_exit(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def write_shared(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the shared folder: as cut_lineage, but columns can be read apart, and it is smaller."""
    spark = df.sparkSession
    path = forget_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
