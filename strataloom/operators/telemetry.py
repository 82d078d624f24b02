"""Request telemetry: counters, gauges, cumulative histograms, bucket quantiles and windowed rates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the histograms.
SEARCH_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
HTTP_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
SHADOW_BUCKETS = (-1.0, -0.1, -0.01, 0.0, 0.01, 0.1, 1.0)


def histogram(df: DataFrame, value: Column, by: list, bounds: tuple[float, ...]) -> DataFrame:
    """(by, le, n): how many values are at most each bound, the last bound being infinite; one pass, nulls left out."""
    groups = [F.col(b) if isinstance(b, str) else b for b in by]
    names = [f"b{i}" for i in range(len(bounds) + 1)]
    sums = df.filter(value.isNotNull()).groupBy(*groups).agg(*(F.count_if(value <= b).alias(n) for b, n in zip(bounds, names)), F.count("*").alias(names[-1]))
    keys = [c for c in sums.columns if c not in names]
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("n")) for b, n in zip((*bounds, float("inf")), names)))
    return sums.select(*keys, F.explode(pairs).alias("h")).select(*keys, "h.le", "h.n")


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, value): the quantile by linear interpolation in its bucket; in the last one, the largest finite bound."""
    order = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    rows = buckets.withColumns({"below": F.coalesce(F.lag("n").over(order), F.lit(0)), "low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "target": q * total})
    hit = rows.filter((F.col("n") >= F.col("target")) & (F.col("below") < F.col("target")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("target") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("value"))


def rate(df: DataFrame, time: str, by: list[str], minutes: int = 1, slide: int | None = None) -> DataFrame:
    """(window_start, by, n, per_second) over windows that tumble or slide; the same expression serves batch and stream."""
    window = F.window(time, f"{minutes} minutes", f"{slide or minutes} minutes")
    counted = df.groupBy(window, *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n", (F.col("n") / (60.0 * minutes)).alias("per_second"))


def last_value(df: DataFrame, time: str, tie: str, value: str, by: list[str]) -> DataFrame:
    """(by, value): each label's gauge, its last value by time, ties by `tie`."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line): metrics (name, labels map, value) in the text exposition format, labels in order."""
    labels = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"'))))
    return metrics.select(F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.concat_ws(",", labels), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))
