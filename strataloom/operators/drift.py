"""How an embedding space changed: cosine distributions, neighbourhood overlap, centroid length, and a verdict.

Analyses run on a sample of shared items (a parameter: the operator's own feature); the sample is chosen by the hash of
seed and id, so it is the same wherever it runs. Work within the sample is exact, all pairs, in blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.numbering import exact_percentiles
from strataloom.session import cut_lineage

MOST_SAMPLED = 20_000


def sample_shared(before: DataFrame, after: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(item_id, before, after) of the n shared ids whose hash with the seed is smallest."""
    if not 0 < n <= MOST_SAMPLED:
        raise ValueError(f"a sample holds 1 to {MOST_SAMPLED} items")
    both = before.select("item_id", F.col("vector").alias("before")).join(after.select("item_id", F.col("vector").alias("after")), "item_id")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string")), 256)
    return both.orderBy(h, "item_id").limit(n)


def _matrix(column: pd.Series, name: str) -> np.ndarray:
    if not len(column):
        raise ValueError("no shared items")
    if column.map(len).nunique() != 1 or not len(column.iloc[0]):
        raise ValueError(f"{name} vectors differ in length or are empty")
    x = np.stack(column.to_numpy()).astype(np.float64)
    if not np.isfinite(x).all() or (np.linalg.norm(x, axis=1) == 0).any():
        raise ValueError(f"{name} vectors must be finite and not zero")
    return x


def pair_cosines(sample: DataFrame, column: str) -> DataFrame:
    """(cosine) of each unordered pair of the sample; the rows are spread over tasks, the sample itself is bounded."""
    held = sample.select("item_id", F.col(column).cast("array<double>").alias("v")).orderBy("item_id").toPandas()
    x = _matrix(held["v"], column)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(unit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for i in f["id"]:
                if i + 1 < len(shared.value):
                    yield pd.DataFrame({"cosine": np.round(np.clip(shared.value[i + 1 :] @ shared.value[i], -1, 1), 9)})

    return spark.range(len(unit)).mapInPandas(run, "cosine double")


def distribution(values: DataFrame, column: str, count: str | None = None) -> DataFrame:
    """One row: mean, median, 5th and 95th percentile, population deviation and, if named, the count; of nothing, that of a single 1."""
    held = cut_lineage(values.select(F.col(column).alias("v")))
    stats = held.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))
    shares = {"median": 0.5, "p05": 0.05, "p95": 0.95}
    at = exact_percentiles(held, "v", [], list(shares.values())).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in shares.items()))
    row = stats.crossJoin(at)  # one row each
    return row.select(*(F.coalesce(c, F.lit(1.0 if c != "std" else 0.0)).alias(c) for c in ("mean", "median", "p05", "p95", "std")), *([F.col("n").alias(count)] if count else []))


def neighbour_jaccard(sample: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, jaccard): overlap of an item's k nearest, by cosine, before and after; ties go to the smaller id."""
    if k < 1:
        raise ValueError("k must be positive")
    held = sample.select("item_id", F.col("before").cast("array<double>"), F.col("after").cast("array<double>")).orderBy("item_id").toPandas()
    units = []
    for name in ("before", "after"):
        x = _matrix(held[name], name)
        units.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(units)
    most = min(k, len(held) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        for f in batches:
            out = []
            for i in f["n"]:
                near = []
                for x in (a, b):
                    s = np.round(x @ x[i], 9)
                    s[i] = -np.inf
                    near.append(set(np.lexsort((np.arange(len(s)), -s))[:most].tolist()))
                union = near[0] | near[1]
                out.append(len(near[0] & near[1]) / len(union) if union else 1.0)
            yield pd.DataFrame({"n": f["n"], "jaccard": out})

    numbers = spark.createDataFrame(pd.DataFrame({"n": range(len(held)), "item_id": held["item_id"]}))
    return numbers.select("n").mapInPandas(run, "n bigint, jaccard double").join(numbers, "n").select("item_id", "jaccard")


def centroid_norm(df: DataFrame, column: str = "vector") -> DataFrame:
    """(norm) of the mean of the raw vectors."""
    parts = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return parts.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))


def report(before: DataFrame, after: DataFrame, n: int = 1000, k: int = 10, seed: int = 0, collapse_mean: float = 0.95, collapse_std: float = 0.05, shift: float = 0.10, least_jaccard: float = 0.9) -> DataFrame:
    """One row: sample size, dimensions, both cosine distributions, Jaccard summary, centroid lengths, collapse and shift."""
    sample = sample_shared(before, after, n, seed).cache()
    size = sample.count()
    row: dict = {"sampled": size}
    for name in ("before", "after"):
        d = distribution(pair_cosines(sample, name), "cosine").first()
        row |= {f"dimensions_{name}": len(sample.select(name).first()[0])} | {f"cosine_{c}_{name}": d[c] for c in ("mean", "median", "p05", "p95", "std")}
        row[f"centroid_norm_{name}"] = centroid_norm(sample, name).first().norm
    j = distribution(neighbour_jaccard(sample, k), "jaccard").first()
    row |= {f"jaccard_{c}": j[c] for c in ("mean", "median", "p05", "p95")}
    row["collapse"] = bool(row["cosine_mean_after"] >= collapse_mean and row["cosine_std_after"] <= collapse_std)
    row["shift"] = bool(abs(row["cosine_mean_after"] - row["cosine_mean_before"]) >= shift or abs(row["centroid_norm_after"] - row["centroid_norm_before"]) >= shift or row["jaccard_mean"] < least_jaccard)
    sample.unpersist()
    rounded = {c: round(v, 9) if isinstance(v, float) else v for c, v in row.items()}
    return before.sparkSession.createDataFrame(pd.DataFrame([rounded]))
