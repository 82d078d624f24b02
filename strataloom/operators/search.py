"""Exact top-k of query vectors over all rows, in blocks: cosine, dot product or Euclidean distance.

Both sides are cut into blocks of bounded size by hash; each pair of a query block and a corpus block is one group that
a matrix product scores, and only its k best rows per query leave it. A lone query block meets the corpus without a
shuffle of the corpus: queries of at most MOST_QUERIES rows are broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("Cosine", "Dot", "Euclidean")
MOST_QUERIES = 4096
CORPUS_BLOCK = 50_000


def score_matrix(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of which larger is better; a zero vector has cosine 0, distances come out negative."""
    if metric == "Dot":
        return q @ x.T
    if metric == "Euclidean":
        return -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)))
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return np.divide(q @ x.T, size, out=np.zeros_like(size), where=size > 0)


def _top(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, least: float | None) -> pd.DataFrame:
    scores = np.round(scores, 9) + 0.0
    parts = []
    for i, s in enumerate(scores):
        keep = np.flatnonzero(s >= least) if least is not None else np.arange(len(s))
        if len(keep) > k:  # all that reach the k-th score, so that ties can be broken by id
            keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k)[len(keep) - k]]
        best = sorted(keep, key=lambda j: (-s[j], ids[j]))[:k]
        parts.append(pd.DataFrame({"query_id": queries[i], "item_id": ids[best], "score": s[best]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "item_id": [], "score": []})


def top_k(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "Cosine", least: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank). corpus: item_id, vector; queries: query_id, vector; vectors of another length than
    a query's are no candidates, null vectors neither. least: lowest score, applied before the limit. Ties go to the smaller id."""
    if k < 1:
        raise ValueError("k must be positive")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    corpus = corpus.select("item_id", F.col("vector").cast("array<double>")).filter("vector is not null and size(vector) > 0")
    queries = queries.select("query_id", F.col("vector").cast("array<double>")).filter("vector is not null and size(vector) > 0")
    types = (queries.schema["query_id"].dataType.simpleString(), corpus.schema["item_id"].dataType.simpleString())
    schema = f"query_id {types[0]}, item_id {types[1]}, score double"

    def score(q: pd.DataFrame, x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lengths = x["vector"].map(len).to_numpy()
        for n, part in q.groupby(q["vector"].map(len)):
            own = np.flatnonzero(lengths == n)
            if not len(own):
                continue
            ids = x["item_id"].to_numpy()[own]
            matrix = np.stack(x["vector"].to_numpy()[own])
            for begin in range(0, len(part), 256):
                some = part.iloc[begin : begin + 256]
                s = score_matrix(np.stack(some["vector"].to_numpy()), matrix, metric)
                if exclude_self:
                    s[some["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                found = _top(some["query_id"].to_numpy(), ids, s, k, least if least is not None else -1e300)
                if len(found):
                    yield found

    held = queries.limit(MOST_QUERIES + 1).toPandas()
    if len(held) <= MOST_QUERIES:
        shared = queries.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x) and len(shared.value):
                    yield from score(shared.value, x)

        hits = corpus.mapInPandas(run, schema)
    else:
        across, down = -(-queries.count() // MOST_QUERIES), -(-corpus.count() // CORPUS_BLOCK)
        q = queries.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(across)), "cb": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint")))})
        c = corpus.withColumns({"cb": F.pmod(F.xxhash64("item_id"), F.lit(down)), "qb": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint")))})

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            parts = list(score(a, b)) if len(a) and len(b) else []
            return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "item_id": [], "score": []})

        hits = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(pair, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shadow_overlap(live: DataFrame, shadow: DataFrame) -> DataFrame:
    """(query_id, shared, live_only, shadow_only) of two rankings."""
    both = live.select("query_id", "item_id", F.lit(1).alias("l")).join(shadow.select("query_id", "item_id", F.lit(1).alias("s")), ["query_id", "item_id"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.col("l").isNotNull() & F.col("s").isNotNull()).alias("shared"), F.count_if(F.col("s").isNull()).alias("live_only"), F.count_if(F.col("l").isNull()).alias("shadow_only"))


def collection_violations(store: DataFrame, by: str = "collection_name") -> DataFrame:
    """(by, no_vector, wrong_length, vectors): what of each collection cannot be searched."""
    n = F.size("embedding")
    return store.groupBy(by).agg(F.count_if(F.col("embedding").isNull()).alias("no_vector"), F.count_if(F.col("embedding").isNotNull() & (n != F.col("dimension"))).alias("wrong_length"), F.count("*").alias("vectors"))


def verify_collection(store: DataFrame, name: str, dimensions: int, metric: str = "Cosine") -> None:
    """An error unless every vector of a collection has the wanted length and its metric is the wanted one."""
    own = store.filter(F.col("collection_name") == name)
    bad = own.filter((F.col("dimension") != dimensions) | (F.col("distance_metric") != metric)).limit(1).collect()
    if bad:
        raise ValueError(f"{name} holds vectors of {bad[0].dimension} dimensions by {bad[0].distance_metric}")
