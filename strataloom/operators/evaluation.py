"""Retrieval quality: recall, NDCG, reciprocal rank, macro averages, percentiles and the gate between two rankings.

qrels: (query_id, doc_id), one row for each relevant document; rankings: (query_id, doc_id, rank). Queries of qrels
without a ranking count with zeros, rankings without qrels are left out. By default a document that a ranking repeats
is gained repeatedly, as its chunks are, so NDCG can exceed 1; dedupe keeps its best rank only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.numbering import exact_percentiles


def query_metrics(qrels: DataFrame, rankings: DataFrame, dedupe: bool = False) -> DataFrame:
    """(query_id, relevant, recall_at_5, recall_at_10, ndcg_at_10, reciprocal_rank)."""
    truth = qrels.select("query_id", "doc_id").distinct()
    ranked = rankings.select("query_id", "doc_id", "rank")
    if dedupe:
        ranked = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = ranked.join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("doc_id"))).alias("h5"), F.count_distinct(F.when(F.col("rank") <= 10, F.col("doc_id"))).alias("h10"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.max(1 / F.col("rank")).alias("rr"))
    sizes = truth.groupBy("query_id").agg(F.count("doc_id").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = sizes.join(hits, "query_id", "left")
    positive = F.col("relevant") > 0
    share = lambda c: F.when(positive, F.coalesce(c, F.lit(0)) / F.col("relevant")).otherwise(0.0)
    return joined.select(
        "query_id", "relevant", share(F.col("h5")).alias("recall_at_5"), share(F.col("h10")).alias("recall_at_10"),
        F.when(positive, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_at_10"), F.coalesce("rr", F.lit(0.0)).cast("double").alias("reciprocal_rank"))


def macro(metrics: DataFrame) -> DataFrame:
    """One row of averages over all queries; an error without any."""
    row = metrics.agg(F.count("*").alias("queries"), F.avg("recall_at_5").alias("recall_at_5"), F.avg("recall_at_10").alias("recall_at_10"), F.avg("ndcg_at_10").alias("ndcg_at_10"), F.avg("reciprocal_rank").alias("mrr"))
    return row.filter(F.assert_true(F.col("queries") > 0, F.lit("no queries to evaluate")).isNull())


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and exact interpolated percentiles, by ranks of counted values (numbering.exact_percentiles)."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    shares = {p: p / 100 for p in (50, 95, 99)}
    at = exact_percentiles(df, value, by, list(shares.values()))
    wide = at.groupBy(*by).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{p}") for p, s in shares.items()))
    same = [plain[b].eqNullSafe(wide[b]) for b in by]
    return plain.join(wide, same, "left").select(*(plain[b] for b in by), "n", "mean", *(f"p{p}" for p in shares))


def gate(baseline: DataFrame, candidate: DataFrame, recall_tolerance: float = 0.02, ndcg_tolerance: float = 0.0) -> DataFrame:
    """One row: the deltas of two macro() rows and whether the candidate holds up."""
    if recall_tolerance < 0 or ndcg_tolerance < 0:
        raise ValueError("tolerances must not be negative")
    both = baseline.withColumn("side", F.lit(-1)).unionByName(candidate.withColumn("side", F.lit(1)))
    out = both.agg(*(F.sum(F.col("side") * F.col(c)).alias(d) for c, d in (("recall_at_10", "recall_delta"), ("ndcg_at_10", "ndcg_delta"), ("mrr", "mrr_delta"))))
    return out.withColumn("passed", (F.col("recall_delta") >= -recall_tolerance) & (F.col("ndcg_delta") >= -ndcg_tolerance))


def error_rate(attempts: DataFrame) -> DataFrame:
    """(error_rate) of queries (query_id, error): the share of those with an error; 0 of none."""
    failed = F.count_if(F.col("error").isNotNull())
    return attempts.agg(F.when(F.count("*") > 0, failed / F.count("*")).otherwise(0.0).alias("error_rate"))


def gated(deltas: DataFrame, errors: DataFrame) -> DataFrame:
    """gate() with the candidate's error_rate, which has to be 0 to pass."""
    return deltas.crossJoin(errors).withColumn("passed", F.col("passed") & (F.col("error_rate") == 0))  # one row each


def run_rows(macros: dict[str, DataFrame], model: tuple[str, str], dataset: str, rates: dict[str, DataFrame], passed: bool) -> DataFrame:
    """Rows of the run table, one for each side of a gate."""
    def one(side: str) -> DataFrame:
        own = macros[side].crossJoin(rates[side])  # one row each
        return own.select(F.expr("uuid()").alias("run_id"), F.lit(model[0]).alias("model_name"), F.lit(model[1]).alias("model_version"), F.lit(f"{dataset}:{side}").alias("dataset_name"), "recall_at_5", "recall_at_10", "ndcg_at_10", "mrr", "error_rate", F.lit("passed" if passed else "failed").alias("status"))

    return reduce(DataFrame.unionByName, map(one, macros))
