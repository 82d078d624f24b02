"""Queries on vector search, retrieval quality, drift and telemetry, with their SQL twins."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators import drift, evaluation, search, telemetry
from strataloom.sources.tables import table
from strataloom.streaming import rates

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# search: queries are the vectors whose id is divisible by 100, against all -------------------------------------------


def _corpus(spark, folder, take=lambda c: c):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), take(F.col("embedding")).alias("vector"))


def _asked(corpus):
    return corpus.filter(F.col("item_id") % 100 == 0).withColumnRenamed("item_id", "query_id")


_SCORES = {
    "Cosine": "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "Dot": "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "Euclidean": "-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
}


def _sql_top(metric: str, k: int, least: str = "", source: str = "embeddings") -> str:
    return f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_SCORES[metric]}, 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SCORES[metric]}, 9) DESC, b.vec_id) AS rank
        FROM {source} a, {source} b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id {least}) WHERE rank <= {k}"""


def _top(spark, folder, metric, k, least=None, take=lambda c: c):
    corpus = _corpus(spark, folder, take)
    hits = search.top_k(corpus, _asked(corpus), k, metric, least=least, exclude_self=True)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query(_sql_top("Cosine", 10))
def search_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, "Cosine", 10)


@query(_sql_top("Dot", 10))
def search_topk_dot(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, "Dot", 10)


@query(_sql_top("Euclidean", 10))
def search_topk_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, "Euclidean", 10)


@query(_sql_top("Cosine", 10, f"AND round({_SCORES['Cosine']}, 9) >= 0.25"))
def search_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Scores below the threshold are dropped before the limit."""
    return _top(spark, folder, "Cosine", 10, least=0.25)


_HALF = "(SELECT vec_id, label, embedding[1:32] AS embedding FROM embeddings)"


@query(f"""WITH l AS ({_sql_top('Cosine', 10)}), s AS ({_sql_top('Cosine', 10, source=_HALF)}) SELECT query_id, count(*) FILTER (l.item_id IS NOT NULL AND s.item_id IS NOT NULL) AS shared, count(*) FILTER (s.item_id IS NULL) AS live_only, count(*) FILTER (l.item_id IS NULL) AS shadow_only
    FROM l FULL JOIN s USING (query_id, item_id) GROUP BY query_id""".replace("l.item_id", "l.rank").replace("s.item_id", "s.rank"))
def shadow_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Rankings of the full vectors against those of their first half."""
    return search.shadow_overlap(_top(spark, folder, "Cosine", 10), _top(spark, folder, "Cosine", 10, take=lambda c: F.slice(c, 1, 32)))


# retrieval quality: relevant is what has the query's label ----------------------------------------------------------


def _qrels(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return e.join(asked, "label").filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"))


def _metrics(spark, folder, take=lambda c: c):
    ranking = _top(spark, folder, "Cosine", 10, take=take).select("query_id", F.col("item_id").alias("doc_id"), "rank")
    return evaluation.query_metrics(_qrels(spark, folder), ranking)


_QRELS = "(SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


def _sql_metrics(source: str = "embeddings") -> str:
    return f"""SELECT query_id, n AS relevant, coalesce(h5, 0) / n AS recall_at_5, coalesce(h10, 0) / n AS recall_at_10, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_10, coalesce(rr, 0) AS reciprocal_rank
        FROM (SELECT query_id, count(*) AS n FROM {_QRELS} GROUP BY 1) LEFT JOIN (SELECT q.query_id, count(*) FILTER (rank <= 5)::DOUBLE AS h5, count(*)::DOUBLE AS h10, sum(1 / log2(rank + 1)) AS dcg, max(1.0 / rank)::DOUBLE AS rr FROM ({_sql_top('Cosine', 10, source=source)}) t JOIN {_QRELS} q ON q.query_id = t.query_id AND q.doc_id = t.item_id GROUP BY 1) USING (query_id)"""


def _rounded(df, *keep):
    return df.select(*(F.round(c, 6).alias(c) if c not in keep else F.col(c) for c in df.columns))


@query(f"SELECT query_id, relevant, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(ndcg_at_10, 6) AS ndcg_at_10, round(reciprocal_rank, 6) AS reciprocal_rank FROM ({_sql_metrics()})")
def eval_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, NDCG and reciprocal rank of every query."""
    return _rounded(_metrics(spark, folder), "query_id", "relevant")


@query(f"SELECT count(*) AS queries, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(reciprocal_rank), 6) AS mrr FROM ({_sql_metrics()})")
def eval_macro(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.macro(_metrics(spark, folder)), "queries")


@query(f"SELECT query_id, list_sort(list(doc_id)) [1] AS first_doc, count(*) AS n FROM {_QRELS} GROUP BY 1")
def qrels_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The relevant documents of every query: the first and their number, without a list of all."""
    return _qrels(spark, folder).groupBy("query_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT avg(recall_at_10) AS r, avg(ndcg_at_10) AS n, avg(reciprocal_rank) AS m FROM ({_sql_metrics()})), c AS (SELECT avg(recall_at_10) AS r, avg(ndcg_at_10) AS n, avg(reciprocal_rank) AS m FROM ({_sql_metrics(_HALF)}))
    SELECT round(c.r - b.r, 6) AS recall_delta, round(c.n - b.n, 6) AS ndcg_delta, round(c.m - b.m, 6) AS mrr_delta, (c.r - b.r >= -0.02 AND c.n - b.n >= 0) AS passed FROM b, c""")
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether half the dimensions rank as well as all of them."""
    base, other = (evaluation.macro(_metrics(spark, folder, take)) for take in (lambda c: c, lambda c: F.slice(c, 1, 32)))
    return _rounded(evaluation.gate(base, other), "passed")


# drift: the second space is the first half of each vector ------------------------------------------------------------

_SAMPLE = "(SELECT vec_id, embedding::DOUBLE[] AS before, embedding[1:32]::DOUBLE[] AS after FROM embeddings ORDER BY sha256('3:' || vec_id::VARCHAR), vec_id LIMIT 1000)"


def _spaces(spark, folder):
    return _corpus(spark, folder), _corpus(spark, folder, lambda c: F.slice(c, 1, 32))


@query(f"""SELECT count(*) AS pairs, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.05), 6) AS p05, round(quantile_cont(c, 0.95), 6) AS p95, round(stddev_pop(c), 6) AS std
    FROM (SELECT round(list_cosine_similarity(a.before, b.before), 9) AS c FROM {_SAMPLE} a JOIN {_SAMPLE} b ON a.vec_id < b.vec_id)""")
def cosine_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Cosines of all pairs within a sample of the space."""
    pairs = drift.pair_cosines(drift.sample_shared(*_spaces(spark, folder), 1000, 3), "before")
    return _rounded(drift.distribution(pairs, "cosine", count="pairs"), "pairs")


@query(f"""WITH s AS {_SAMPLE}, n AS (SELECT a.vec_id AS item_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.before, b.before), 9) DESC, b.vec_id) AS r1, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.after, b.after), 9) DESC, b.vec_id) AS r2 FROM s a JOIN s b ON a.vec_id <> b.vec_id)
    SELECT item_id, round(count(*) FILTER (r1 <= 10 AND r2 <= 10) / count(*) FILTER (r1 <= 10 OR r2 <= 10), 6) AS jaccard FROM n GROUP BY 1""")
def knn_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of each sampled item's ten nearest in both spaces."""
    return drift.neighbour_jaccard(drift.sample_shared(*_spaces(spark, folder), 1000, 3), 10).select("item_id", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT round(sqrt(sum(m * m)), 6) AS norm FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i)")
def centroid_norm(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(drift.centroid_norm(_corpus(spark, folder)))


def _sql_cosines(side: str) -> str:
    return f"""SELECT avg(c) AS mean, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.05) AS p05, quantile_cont(c, 0.95) AS p95, stddev_pop(c) AS std FROM (SELECT round(list_cosine_similarity(a.{side}, b.{side}), 9) AS c FROM s a JOIN s b ON a.vec_id < b.vec_id)"""


def _sql_centroid(side: str) -> str:
    return f"SELECT sqrt(sum(m * m)) AS norm FROM (SELECT i, avg({side}[i]) AS m FROM (SELECT {side}, unnest(range(1, len({side}) + 1)) AS i FROM s) GROUP BY i)"


_SIDES = ", ".join(f"round({t}.{c}, 6) AS cosine_{c}_{n}" for t, n in (("b", "before"), ("a", "after")) for c in ("mean", "median", "p05", "p95", "std"))


@query(f"""WITH s AS {_SAMPLE}, b AS ({_sql_cosines('before')}), a AS ({_sql_cosines('after')}), cb AS ({_sql_centroid('before')}), ca AS ({_sql_centroid('after')}),
    n AS (SELECT x.vec_id AS id, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.before, y.before), 9) DESC, y.vec_id) AS r1, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.after, y.after), 9) DESC, y.vec_id) AS r2 FROM s x JOIN s y ON x.vec_id <> y.vec_id),
    j AS (SELECT avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95 FROM (SELECT count(*) FILTER (r1 <= 10 AND r2 <= 10) / count(*) FILTER (r1 <= 10 OR r2 <= 10) AS v FROM n GROUP BY id))
    SELECT (SELECT count(*) FROM s) AS sampled, (SELECT max(len(before)) FROM s) AS dimensions_before, (SELECT max(len(after)) FROM s) AS dimensions_after, {_SIDES}, round(cb.norm, 6) AS centroid_norm_before, round(ca.norm, 6) AS centroid_norm_after,
        round(j.mean, 6) AS jaccard_mean, round(j.median, 6) AS jaccard_median, round(j.p05, 6) AS jaccard_p05, round(j.p95, 6) AS jaccard_p95, (a.mean >= 0.95 AND a.std <= 0.05) AS collapse, (abs(a.mean - b.mean) >= 0.1 OR abs(ca.norm - cb.norm) >= 0.1 OR j.mean < 0.9) AS shift FROM a, b, ca, cb, j""")
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    """The whole report on both spaces."""
    row = drift.report(*_spaces(spark, folder), n=1000, seed=3)
    return row.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes))


# telemetry: events stand for requests, their value for hundredths of a second ----------------------------------------


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("seconds", F.col("value") / 100)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.latency_summary(table(spark, folder, "events"), "value", ["event_type"]), "event_type", "n")


_LE = ", ".join([*(f"{b}::DOUBLE" for b in telemetry.SEARCH_BUCKETS), "'inf'::DOUBLE"])
_HISTOGRAM = f"SELECT event_type, le, count(*) FILTER (value / 100 <= le) AS n FROM events, (SELECT unnest([{_LE}]) AS le) WHERE value IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT event_type, le::VARCHAR AS le, n FROM ({_HISTOGRAM})".replace("le::VARCHAR", "CASE WHEN le = 'inf'::DOUBLE THEN 'inf' ELSE le::VARCHAR END"))
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative buckets by event type."""
    h = telemetry.histogram(_events(spark, folder), F.col("seconds"), ["event_type"], telemetry.SEARCH_BUCKETS)
    return h.select("event_type", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"), "n")


@query(f"""WITH b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0.0) AS low, 0.95 * max(n) OVER (PARTITION BY event_type) AS target FROM ({_HISTOGRAM}) WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (target - below) / (n - below) END, 6) AS value FROM b WHERE n >= target AND below < target""")
def histogram_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile by interpolation in buckets."""
    h = telemetry.histogram(_events(spark, folder), F.col("seconds"), ["event_type"], telemetry.SEARCH_BUCKETS)
    return _rounded(telemetry.bucket_quantile(h, ["event_type"], 0.95), "event_type")


def _rates(df: DataFrame) -> DataFrame:
    """Windows as seconds since 1970 of the wall clock, so that the session's time zone does not matter."""
    since = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(window_start as timestamp_ntz))")
    return df.select(since.alias("window_start"), "event_type", "n", F.round("per_second", 6).alias("per_second"))


_RATE = "SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, event_type, count(*) AS n, count(*) / 60.0 AS per_second FROM events GROUP BY 1, 2"


@query(f"SELECT epoch(window_start)::BIGINT AS window_start, event_type, n, round(per_second, 6) AS per_second FROM ({_RATE})")
def request_rate_1m(spark: SparkSession, folder: str) -> DataFrame:
    """Requests a second in windows of a minute."""
    return _rates(telemetry.rate(table(spark, folder, "events"), "ts", ["event_type"]))


@query("""SELECT epoch(w)::BIGINT AS window_start, event_type, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM (SELECT event_type, time_bucket(INTERVAL '1 minute', ts) - to_minutes(i) AS w FROM events, range(5) r(i)) GROUP BY 1, 2""")
def request_rate_5m(spark: SparkSession, folder: str) -> DataFrame:
    """Requests a second over five minutes, from minute to minute."""
    return _rates(telemetry.rate(table(spark, folder, "events"), "ts", ["event_type"], 5, 1))


@query("""SELECT 'events_total{model="' || m || '",type="' || event_type || '"} ' || count(*) AS line FROM (SELECT event_type, (props->>'$.k')::INTEGER % 4 AS m FROM events) GROUP BY event_type, m""")
def metrics_exposition(spark: SparkSession, folder: str) -> DataFrame:
    """Counters in the text format that scrapers read."""
    counted = counters(spark, folder).select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type", F.lit("model"), F.col("model").cast("string")).alias("labels"), F.col("requests").alias("value"))
    return telemetry.exposition(counted)


@query(ORACLES["request_rate_1m"])
def streaming_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The same rates out of a stream over the event files."""
    from strataloom.session import ensure_checkpoint_dir, forget_at_exit

    single = os.path.isfile(f"{folder}/events.parquet")
    place = folder if single else f"{folder}/events.parquet"
    source = rates.file_stream(spark, place, "events.parquet" if single else "*.parquet", table(spark, folder, "events").schema)
    place_out = forget_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/rates-{uuid.uuid4().hex}")
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    return _rates(rates.run_once(rates.stream_rate(source, "ts", ["event_type"]), ["window_start", "event_type"], place_out))


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stale_gauge(spark: SparkSession, folder: str) -> DataFrame:
    """The last value of each label."""
    return telemetry.last_value(table(spark, folder, "events"), "ts", "event_id", "value", ["event_type"])


@query("SELECT event_type, (props->>'$.k')::INTEGER % 4 AS model, count(*) AS requests, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters by event type and a label out of the properties."""
    model = F.get_json_object("props", "$.k").cast("int") % 4
    return table(spark, folder, "events").groupBy("event_type", model.alias("model")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view'), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click')
    SELECT le::VARCHAR AS le, count(*) FILTER (d <= le) AS n FROM (SELECT round((s.value - r.value) / 100, 9) AS d FROM r JOIN s USING (user_id, i)), (SELECT unnest([-1.0, -0.1, -0.01, 0.0, 0.01, 0.1, 1.0]::DOUBLE[]) AS le) GROUP BY le""")
def shadow_latency_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Latency differences of paired requests in buckets: a user's n-th view against the n-th click."""
    e = table(spark, folder, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r, s = (e.filter(F.col("event_type") == t).select("user_id", number.alias("i"), F.col("value").alias(t)) for t in ("view", "click"))
    delta = r.join(s, ["user_id", "i"]).select(F.round((F.col("click") - F.col("view")) / 100, 9).alias("d"))
    return telemetry.histogram(delta, F.col("d"), [], telemetry.SHADOW_BUCKETS).filter(F.col("le") < float("inf")).select(F.col("le").cast("string"), "n")
