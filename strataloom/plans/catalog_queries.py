"""Queries on projections, identifiers and look-ups of the catalog, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import scalars as S
from strataloom.operators import migration
from strataloom.plans.domain_queries import CHUNKS, VECTORS, _W, once
from strataloom.sources.tables import table
from strataloom.sources.text_files import canonical_corpus, evaluation_catalog

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id::VARCHAR AS doc_id, title, sha256(text) AS text_hash, 'beir://scifact/' || doc_id AS source_uri, 'BEIR/SciFact' AS author, 'public' AS classification_level, 'en' AS language FROM documents")
def canonical_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows in the governed envelope; texts as hashes."""
    rows = canonical_corpus(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("_id"), "title", "text"))
    return rows.select("doc_id", "title", F.sha2("text", 256).alias("text_hash"), "metadata.*")


@query("SELECT list_last(string_split('acme/' || model_name, '/')) AS short_name, model_version, provider, dimensions FROM embedding_models")
def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Models under the name after the last slash."""
    m = table(spark, folder, "embedding_models")
    return m.select(S.short_model_name(F.concat(F.lit("acme/"), "model_name")).alias("short_name"), "model_version", "provider", "dimensions")


@query("SELECT provider, dimensions FROM embedding_models WHERE model_name = 'velar-small' AND model_version = '1.0.0'")
def model_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The one model of a name and version."""
    found = migration.find_model(table(spark, folder, "embedding_models"), "velar-small", "1.0.0")
    return spark.createDataFrame([(found["provider"], found["dimensions"])], "provider string, dimensions int")


@query(f"SELECT v.vector_id, c.doc_id || '|' || c.chunk_index || '|' || v.model_name || '|' || v.model_version || '|' || c.strategy_name AS payload FROM {VECTORS} v JOIN {CHUNKS} c USING (chunk_id)")
def point_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What a point of the vector store carries besides its vector."""
    rows = once(spark, folder, "vectors", ["chunk_id", "model_name", "model_version"]).join(once(spark, folder, "chunks", ["doc_id", "chunk_index", "strategy_name"]), "chunk_id")
    p = migration.point_payload()
    return rows.select("vector_id", F.concat_ws("|", *(p[c].cast("string") for c in ("doc_id", "chunk_index", "model_name", "model_version", "strategy_name"))).alias("payload"))


@query(f"SELECT 'mig_0:' || chunk_id AS vector_id, chunk_id, 'shadow' AS collection_name, false AS active, true AS pii_masked_flag FROM {CHUNKS}")
def shadow_vector_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a migration would add for every chunk."""
    rows = migration.shadow_vectors(once(spark, folder, "chunks", []), "mig_0", "m", "1", "shadow", 64)
    return rows.select("vector_id", "chunk_id", "collection_name", "active", "pii_masked_flag")


@query(f"SELECT strategy_name, sum(greatest(1, len(regexp_extract_all(chunk_text, '{_W}'))))::BIGINT AS metered, sum(greatest(1, ceil(len(regexp_extract_all(chunk_text, '{_W}')) * 1.3)))::BIGINT AS planned FROM {CHUNKS} WHERE chunk_text IS NOT NULL GROUP BY 1")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Metered and planned tokens of the chunks of each strategy."""
    text = F.col("chunk_text")
    rows = once(spark, folder, "chunks", ["strategy_name"], metered=F.when(text.isNotNull(), S.metered_tokens(text)), planned=F.when(text.isNotNull(), S.planned_tokens(text)))
    return rows.filter("metered is not null").groupBy("strategy_name").agg(F.sum("metered").alias("metered"), F.sum("planned").alias("planned"))


@query(r"""SELECT id, row_number() OVER (ORDER BY NOT regexp_full_match(id, '\d{1,38}'), CASE WHEN regexp_full_match(id, '\d{1,38}') THEN id::DECIMAL(38,0) END, id) AS place FROM (SELECT DISTINCT CASE WHEN item % 3 = 0 THEN 'x' || item ELSE item::VARCHAR END AS id FROM (SELECT vec_id AS item FROM embeddings))""")
def numeric_order(spark: SparkSession, folder: str) -> DataFrame:
    """Ids in their order: whole numbers by value, then the rest by text."""
    from strataloom.operators.numbering import numbered

    item = F.col("vec_id").cast("string")
    ids = table(spark, folder, "embeddings").select(F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("x"), item)).otherwise(item).alias("id")).distinct()
    keys = S.numeric_first(F.col("id"))
    return numbered(ids.select("id", *(k.alias(f"k{i}") for i, k in enumerate(keys))), ["k0", "k1", "k2"], name="place").select("id", "place")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'id' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'doc' || event_id END, 'document' || event_id) AS item FROM events")
def ranking_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Items' ids under the first of three names that is set."""
    e, n = table(spark, folder, "events"), F.col("event_id") % 3
    named = lambda prefix, on: F.when(on, F.concat(F.lit(prefix), F.col("event_id").cast("string")))
    return e.select("event_id", S.ranking_id(named("id", n == 0), named("doc", n == 1), named("document", F.lit(True))).alias("item"))


@query("SELECT event_id, i - 1 AS pos, 'a' || i AS v FROM events, range(1, 4) r(i)")
def exploded_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a JSON list with their places."""
    listed = table(spark, folder, "events").select("event_id", F.from_json(F.lit('["a1", "a2", "a3"]'), "array<string>").alias("l"))
    return listed.select("event_id", F.posexplode("l").alias("pos", "v")).select("event_id", F.col("pos").cast("bigint").alias("pos"), "v")


@query("WITH r AS (SELECT o_custkey::VARCHAR AS q, o_orderkey::VARCHAR AS d FROM orders WHERE o_custkey % 100 = 0) SELECT q AS query_id, c_name AS text, string_agg(d, ',' ORDER BY d) AS relevant FROM r JOIN customer ON c_custkey::VARCHAR = q GROUP BY ALL")
def qrels_with_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Judgments joined with their queries: orders as the relevant items of every hundredth customer."""
    qrels = table(spark, folder, "orders").filter("o_custkey % 100 = 0").select(F.col("o_custkey").cast("string").alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_id"))
    queries = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("query_id"), F.col("c_name").alias("text"))
    return evaluation_catalog(qrels, queries).select("query_id", "text", F.array_join("relevant_doc_ids", ",").alias("relevant"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') / count(*) AS error_rate FROM events GROUP BY 1")
def error_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each user's requests that failed."""
    e = table(spark, folder, "events")
    return e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"))


@query("SELECT attempt, round(0.5 * 2 ** attempt * (0.5 + 0.25), 6) AS seconds FROM (SELECT DISTINCT event_id % 6 AS attempt FROM events)")
def backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Waits between attempts, chance held at a quarter."""
    attempts = table(spark, folder, "events").select((F.col("event_id") % 6).alias("attempt")).distinct()
    return attempts.select("attempt", F.round(S.backoff_seconds(F.col("attempt"), 0.5, F.lit(0.25)), 6).alias("seconds"))
