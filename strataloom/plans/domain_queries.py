"""Queries on documents, chunks and the catalog, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import scalars as S
from strataloom.operators import catalog as C
from strataloom.operators import chunking, contract, lineage, migration
from strataloom.operators.numbering import batch_number, numbered
from strataloom.schemas import TABLES
from strataloom.sources.tables import table

KEYS = {"document_records": ["doc_id", "doc_version"], "chunks": ["chunk_id"], "vectors": ["vector_id"]}
STRATEGY = chunking.ChunkStrategy("fixed_size_v1", "1.0.0", 300, 30)
MODEL = ("velar-small", "1.0.0")


def once(spark: SparkSession, folder: str, name: str, columns: list[str], **derived) -> DataFrame:
    """A growing table with one row for each key, the first delivery.

    Only the asked columns travel; what is derived from texts is computed before the shuffle, so the texts stay put."""
    keys = KEYS[name]
    kept = [c for c in dict.fromkeys([*keys, *columns, "loaded_at"]) if c not in derived]
    return C.latest(table(spark, folder, name).select(*kept, *(c.alias(n) for n, c in derived.items())), keys)


def _vectors(spark, folder, *extra):
    return once(spark, folder, "vectors", ["chunk_id", "model_name", "model_version", "collection_name", "active", "pii_masked_flag", *extra])


def _chunks(spark, folder, *columns):
    return once(spark, folder, "chunks", list(columns))


def _documents(spark, folder, *columns):
    return once(spark, folder, "document_records", list(columns))


def _sql_once(name: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {', '.join(KEYS[name])} ORDER BY loaded_at NULLS LAST) = 1)"


DOCS, CHUNKS, VECTORS = (_sql_once(n) for n in ("document_records", "chunks", "vectors"))
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# contract -----------------------------------------------------------------------------------------------------------

_FIELDS = [(n, f"metadata.{n}" if n in contract.METADATA_FIELDS else n) for n in (*contract.FIELDS, *contract.METADATA_FIELDS)]
_STRUCTURAL = ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}:missing' WHEN length({c}) < {contract.MINIMUM.get(n, 1)} THEN '{n}:too_short' END" for n, c in _FIELDS)
_RULES = ", ".join(
    [f"CASE WHEN length({c}) < {contract.CHARACTER_LIMITS[n][0]} OR length({c}) > {contract.CHARACTER_LIMITS[n][1]} THEN '{n}:length' END" for n, c in _FIELDS]
    + [f"CASE WHEN NOT ({c} IN ({', '.join(repr(v) for v in contract.ALLOWED_VALUES[n])})) THEN '{n}:allowed_values' END" for n, c in _FIELDS if n in contract.ALLOWED_VALUES])
_ERRORS = f"""
    SELECT doc_id, doc_version, CASE WHEN len(s) > 0 THEN s ELSE r END AS errors FROM (
        SELECT doc_id, doc_version, list_filter([{_STRUCTURAL}], lambda x: x IS NOT NULL) AS s, list_filter([{_RULES}], lambda x: x IS NOT NULL) AS r FROM {DOCS})"""


def _checked(spark, folder):
    errors = F.transform(contract.errors(), lambda e: F.concat_ws(":", e["field"], e["rule"]))
    return once(spark, folder, "document_records", [], errors=errors).select("doc_id", "doc_version", "errors")


@query(f"SELECT doc_id, doc_version, unnest(errors) AS error FROM ({_ERRORS})")
def contract_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every error of every record, structural ones before the rules."""
    return _checked(spark, folder).select("doc_id", "doc_version", F.explode("errors").alias("error"))


@query(f"SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM ({_ERRORS})) GROUP BY error")
def contract_error_counts(spark: SparkSession, folder: str) -> DataFrame:
    return contract_errors(spark, folder).groupBy("error").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM ({_ERRORS})")
def contract_split(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).agg(F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"))


# chunking and hashes ------------------------------------------------------------------------------------------------

_W = r"[^\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WINDOWS = f"""
    WITH t AS (SELECT doc_id, doc_version, regexp_extract_all(text, '{_W}') AS w FROM {DOCS} WHERE text IS NOT NULL),
    p AS (SELECT doc_id, doc_version, w, unnest(range(0, CAST(ceil(greatest(0, len(w) - 300) / 270.0) AS BIGINT) + 1)) AS i FROM t WHERE len(w) > 0),
    c AS (SELECT doc_id, doc_version, i, array_to_string(w[i * 270 + 1 : i * 270 + 300], ' ') AS x, least(300, len(w) - i * 270) AS n FROM p)
    SELECT doc_id || ':' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS chunk_id, doc_version, i AS chunk_index, i * 270 AS token_start, n AS n_tokens, sha256(x || '1.0.0') AS chunk_hash FROM c"""


@query(_WINDOWS)
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows of 300 tokens that share 30, over every record."""
    chunks = chunking.chunk_documents(table(spark, folder, "document_records").select("doc_id", "doc_version", "text"), STRATEGY)
    # deliveries of a record carry the same text; their equal windows meet by hash, without the texts
    return chunks.select("chunk_id", "doc_version", F.col("chunk_index").cast("bigint"), F.col("token_start").cast("bigint"), F.col("n_tokens").cast("bigint"), "chunk_hash").distinct()


@query(f"SELECT count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens, max(chunk_index) + 1 AS most FROM ({_WINDOWS})")
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_windows(spark, folder).agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), (F.max("chunk_index") + 1).alias("most"))


@query(f"""SELECT CASE WHEN content_hash IS NULL THEN 'null' WHEN text IS NULL THEN 'no_text' WHEN content_hash = sha256(text) THEN 'ok' WHEN lower(content_hash) = sha256(text) THEN 'letter_case' ELSE 'differs' END AS state, count(*) AS n FROM {DOCS} GROUP BY 1""")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """How the stored content hashes compare with the texts."""
    h = F.sha2("text", 256)
    state = F.when(F.col("content_hash").isNull(), "null").when(F.col("text").isNull(), "no_text").when(F.col("content_hash") == h, "ok").when(F.lower("content_hash") == h, "letter_case").otherwise("differs")
    return once(spark, folder, "document_records", [], state=state).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""SELECT strategy_version, CASE WHEN chunk_hash IS NULL THEN 'null' WHEN chunk_text IS NULL THEN 'no_text' WHEN chunk_hash = sha256(chunk_text || strategy_version) THEN 'ok' WHEN lower(chunk_hash) = sha256(chunk_text || strategy_version) THEN 'letter_case' ELSE 'differs' END AS state, count(*) AS n FROM {CHUNKS} GROUP BY 1, 2""")
def chunk_hash(spark: SparkSession, folder: str) -> DataFrame:
    """How the stored chunk hashes compare with text and strategy version."""
    h = S.chunk_hash(F.col("chunk_text"), F.col("strategy_version"))
    state = F.when(F.col("chunk_hash").isNull(), "null").when(F.col("chunk_text").isNull(), "no_text").when(F.col("chunk_hash") == h, "ok").when(F.lower("chunk_hash") == h, "letter_case").otherwise("differs")
    return once(spark, folder, "chunks", ["strategy_version"], state=state).groupBy("strategy_version", "state").agg(F.count("*").alias("n"))


@query(f"SELECT lower(chunk_hash) AS chunk_hash, min(chunk_id) AS first_chunk_id, count(*) AS copies FROM {CHUNKS} WHERE chunk_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedupe_chunk_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of equal hash: the first id and the number of copies."""
    chunks = _chunks(spark, folder, "chunk_hash").filter("chunk_hash is not null")
    return chunks.groupBy(F.lower("chunk_hash").alias("chunk_hash")).agg(F.min("chunk_id").alias("first_chunk_id"), F.count("*").alias("copies")).filter("copies > 1")


@query(f"SELECT doc_id, doc_version, title, metadata.source_uri AS source_uri, metadata.author AS author, metadata.classification_level AS classification_level, metadata.language AS language, sha256(text) AS content_hash FROM {DOCS}")
def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows out of the governed envelope."""
    docs = once(spark, folder, "document_records", ["title", "metadata"], content_hash=F.sha2("text", 256))
    return docs.select("doc_id", "doc_version", "title", "metadata.source_uri", "metadata.author", "metadata.classification_level", "metadata.language", "content_hash")


_UUID = """substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||CASE substr(h,17,1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END||substr(h,18,3)||'-'||substr(h,21,12)"""


@query(f"SELECT vector_id, {_UUID} AS point_id FROM (SELECT vector_id, sha1(unhex('{S.URL_NAMESPACE}') || encode(collection_name || ':' || vector_id)) AS h FROM {VECTORS})")
def uuid5_point_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Name-based identifiers of the points of the vector store."""
    v = once(spark, folder, "vectors", ["collection_name"])
    return v.select("vector_id", S.uuid5_url(F.concat("collection_name", F.lit(":"), "vector_id")).alias("point_id"))


@query(f"""SELECT 'vec_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS vector_id, chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY doc_id, chunk_index, chunk_id) AS n FROM {CHUNKS})""")
def vector_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors numbered in the order of documents and chunks, by sorted partitions and their offsets."""
    from strataloom.operators.bootstrap import vector_rows

    chunks = _chunks(spark, folder, "doc_id", "chunk_index", "pii_masked_flag")
    return vector_rows(chunks, *MODEL, "numbered", 64).select("vector_id", "chunk_id")


# constraints --------------------------------------------------------------------------------------------------------


def _catalog(spark, folder):
    docs = table(spark, folder, "document_records").select("*", "metadata.*").drop("metadata")
    return {"documents": docs, "chunks": table(spark, folder, "chunks"), "vectors": table(spark, folder, "vectors"), "chunk_strategies": table(spark, folder, "chunk_strategies"), "embedding_models": table(spark, folder, "embedding_models")}


def _sql_key(name: str, columns, source: str) -> str:
    some = " OR ".join(f"{c} IS NULL" for c in columns)
    return f"(SELECT count(*) FROM (SELECT 1 FROM {source} WHERE NOT ({some}) GROUP BY {', '.join(columns)} HAVING count(*) > 1))"


_SOURCES = {"documents": "document_records", "chunks": "chunks", "vectors": "vectors", "chunk_strategies": "chunk_strategies", "embedding_models": "embedding_models"}
_KEY_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, 'key_null' AS rule, (SELECT count(*) FROM {s} WHERE {' OR '.join(f'{c} IS NULL' for c in TABLES[n].key)}) AS n"
    f" UNION ALL SELECT '{n}', 'primary_key', {_sql_key(n, TABLES[n].key, s)}"
    + "".join(f" UNION ALL SELECT '{n}', 'unique_{'_'.join(u)}', {_sql_key(n, u, s)}" for u in TABLES[n].unique)
    for n, s in _SOURCES.items())


@query(_KEY_SQL)
def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Null and repeated keys of every table as delivered."""
    parts = [C.key_violations(df, TABLES[n]).select(F.lit(n).alias("table_name"), "rule", "n") for n, df in _catalog(spark, folder).items()]
    return reduce(DataFrame.unionByName, parts)


def _sql_check(name: str) -> str:
    t, rules = TABLES[name], []
    flat = "(SELECT * EXCLUDE (metadata), metadata.source_uri AS source_uri, metadata.author AS author, metadata.classification_level AS classification_level, metadata.language AS language FROM document_records)"
    source = flat if name == "documents" else _SOURCES[name]
    rules += [(f"not_null_{c}", f"{c} IS NULL") for c in t.required] + [(r, f"NOT ({e})") for r, e in t.checks.items()]
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{r}' AS rule, (SELECT count(*) FROM {source} WHERE {e}) AS n" for r, e in rules)


@query(" UNION ALL ".join(_sql_check(n) for n in _SOURCES))
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break a check, and nulls in required columns, one pass a table."""
    parts = [C.check_violations(df, TABLES[n]).select(F.lit(n).alias("table_name"), "rule", "n") for n, df in _catalog(spark, folder).items()]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT 'chunks' AS table_name, 'documents' AS reference, count(*) AS n FROM chunks c ANTI JOIN document_records d USING (doc_id, doc_version) WHERE c.doc_id IS NOT NULL AND c.doc_version IS NOT NULL
    UNION ALL SELECT 'chunks', 'chunk_strategies', count(*) FROM chunks c ANTI JOIN chunk_strategies s USING (strategy_name, strategy_version) WHERE c.strategy_name IS NOT NULL AND c.strategy_version IS NOT NULL
    UNION ALL SELECT 'vectors', 'chunks', count(*) FROM vectors v ANTI JOIN chunks c USING (chunk_id) WHERE v.chunk_id IS NOT NULL
    UNION ALL SELECT 'vectors', 'embedding_models', count(*) FROM vectors v ANTI JOIN embedding_models m USING (model_name, model_version) WHERE v.model_name IS NOT NULL AND v.model_version IS NOT NULL""")
def fk_violations(spark: SparkSession, folder: str) -> DataFrame:
    """References that point nowhere."""
    return C.reference_violations(_catalog(spark, folder), ["chunks", "vectors"])


@query(f"""SELECT missing, n FROM (SELECT count(*) FILTER (c.chunk_id IS NULL) AS chunk, count(*) FILTER (d.doc_id IS NULL) AS document, count(*) FILTER (m.model_name IS NULL) AS model
    FROM {VECTORS} v LEFT JOIN {CHUNKS} c USING (chunk_id) LEFT JOIN {DOCS} d ON c.doc_id = d.doc_id AND c.doc_version = d.doc_version LEFT JOIN embedding_models m ON v.model_name = m.model_name AND v.model_version = m.model_version) UNPIVOT (n FOR missing IN (chunk, document, model))""")
def orphan_check(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.orphans(_vectors(spark, folder), _chunks(spark, folder, "doc_id", "doc_version"), _documents(spark, folder), table(spark, folder, "embedding_models"))


@query(f"SELECT chunk_id, doc_id, doc_version FROM {CHUNKS} ANTI JOIN (SELECT chunk_id FROM vectors WHERE collection_name = 'scifact_v2') USING (chunk_id)")
def reconcile_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a collection does not hold yet."""
    held = table(spark, folder, "vectors").filter("collection_name = 'scifact_v2'")
    return C.missing_rows(_chunks(spark, folder, "doc_id", "doc_version"), held, ["chunk_id"]).select("chunk_id", "doc_id", "doc_version")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {s}" for n, s in (("documents", DOCS), ("chunks", CHUNKS), ("vectors", VECTORS), ("chunk_strategies", "chunk_strategies"), ("embedding_models", "embedding_models"))))
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table, deliveries counted once."""
    parts = {"documents": _documents(spark, folder), "chunks": _chunks(spark, folder), "vectors": once(spark, folder, "vectors", []), "chunk_strategies": table(spark, folder, "chunk_strategies"), "embedding_models": table(spark, folder, "embedding_models")}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in parts.items()])


# lineage and staleness ----------------------------------------------------------------------------------------------

_BACK = f"""SELECT v.vector_id, v.collection_name, v.active, v.model_name, v.model_version, m.provider, m.dimensions, c.chunk_id, c.chunk_index, c.chunk_hash, c.strategy_name, c.strategy_version, d.doc_id, d.doc_version, d.title, d.content_hash, (v.pii_masked_flag OR c.pii_masked_flag OR d.pii_masked_flag) AS pii_masked_flag
    FROM {VECTORS} v JOIN embedding_models m ON v.model_name = m.model_name AND v.model_version = m.model_version JOIN {CHUNKS} c ON v.chunk_id = c.chunk_id JOIN {DOCS} d ON c.doc_id = d.doc_id AND c.doc_version = d.doc_version"""


@query(_BACK)
def lineage_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Where every vector comes from."""
    chunks = _chunks(spark, folder, "doc_id", "doc_version", "chunk_index", "chunk_hash", "strategy_name", "strategy_version", "pii_masked_flag")
    return lineage.backward(_vectors(spark, folder), chunks, _documents(spark, folder, "title", "content_hash", "pii_masked_flag"), table(spark, folder, "embedding_models"))


@query(f"""WITH f AS (SELECT c.doc_id, c.doc_version, c.chunk_index, c.chunk_id, v.vector_id, (v.pii_masked_flag OR c.pii_masked_flag OR d.pii_masked_flag) AS flag FROM {CHUNKS} c JOIN {DOCS} d ON c.doc_id = d.doc_id AND c.doc_version = d.doc_version LEFT JOIN {VECTORS} v ON v.chunk_id = c.chunk_id),
    g AS (SELECT doc_id, doc_version, count(DISTINCT chunk_id) AS n_chunks, count(vector_id) AS n_vectors, count(*) FILTER (vector_id IS NOT NULL AND flag) AS n_flagged, arg_min(chunk_id, (chunk_index, chunk_id)) AS first_chunk, min(vector_id) AS first_vector FROM f GROUP BY ALL)
    SELECT d.doc_id, d.doc_version, d.pii_masked_flag, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_vectors, 0) AS n_vectors, coalesce(n_flagged, 0) AS n_flagged, first_chunk, first_vector FROM {DOCS} d LEFT JOIN g USING (doc_id, doc_version)""")
def lineage_forward(spark: SparkSession, folder: str) -> DataFrame:
    """What every document led to, flattened out of the nested result."""
    chunks = _chunks(spark, folder, "doc_id", "doc_version", "chunk_index", "strategy_name", "strategy_version", "pii_masked_flag")
    nested = lineage.forward(_vectors(spark, folder), chunks, _documents(spark, folder, "title", "pii_masked_flag"))
    vectors = F.flatten(F.transform("chunks", lambda c: c["vectors"]))
    return nested.select("doc_id", "doc_version", "pii_masked_flag", F.size("chunks").cast("bigint").alias("n_chunks"), F.size(vectors).cast("bigint").alias("n_vectors"), F.size(F.filter(vectors, lambda v: v["pii_masked_flag"])).cast("bigint").alias("n_flagged"), F.get("chunks", F.lit(0))["chunk_id"].alias("first_chunk"), F.array_min(F.transform(vectors, lambda v: v["vector_id"])).alias("first_vector"))


_LATEST = "(SELECT strategy_version FROM chunk_strategies ORDER BY created_at DESC, strategy_version DESC, strategy_name LIMIT 1)"


@query("SELECT strategy_name, strategy_version FROM chunk_strategies ORDER BY created_at DESC, strategy_version DESC, strategy_name LIMIT 1")
def latest_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.latest_strategy(table(spark, folder, "chunk_strategies")).select("strategy_name", "strategy_version")


@query(f"SELECT v.vector_id FROM {VECTORS} v JOIN {CHUNKS} c ON v.chunk_id = c.chunk_id JOIN {DOCS} d ON c.doc_id = d.doc_id AND c.doc_version = d.doc_version WHERE v.model_version <> '2.0.0' OR c.strategy_version <> {_LATEST}")
def stale_by_version(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of another model or strategy version than the wanted ones."""
    return lineage.stale_by_version(_vectors(spark, folder), _chunks(spark, folder, "doc_id", "doc_version", "strategy_version"), _documents(spark, folder), "2.0.0", None, table(spark, folder, "chunk_strategies"))


@query(f"""SELECT v.model_version, count(*) FILTER (v.model_name <> 'velar-small' OR v.model_version <> '2.0.0' OR c.strategy_version <> {_LATEST}) AS stale, count(*) AS total,
    round(100.0 * count(*) FILTER (v.model_name <> 'velar-small' OR v.model_version <> '2.0.0' OR c.strategy_version <> {_LATEST}) / count(*), 6)::DOUBLE AS stale_percent FROM {VECTORS} v JOIN {CHUNKS} c ON v.chunk_id = c.chunk_id GROUP BY 1""")
def stale_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Stale vectors by model version against the active model and the latest strategy."""
    return lineage.stale_breakdown(_vectors(spark, folder), _chunks(spark, folder, "strategy_version"), "velar-small", "2.0.0", table(spark, folder, "chunk_strategies"))


@query(f"""SELECT name, sum(a)::BIGINT AS active, sum(s)::BIGINT AS stale FROM (SELECT model_name AS name, count(*) FILTER (active) AS a, count(*) FILTER (NOT active) AS s FROM {VECTORS} GROUP BY 1
    UNION ALL SELECT c.strategy_name, count(*) FILTER (v.active), count(*) FILTER (NOT v.active) FROM {VECTORS} v JOIN {CHUNKS} c ON v.chunk_id = c.chunk_id GROUP BY 1) GROUP BY name""")
def stale_active_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Active and inactive vectors by model and by strategy."""
    return lineage.active_flags(_vectors(spark, folder), _chunks(spark, folder, "strategy_name"))


# migration ----------------------------------------------------------------------------------------------------------


def _source(spark, folder):
    sizes = dict(characters=F.char_length(F.coalesce("chunk_text", F.lit(""))), tokens=S.planned_tokens(F.coalesce("chunk_text", F.lit(""))))
    return migration.source_rows(_vectors(spark, folder), once(spark, folder, "chunks", ["strategy_name"], **sizes), *MODEL, "fixed_size_v1")


_SOURCE = f"(SELECT v.vector_id, v.chunk_id, c.chunk_text FROM {VECTORS} v JOIN {CHUNKS} c ON v.chunk_id = c.chunk_id WHERE v.active AND v.model_name = 'velar-small' AND v.model_version = '1.0.0' AND c.strategy_name = 'fixed_size_v1')"


@query(f"""SELECT count(*) AS total_vectors, sum(length(coalesce(chunk_text, '')))::BIGINT AS total_characters, sum(greatest(1, ceil(len(regexp_extract_all(coalesce(chunk_text, ''), '{_W}')) * 1.3)))::BIGINT AS estimated_tokens,
    ceil(count(*) / 64.0)::BIGINT AS batches, ceil(count(*) / 64.0) / 10.0 AS duration_seconds FROM {_SOURCE}""")
def plan_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What re-embedding the active vectors of a model and strategy takes."""
    return migration.plan_totals(_source(spark, folder), 64, 10.0)


@query(f"SELECT chunk_id FROM {CHUNKS} SEMI JOIN {_SOURCE} s USING (chunk_id) ANTI JOIN (SELECT chunk_id FROM vectors WHERE collection_name = 'scifact_v2') t USING (chunk_id)")
def source_chunks_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a migration still has to embed."""
    return migration.due_chunks(_chunks(spark, folder), _source(spark, folder), table(spark, folder, "vectors"), "scifact_v2").select("chunk_id")


@query(f"""WITH n AS (SELECT row_number() OVER (PARTITION BY collection_name ORDER BY vector_id) AS i, collection_name, active FROM {VECTORS}),
    l AS (SELECT collection_name, (i - 1) // 64 AS batch_no, count(*) AS rows, count(*) FILTER (NOT active) AS errors FROM n GROUP BY ALL)
    SELECT collection_name, batch_no, sum(rows) OVER w::BIGINT AS migrated, sum(errors) OVER w::BIGINT AS errors, count(*) OVER w AS completed_batches FROM l WINDOW w AS (PARTITION BY collection_name ORDER BY batch_no ROWS UNBOUNDED PRECEDING)""")
def migration_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals over batches of 64 in each collection, inactive vectors standing for errors."""
    v = numbered(once(spark, folder, "vectors", ["collection_name", "active"]), ["vector_id"], ["collection_name"])
    ledger = v.select("collection_name", "active", batch_number(F.col("row_no"), 64).alias("batch_no")).groupBy("collection_name", "batch_no").agg(F.count("*").alias("rows"), F.count_if(~F.col("active")).alias("errors"))
    return migration.progress(ledger, "collection_name")


@query(f"""WITH s AS (SELECT chunk_id FROM {CHUNKS} SEMI JOIN {_SOURCE} s USING (chunk_id) ANTI JOIN (SELECT chunk_id FROM vectors WHERE collection_name = 'scifact_v2') t USING (chunk_id)),
    n AS (SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) // 64 AS batch_no FROM s) SELECT batch_no, count(*) AS rows, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM n GROUP BY 1""")
def migration_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batches of 64 in which a migration embeds what it still has to."""
    due = migration.due_batches(_chunks(spark, folder), _source(spark, folder), table(spark, folder, "vectors"), "scifact_v2")
    return due.groupBy("batch_no").agg(F.count("*").alias("rows"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


def _flags_sql(off: str, on: str) -> str:
    return f"SELECT collection_name, count(*) FILTER (a) AS active, count(*) FILTER (NOT a) AS inactive FROM (SELECT collection_name, CASE collection_name WHEN '{off}' THEN false WHEN '{on}' THEN true ELSE active END AS a FROM {VECTORS}) GROUP BY 1"


def _flags(spark, folder, off, on):
    return migration.switch_active(_vectors(spark, folder), off, on).groupBy("collection_name").agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"))


@query(_flags_sql("scifact_v1", "scifact_v2"))
def cutover_active_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags after switching to another collection."""
    return _flags(spark, folder, "scifact_v1", "scifact_v2")


@query(_flags_sql("scifact_v2", "scifact_v1"))
def rollback_active_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags after switching back."""
    return _flags(spark, folder, "scifact_v2", "scifact_v1")


@query(f"""SELECT strategy_name, count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(chunk_id || chr(31) || coalesce(chunk_hash, chr(0)) || chr(31) || coalesce(chunk_text, chr(0))), 1, 12))::BIGINT)::DECIMAL(38,0)::VARCHAR AS fingerprint FROM {CHUNKS} GROUP BY 1""")
def chunk_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A fingerprint of each strategy's chunks that does not depend on their order."""
    digest = S.row_digest([F.col("chunk_id"), F.col("chunk_hash"), F.col("chunk_text")])
    return once(spark, folder, "chunks", ["strategy_name"], digest=digest).groupBy("strategy_name").agg(S.fingerprint(F.col("digest")).alias("fingerprint"))


# routing and events -------------------------------------------------------------------------------------------------

_BUCKET = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0,8), lambda i: ('0x'||substr(sha256(q),CAST(i*8+1 AS INTEGER),8))::BIGINT)), lambda a,v: (a*296+v)%1000)"


@query(f"SELECT doc_id, {_BUCKET}::INTEGER AS bucket, CASE WHEN {_BUCKET} / 1000.0 < 0.25 THEN 'live' ELSE 'shadow' END AS route FROM (SELECT doc_id, coalesce(title, '') AS q FROM documents)")
def route_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """The traffic bucket of each title taken as a query, and its route at a quarter of live traffic."""
    q = F.coalesce("title", F.lit(""))
    return table(spark, folder, "documents").select("doc_id", S.traffic_bucket(q).alias("bucket"), S.route(q, 0.25).alias("route"))


@query(f"SELECT route, count(*) AS n FROM ({ORACLES['route_bucket']}) GROUP BY 1")
def route_split(spark: SparkSession, folder: str) -> DataFrame:
    return route_bucket(spark, folder).groupBy("route").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT v.collection_name, v.model_name, v.model_version, c.strategy_name, c.strategy_version, count(*) AS rows FROM {VECTORS} v JOIN {CHUNKS} c ON v.chunk_id = c.chunk_id GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY collection_name ORDER BY model_name, model_version, strategy_name, strategy_version) AS batch_no FROM b),
    e AS (SELECT *, unnest(['START', 'COMPLETE']) AS event_type, sha1(unhex('{S.URL_NAMESPACE}') || encode('batch:' || collection_name || ':' || batch_no)) AS h FROM n)
    SELECT {_UUID} AS run_id, event_type, collection_name, batch_no, 'embed_' || collection_name AS job FROM e""")
def openlineage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Start and completion of the embedding batches of each collection, model and strategy."""
    from strataloom.operators.lineage_events import batch_events

    keys = ["collection_name", "model_name", "model_version", "strategy_name", "strategy_version"]
    rows = _vectors(spark, folder, "dimension", "distance_metric").join(_chunks(spark, folder, "strategy_name", "strategy_version"), "chunk_id")
    batches = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("dimension").alias("dimension"), F.min("distance_metric").alias("distance_metric"))
    batches = batches.join(lineage.config(table(spark, folder, "chunk_strategies").select("strategy_name", "strategy_version", "chunk_size_tokens")), ["strategy_name", "strategy_version"], "left")
    batches = batches.withColumn("batch_no", F.row_number().over(Window.partitionBy("collection_name").orderBy(*keys[1:])))
    return batch_events(batches).select("run_id", "event_type", "collection_name", F.col("batch_no").cast("bigint"), F.get_json_object("event", "$.job.name").alias("job"))


@query("""SELECT metric, error, count(*) AS n FROM (SELECT distance_metric AS metric, unnest(list_filter([CASE WHEN model_name IS NULL THEN 'required:model_name' END, CASE WHEN model_version IS NULL THEN 'required:model_version' END, CASE WHEN dimension IS NULL THEN 'required:dimension' END, 'required:strategy_name', 'required:strategy_version', 'required:chunk_size_tokens',
    CASE WHEN NOT (distance_metric IN ('Cosine', 'Dot', 'Euclidean')) THEN 'enum:distance_metric' END, CASE WHEN dimension < 1 THEN 'minimum:dimension' END], lambda x: x IS NOT NULL)) AS error FROM vectors) GROUP BY ALL""")
def facet_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of the lineage facet that vector rows alone, without their strategy, break."""
    from strataloom.operators.lineage_events import facet_errors as check

    bare = table(spark, folder, "vectors").select("model_name", "model_version", "dimension", "distance_metric", F.lit(None).cast("string").alias("strategy_name"), F.lit(None).cast("string").alias("strategy_version"), F.lit(None).cast("int").alias("chunk_size_tokens"))
    return check(bare).select(F.col("distance_metric").alias("metric"), F.explode("facet_errors").alias("error")).groupBy("metric", "error").agg(F.count("*").alias("n"))


_PART = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0,8), lambda i: ('0x'||substr(sha256(q || '{0}'),CAST(i*8+1 AS INTEGER),8))::BIGINT)), lambda a,v: (a*296+v)%1000) / 1000.0"


@query(f"""SELECT fault, count(*) AS n FROM (SELECT CASE WHEN {_PART.format(':fault')} < 0.3 THEN CASE WHEN {_PART.format(':kind')} < 1.0/3 THEN 'rate_limit' WHEN {_PART.format(':kind')} < 2.0/3 THEN 'connection' ELSE 'malformed' END END AS fault FROM (SELECT vector_id AS q FROM {VECTORS})) GROUP BY 1""")
def fault_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Faults drawn for the writes of a migration, by kind."""
    return migration.fault_ledger(once(spark, folder, "vectors", []), "vector_id", 0.3).groupBy("fault").agg(F.count("*").alias("n"))


@query(f"SELECT collection_name, count(*) FILTER (embedding IS NULL) AS no_vector, count(*) FILTER (embedding IS NOT NULL AND len(embedding) <> dimension) AS wrong_length, count(*) AS vectors FROM {VECTORS} GROUP BY 1")
def collection_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of each collection that cannot be searched."""
    from strataloom.operators.search import collection_violations as check

    v = once(spark, folder, "vectors", ["collection_name", "dimension"], embedding=F.when(F.col("embedding").isNotNull(), F.array_repeat(F.lit(0), F.size("embedding"))))
    return check(v)


# redaction ----------------------------------------------------------------------------------------------------------


@query()
def sanitize_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records with title and text redacted by the fixed patterns, flag and counts."""
    from strataloom.operators.sanitize import sanitize_documents as redact

    done = redact(table(spark, folder, "document_records").select("doc_id", "doc_version", "title", "text"))
    return done.select("doc_id", "doc_version", "pii_masked_flag", F.to_json("redaction_counts").alias("redaction_counts"), F.sha2("text", 256).alias("content_hash")).distinct()


@query()
def sanitize_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many items of each category the records hold."""
    from strataloom.operators.sanitize import redaction_totals

    counts = F.from_json("redaction_counts", "map<string,int>")
    return redaction_totals(sanitize_documents(spark, folder).withColumn("redaction_counts", counts))


_PLAIN = {"ssn_like": r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b", "keyed_id": r"(?i)\b(?:national[ _-]*id|identity[ _-]*number|tax[ _-]*id|ssn) *[:=] *[A-Z0-9][A-Z0-9-]{5,19}\b", "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "provider_token": r"\b(?:sk|pk)-[A-Za-z0-9_-]{16,}\b"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS pattern, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n FROM {DOCS}" for n, p in _PLAIN.items()))
def pii_counts_simple(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of the patterns that need no look-around, by built-in functions."""
    counts = once(spark, folder, "document_records", [], **{n: F.regexp_count("text", F.lit(p)) for n, p in _PLAIN.items()})
    return counts.agg(*(F.sum(n).alias(n) for n in _PLAIN)).unpivot([], list(_PLAIN), "pattern", "n")
