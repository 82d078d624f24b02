"""The catalog's tables: columns with types, keys, references and checks."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Table:
    """columns in SQL types; required ones must not be null; defaults are SQL expressions."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)

    @property
    def ddl(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items())


_FLAG = {"pii_masked_flag": "false", "created_at": "current_timestamp()"}

DOCUMENTS = Table(
    "documents", dict(doc_id="string", doc_version="int", title="string", source_uri="string", author="string", classification_level="string", language="string", content_hash="string", pii_masked_flag="boolean", created_at="timestamp"),
    ("doc_id", "doc_version"), ("title", "source_uri", "author", "classification_level", "language", "pii_masked_flag", "created_at"), _FLAG | {"doc_version": "1"})
CHUNK_STRATEGIES = Table(
    "chunk_strategies", dict(strategy_name="string", strategy_version="string", splitter_type="string", chunk_size_tokens="int", chunk_overlap_tokens="int", tokenizer_name="string", pii_masked_flag="boolean", created_at="timestamp"),
    ("strategy_name", "strategy_version"), ("splitter_type", "chunk_size_tokens", "chunk_overlap_tokens", "tokenizer_name", "pii_masked_flag", "created_at"), _FLAG | {"chunk_overlap_tokens": "0"},
    checks={"size_positive": "chunk_size_tokens > 0", "overlap_in_size": "chunk_overlap_tokens >= 0 and chunk_overlap_tokens < chunk_size_tokens"})
CHUNKS = Table(
    "chunks", dict(chunk_id="string", doc_id="string", doc_version="int", strategy_name="string", strategy_version="string", chunk_index="int", chunk_text="string", chunk_hash="string", tokenizer_name="string", pii_masked_flag="boolean", created_at="timestamp"),
    ("chunk_id",), ("doc_id", "doc_version", "strategy_name", "strategy_version", "chunk_index", "chunk_text", "chunk_hash", "pii_masked_flag", "created_at"), _FLAG | {"doc_version": "1"},
    unique=(("doc_id", "doc_version", "chunk_index"),),
    references=((("doc_id", "doc_version"), "documents", ("doc_id", "doc_version")), (("strategy_name", "strategy_version"), "chunk_strategies", ("strategy_name", "strategy_version"))))
EMBEDDING_MODELS = Table(
    "embedding_models", dict(model_name="string", model_version="string", provider="string", dimensions="int", pricing_usd_per_1k_tokens="double", latency_ms_p95="double", status="string", pii_masked_flag="boolean", created_at="timestamp"),
    ("model_name", "model_version"), ("provider", "dimensions", "pricing_usd_per_1k_tokens", "status", "pii_masked_flag", "created_at"), _FLAG | {"pricing_usd_per_1k_tokens": "0", "status": "'active'"},
    checks={"dimensions_positive": "dimensions > 0", "price_not_negative": "pricing_usd_per_1k_tokens >= 0"})
VECTORS = Table(
    "vectors", dict(vector_id="string", chunk_id="string", model_name="string", model_version="string", collection_name="string", dimension="int", distance_metric="string", active="boolean", pii_masked_flag="boolean", created_at="timestamp"),
    ("vector_id",), ("chunk_id", "model_name", "model_version", "collection_name", "dimension", "distance_metric", "active", "pii_masked_flag", "created_at"), _FLAG | {"distance_metric": "'Cosine'", "active": "true"},
    references=((("chunk_id",), "chunks", ("chunk_id",)), (("model_name", "model_version"), "embedding_models", ("model_name", "model_version"))),
    checks={"dimension_positive": "dimension > 0", "metric_known": "distance_metric in ('Cosine', 'Dot', 'Euclidean')"})
MIGRATIONS = Table(
    "migrations", dict(migration_id="string", source_model_name="string", source_model_version="string", target_model_name="string", target_model_version="string", source_strategy_name="string", source_strategy_version="string", target_strategy_name="string", target_strategy_version="string", status="string", total_vectors="bigint", migrated_vectors="bigint", total_characters="bigint", estimated_tokens="bigint", estimated_cost_usd="double", estimated_duration_seconds="double", error_count="int", predicted_retrieval_drift="double", batch_size="int", rate_limit_per_second="double", started_at="timestamp", completed_at="timestamp", pii_masked_flag="boolean", created_at="timestamp", error_rate="double"),
    ("migration_id",), ("source_model_name", "source_model_version", "target_model_name", "target_model_version", "status", "total_vectors", "migrated_vectors"),
    _FLAG | dict(total_vectors="0", migrated_vectors="0", total_characters="0", estimated_tokens="0", estimated_cost_usd="0", estimated_duration_seconds="0", error_count="0", predicted_retrieval_drift="0", batch_size="64", rate_limit_per_second="1", error_rate="0"),
    references=((("source_model_name", "source_model_version"), "embedding_models", ("model_name", "model_version")), (("target_model_name", "target_model_version"), "embedding_models", ("model_name", "model_version"))),
    checks={"migrated_in_total": "migrated_vectors >= 0 and migrated_vectors <= total_vectors"})
MIGRATION_EVENTS = Table(
    "migration_events", dict(event_id="string", migration_id="string", event_type="string", details_json="string", created_at="timestamp"),
    ("event_id",), ("migration_id", "event_type", "created_at"), {"created_at": "current_timestamp()"}, references=((("migration_id",), "migrations", ("migration_id",)),))
RETRIEVAL_EVAL_RUNS = Table(
    "retrieval_eval_runs", dict(run_id="string", migration_id="string", model_name="string", model_version="string", strategy_name="string", strategy_version="string", dataset_name="string", recall_at_5="double", recall_at_10="double", ndcg_at_10="double", mrr="double", cosine_drift="double", error_rate="double", status="string", metrics_json="string", started_at="timestamp", completed_at="timestamp", pii_masked_flag="boolean", created_at="timestamp"),
    ("run_id",), ("model_name", "model_version", "dataset_name", "error_rate", "status"), _FLAG | {"error_rate": "0", "status": "'completed'"},
    references=((("migration_id",), "migrations", ("migration_id",)), (("model_name", "model_version"), "embedding_models", ("model_name", "model_version"))))

TABLES = {t.name: t for t in (DOCUMENTS, CHUNK_STRATEGIES, CHUNKS, EMBEDDING_MODELS, VECTORS, MIGRATIONS, MIGRATION_EVENTS, RETRIEVAL_EVAL_RUNS)}
