"""Moving a collection to another model: what it takes, which chunks are due, how far it is, and the switch of flags.

The embedder is a plug: a function from a list of texts to a matrix. hash_embedder() is a deterministic stand-in that
needs no model file."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.scalars import batches, fingerprint, planned_tokens, row_digest
from strataloom.operators.lineage_events import batch_events
from strataloom.operators.numbering import batch_number, numbered
from strataloom.session import write_shared


def source_rows(vectors: DataFrame, chunks: DataFrame, model_name: str, model_version: str, strategy_name: str | None = None) -> DataFrame:
    """Active vectors of a model, and of a strategy if one is named, with what chunks holds besides: text, or sizes of it."""
    active = vectors.filter("active").filter((F.col("model_name") == model_name) & (F.col("model_version") == model_version)).select("vector_id", "chunk_id")
    own = chunks.select("chunk_id", "strategy_name", *(c for c in ("chunk_text", "characters", "tokens") if c in chunks.columns))
    if strategy_name is not None:
        own = own.filter(F.col("strategy_name") == strategy_name)
    return active.join(own, "chunk_id")


def plan_totals(rows: DataFrame, batch_size: int = 64, rate_per_second: float = 1.0) -> DataFrame:
    """(total_vectors, total_characters, estimated_tokens, batches, duration_seconds); null texts count as empty.

    rows hold chunk_text, or characters and tokens computed before a join."""
    if batch_size < 1 or rate_per_second <= 0:
        raise ValueError("batch size and rate must be positive")
    text = F.coalesce("chunk_text", F.lit("")) if "chunk_text" in rows.columns else None
    characters, tokens = (F.col("characters"), F.col("tokens")) if text is None else (F.char_length(text), planned_tokens(text))
    sums = rows.agg(F.count("*").alias("total_vectors"), F.coalesce(F.sum(characters), F.lit(0)).alias("total_characters"), F.coalesce(F.sum(tokens), F.lit(0)).alias("estimated_tokens"))
    return sums.withColumn("batches", batches(F.col("total_vectors"), batch_size)).withColumn("duration_seconds", F.col("batches") / F.lit(float(rate_per_second)))


def due_chunks(chunks: DataFrame, source: DataFrame, target_vectors: DataFrame, collection: str) -> DataFrame:
    """Chunks that the source uses and the target collection does not hold yet, so that a broken run can go on."""
    done = target_vectors.filter(F.col("collection_name") == collection).select("chunk_id")
    return chunks.join(source.select("chunk_id"), "chunk_id", "left_semi").join(done, "chunk_id", "left_anti")


def hash_embedder(dimensions: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from hashed words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in text.split() or [""]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
            size = np.linalg.norm(out[i])
            out[i] = out[i] / size if size else np.eye(1, dimensions, 0, dtype=np.float32)[0]
        return out

    return embed


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], dimensions: int) -> DataFrame:
    """(chunk_id, vector); an embedder that gives another number or length of vectors is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = np.asarray(embed([t or "" for t in f["chunk_text"]]), np.float32)
            if vectors.shape != (len(f), dimensions):
                raise ValueError(f"embedder gave {vectors.shape} for {len(f)} texts of {dimensions} dimensions")
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "vector": list(vectors)})

    return chunks.select("chunk_id", "chunk_text").mapInPandas(run, "chunk_id string, vector array<float>")


def shadow_vectors(embedded: DataFrame, migration_id: str, model_name: str, model_version: str, collection: str, dimensions: int, metric: str = "Cosine") -> DataFrame:
    """Rows of the vector table for a migration: inactive, flagged, with ids of migration and chunk."""
    return embedded.select(
        F.concat_ws(":", F.lit(migration_id), F.col("chunk_id")).alias("vector_id"), "chunk_id", F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"), F.lit(collection).alias("collection_name"),
        F.lit(dimensions).alias("dimension"), F.lit(metric).alias("distance_metric"), F.lit(False).alias("active"), F.lit(True).alias("pii_masked_flag"))


def point_payload() -> Column:
    """The payload of a point in the vector store, out of the columns of a vector row joined with its chunk."""
    return F.struct("chunk_id", "doc_id", "chunk_index", "model_name", "model_version", "strategy_name")


def progress(ledger: DataFrame, per: str = "migration_id") -> DataFrame:
    """Running totals over a batch ledger (migration, batch_no, rows, errors)."""
    w = Window.partitionBy(per).orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.select(per, "batch_no", F.sum("rows").over(w).alias("migrated"), F.sum("errors").over(w).alias("errors"), F.count("*").over(w).alias("completed_batches"))


def switch_active(vectors: DataFrame, off: str, on: str) -> DataFrame:
    """The vector table with one collection inactive and another active; the way back is the same with both exchanged."""
    name = F.col("collection_name")
    return vectors.withColumn("active", F.when(name == off, False).when(name == on, True).otherwise(F.col("active")))


def with_retries(batch: Callable[[], int], attempts: int = 4, open_after: int = 4, fault: Callable[[int], Exception | None] = lambda attempt: None, wait: Callable[[int], None] = lambda attempt: None) -> tuple[int, int]:
    """(rows, failed attempts) of a batch that is tried again after a fault, up to `attempts` times or until the circuit opens."""
    failed = 0
    for attempt in range(attempts):
        try:
            if (error := fault(attempt)) is not None:
                raise error
            return batch(), failed
        except (ConnectionError, TimeoutError, ValueError) as error:
            failed += 1
            if failed >= min(open_after, attempts):
                raise RuntimeError(f"gave up after {failed} attempts") from error
            wait(attempt)
    raise RuntimeError("no attempts allowed")


def find_model(models: DataFrame, name: str, version: str | None = None) -> dict:
    """The one model of that full or short name, and version if one is given; KeyError if none or several fit."""
    from strataloom.functions.scalars import short_model_name

    fits = models.filter((F.col("model_name") == name) | (short_model_name(F.col("model_name")) == name))
    if version is not None:
        fits = fits.filter(F.col("model_version") == version)
    rows = fits.limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{len(rows)} models fit {name} {version or ''}")
    return rows[0].asDict()


def fault_ledger(batches_: DataFrame, key: str, fail_rate: float) -> DataFrame:
    """A batch ledger with a fault drawn for each batch."""
    from strataloom.functions.scalars import fault

    return batches_.withColumn("fault", fault(F.col(key), fail_rate))


@dataclass
class Applied:
    """What a run did: vectors of this run, its batch ledger with running totals, batches that were given up."""

    vectors: DataFrame
    progress: DataFrame
    failed_batches: int


def due_batches(chunks: DataFrame, source: DataFrame, target_vectors: DataFrame, collection: str, batch_size: int = 64) -> DataFrame:
    """due_chunks() in the order of their ids with batch_no from 0, batch_size rows each but the last."""
    due = numbered(due_chunks(chunks, source, target_vectors, collection), ["chunk_id"])
    return due.withColumn("batch_no", batch_number(F.col("row_no"), batch_size)).drop("row_no")


def embed_batches(due: DataFrame, embed: Callable[[list[str]], np.ndarray], dimensions: int, attempts: int = 4, fault: Callable[[int, int], Exception | None] = lambda batch, attempt: None, base_wait: float = 0.0) -> DataFrame:
    """(chunk_id, batch_no, vector, failures, error) of due_batches(): each batch is embedded by itself and tried again after
    a fault, with waits that double; a batch that is given up has null vectors and its error."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:  # at most batch_size rows
        number = int(rows["batch_no"].iloc[0])
        texts = [t or "" for t in rows["chunk_text"]]
        made: list = []
        failed = 0

        def batch() -> int:
            vectors = np.asarray(embed(texts), np.float32)
            if vectors.shape != (len(texts), dimensions):
                raise TypeError(f"embedder gave {vectors.shape} for {len(texts)} texts of {dimensions} dimensions")
            made[:] = list(vectors)
            return len(made)

        def wait(attempt: int) -> None:
            time.sleep(base_wait * 2**attempt * (0.5 + np.random.default_rng([number, attempt]).random()))

        error = None
        try:
            _, failed = with_retries(batch, attempts, attempts, lambda attempt: fault(number, attempt), wait)
        except RuntimeError as gave_up:
            failed, error, made[:] = attempts, f"{gave_up}: {gave_up.__cause__}", [None] * len(texts)
        return pd.DataFrame({"chunk_id": rows["chunk_id"], "batch_no": number, "vector": made, "failures": failed, "error": error})

    return due.select("chunk_id", "chunk_text", "batch_no").groupBy("batch_no").applyInPandas(one, "chunk_id string, batch_no bigint, vector array<float>, failures int, error string")


def batch_ledger(embedded: DataFrame, migration: str) -> DataFrame:
    """(migration_id, batch_no, rows, errors): rows embedded and failed attempts of each batch."""
    own = embedded.groupBy("batch_no").agg(F.count("vector").alias("rows"), F.max("failures").cast("bigint").alias("errors"))
    return own.select(F.lit(migration).alias("migration_id"), "batch_no", "rows", "errors")


def apply(catalog, source: tuple[str, str], target: tuple[str, str], collection: str, migration: str, embed: Callable[[list[str]], np.ndarray], dimensions: int, strategy_name: str | None = None, batch_size: int = 64, attempts: int = 4, fault: Callable[[int, int], Exception | None] = lambda batch, attempt: None) -> Applied:
    """Embeds what a source model's active vectors need in a target collection.

    Vectors are written first, to the catalog's log `vectors-COLLECTION`; only then do rows of the batches that succeeded
    enter the vector table, inactive, in one transaction with the lineage events. A batch that is given up leaves no row, so the next
    run takes it up again, and so does a run after a driver's death in between: vectors without a row are embedded anew
    and the last ones count (stored_vectors)."""
    chunks = catalog.table("chunks")
    rows = source_rows(catalog.table("vectors"), chunks, *source, strategy_name)
    due = due_batches(chunks, rows, catalog.table("vectors"), collection, batch_size)
    embedded = write_shared(embed_batches(due, embed, dimensions, attempts, fault))
    good = embedded.filter("vector is not null")
    vectors = good.select("chunk_id", "vector")
    if not good.isEmpty():
        catalog.append(f"vectors-{collection}", vectors.withColumns({"migration_id": F.lit(migration), "written_at": F.current_timestamp()}))
        new = shadow_vectors(good, migration, *target, collection, dimensions)
        catalog.insert("vectors", new)
        sizes = chunks.select("chunk_id", "strategy_name", "strategy_version").join(catalog.table("chunk_strategies").select("strategy_name", "strategy_version", "chunk_size_tokens"), ["strategy_name", "strategy_version"], "left")
        batches_ = good.select("chunk_id", "batch_no").join(sizes, "chunk_id").groupBy("batch_no", "strategy_name", "strategy_version", "chunk_size_tokens").agg(F.count("*").alias("rows"))
        facet = {"collection_name": F.lit(collection), "model_name": F.lit(target[0]), "model_version": F.lit(target[1]), "dimension": F.lit(dimensions), "distance_metric": F.lit("Cosine")}
        catalog.append("lineage_events", batch_events(batches_.withColumns(facet), run=migration))
    failed = embedded.filter("vector is null").select("batch_no").distinct().count()
    return Applied(vectors, progress(batch_ledger(embedded, migration)), failed)


def stored_vectors(catalog, collection: str) -> DataFrame:
    """(chunk_id, vector) of a collection's log, the last written of each chunk that the vector table has."""
    held = catalog.table("vectors").filter(F.col("collection_name") == collection).select("chunk_id")
    last = catalog.log(f"vectors-{collection}").groupBy("chunk_id").agg(F.max_by("vector", "written_at").alias("vector"))
    return last.join(held, "chunk_id", "left_semi")


def fault_run(catalog, *args, **kwargs) -> dict:
    """apply() under faults, with proof that what it read did not change: fingerprints of chunks and of the source's vectors."""
    def prints() -> tuple:
        own = catalog.table("vectors").filter((F.col("model_name") == args[0][0]) & (F.col("model_version") == args[0][1]) & (F.col("collection_name") != args[2]))
        return tuple(df.select(row_digest([F.col(c) for c in df.columns]).alias("d")).agg(fingerprint(F.col("d"))).first()[0] for df in (catalog.table("chunks"), own))

    before = prints()
    done = apply(catalog, *args, **kwargs)
    last = done.progress.agg(F.max("migrated").alias("migrated"), F.max("errors").alias("errors"), F.max("completed_batches").alias("batches")).first()
    return {"migrated": last.migrated or 0, "failed_attempts": last.errors or 0, "batches": last.batches or 0, "failed_batches": done.failed_batches, "source_unchanged": prints() == before}
