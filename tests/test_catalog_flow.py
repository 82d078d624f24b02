import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.api import Service, main
from strataloom.operators import bootstrap, drift, evaluation, lineage, lineage_events, migration, search, telemetry
from strataloom.operators.catalog import Catalog
from strataloom.operators.chunking import ChunkStrategy
from strataloom.sources.text_files import DOCUMENT
from strataloom.streaming import rates


@pytest.fixture
def seeded(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    make = spark.createDataFrame
    c.insert("documents", make([("doc-1", "T", "u", "a", "public", "en", "doc-hash", True)], "doc_id string, title string, source_uri string, author string, classification_level string, language string, content_hash string, pii_masked_flag boolean"))
    c.insert("chunk_strategies", make([("s", "1.0.0", "x", 300, 30, "t", "2024-01-01"), ("s", "2.0.0", "x", 500, 50, "t", "2024-01-02")], "strategy_name string, strategy_version string, splitter_type string, chunk_size_tokens int, chunk_overlap_tokens int, tokenizer_name string, created_at string"))
    c.insert("chunks", make([("doc-1:0000", "doc-1", 1, "s", "1.0.0", 0, "Text", "h", True)], "chunk_id string, doc_id string, doc_version int, strategy_name string, strategy_version string, chunk_index int, chunk_text string, chunk_hash string, pii_masked_flag boolean"))
    c.insert("embedding_models", make([("bge-small", "1.0.0", "fastembed", 384), ("bge-small", "2.0.0", "fastembed", 384)], "model_name string, model_version string, provider string, dimensions int"))
    c.insert("vectors", make([("vec_0001", "doc-1:0000", "bge-small", "1.0.0", "scifact_v1", 384, False), ("vec_0002", "doc-1:0000", "bge-small", "2.0.0", "scifact_v2", 384, True)], "vector_id string, chunk_id string, model_name string, model_version string, collection_name string, dimension int, active boolean"))
    return c


def test_lineage_seed(seeded):
    t = seeded.table
    back = lineage.vector_provenance(lineage.backward(t("vectors"), t("chunks"), t("documents"), t("embedding_models")), "vec_0001")
    assert back["provider"] == "fastembed" and back["pii_masked_flag"] is True and back["doc_id"] == "doc-1"
    with pytest.raises(KeyError, match="nope"):
        lineage.vector_provenance(lineage.backward(t("vectors"), t("chunks"), t("documents"), t("embedding_models")), "nope")
    d = lineage.forward(t("vectors"), t("chunks"), t("documents")).first()
    assert len(d.chunks) == 1 and [v.vector_id for v in d.chunks[0].vectors] == ["vec_0001", "vec_0002"] and d.chunks[0].vectors[0].pii_masked_flag
    stale = lineage.stale_by_version(t("vectors"), t("chunks"), t("documents"), "2.0.0", "1.0.0")
    assert [r.vector_id for r in stale.collect()] == ["vec_0001"]
    assert lineage.stale_by_version(t("vectors"), t("chunks"), t("documents"), "2.0.0", None, t("chunk_strategies")).count() == 2
    assert {r.missing: r.n for r in lineage.orphans(t("vectors"), t("chunks"), t("documents"), t("embedding_models")).collect()} == {"chunk": 0, "document": 0, "model": 0}
    assert {r.name: (r.active, r.stale) for r in lineage.active_flags(t("vectors"), t("chunks")).collect()} == {"bge-small": (1, 1), "s": (1, 1)}


def test_inserts_are_checked(seeded, spark):
    make, before = spark.createDataFrame, seeded.table("vectors").count()
    v = "vector_id string, chunk_id string, model_name string, model_version string, collection_name string, dimension int"
    for row, what in [(("v9", "gone", "bge-small", "1.0.0", "c", 3), "chunks"), (("vec_0001", "doc-1:0000", "bge-small", "1.0.0", "c", 3), "primary_key"), (("v9", "doc-1:0000", "bge-small", "1.0.0", "c", 0), "dimension_positive"), ((None, "doc-1:0000", "bge-small", "1.0.0", "c", 3), "key_null"), (("v9", "doc-1:0000", "bge-small", "1.0.0", None, 3), "not_null_collection_name")]:
        with pytest.raises(ValueError, match=what):
            seeded.insert("vectors", make([row], v))
    assert seeded.table("vectors").count() == before
    with pytest.raises(KeyError):
        seeded.insert("nowhere", make([(1,)], "a int"))
    with pytest.raises(ValueError):
        seeded.insert("vectors", make([(1,)], "a int"))
    assert seeded.query("select count(*) n from vectors where model_version = :v", v="1.0.0").first().n == 1


def test_transactions(seeded, spark):
    with pytest.raises(RuntimeError):
        with seeded.transaction():
            seeded.replace("vectors", seeded.table("vectors").limit(0))
            assert seeded.table("vectors").count() == 0
            raise RuntimeError("broken")
    assert seeded.table("vectors").count() == 2
    service = Service(seeded, policy={"active_collection": "scifact_v1", "active_model": "bge-small", "active_version": "2.0.0"})
    service.cutover("scifact_v2", "scifact_v1")
    assert {r.collection_name: r.active for r in seeded.table("vectors").collect()} == {"scifact_v1": True, "scifact_v2": False}
    with pytest.raises(ValueError):
        service.cutover("scifact_v1", "nowhere")
    assert Service(Catalog(spark, seeded.folder)).policy["active_collection"] == "scifact_v1"  # it outlives the service
    assert service.rollback()["active_collection"] == "scifact_v2" and seeded.alias("active") == "scifact_v2"
    assert service.routing(active_model=None)["active_collection"] == "scifact_v2" and service.routing(active_model="m")["active_model"] == "m"
    assert service.status()["vectors"] == 2 and service.health() == {"status": "ok"}
    service.routing(active_model="bge-small")
    assert service.staleness()["total"] == 2 and service.lineage("vec_0002")["chunk_id"] == "doc-1:0000"


def test_migration_seed(spark, seeded):
    rows = spark.createDataFrame([("v1", "c1", "one two three")], "vector_id string, chunk_id string, chunk_text string")
    plan = migration.plan_totals(rows, 1, 2).first()
    assert (plan.total_vectors, plan.total_characters, plan.estimated_tokens, plan.duration_seconds) == (1, 13, 4, 0.5)
    empty = migration.plan_totals(rows.limit(0)).first()
    assert (empty.total_vectors, empty.batches, empty.estimated_tokens) == (0, 0, 0)
    chunks = seeded.table("chunks")
    vectors = migration.embed_chunks(chunks, migration.hash_embedder(8), 8)
    assert len(vectors.first().vector) == 8
    shadow = migration.shadow_vectors(vectors, "mig_1", "bge-small", "2.0.0", "shadow", 8)
    assert seeded.insert("vectors", shadow) == 1
    row = seeded.table("vectors").filter("collection_name = 'shadow'").first()
    assert row.vector_id == "mig_1:doc-1:0000" and not row.active and row.pii_masked_flag
    assert migration.due_chunks(chunks, chunks, seeded.table("vectors"), "shadow").count() == 0 and migration.due_chunks(chunks, chunks, seeded.table("vectors"), "other").count() == 1
    with pytest.raises(Exception, match="dimensions"):
        migration.embed_chunks(chunks, migration.hash_embedder(7), 8).collect()
    assert migration.with_retries(lambda: 5, fault=lambda a: ConnectionError() if a == 0 else None) == (5, 1)
    with pytest.raises(RuntimeError, match="4 attempts"):
        migration.with_retries(lambda: 5, fault=lambda a: ConnectionError())


def test_apply_goes_on_where_it_broke(spark, seeded):
    embed = migration.hash_embedder(8)
    down = migration.apply(seeded, ("bge-small", "2.0.0"), ("bge-small", "1.0.0"), "next", "mig_1", embed, 8, fault=lambda batch, attempt: ConnectionError("down"))
    assert down.failed_batches == 1 and down.vectors.count() == 0 and seeded.table("vectors").filter("collection_name = 'next'").count() == 0
    done = migration.apply(seeded, ("bge-small", "2.0.0"), ("bge-small", "1.0.0"), "next", "mig_2", embed, 8, fault=lambda batch, attempt: ConnectionError() if attempt == 0 else None)
    last = done.progress.first()
    assert done.vectors.count() == 1 and (last.migrated, last.errors, last.completed_batches) == (1, 1, 1) and migration.stored_vectors(seeded, "next").count() == 1
    assert sorted(r.event_type for r in seeded.log("lineage_events").collect()) == ["COMPLETE", "START"] and seeded.table("vectors").filter("collection_name = 'next' and not active").count() == 1
    assert migration.apply(seeded, ("bge-small", "2.0.0"), ("bge-small", "1.0.0"), "next", "mig_3", embed, 8).vectors.count() == 0
    assert migration.find_model(seeded.table("embedding_models"), "bge-small", "2.0.0")["provider"] == "fastembed"
    for args in (("bge-small",), ("none",)):
        with pytest.raises(KeyError):
            migration.find_model(seeded.table("embedding_models"), *args)
    store = spark.createDataFrame([("a", "x", 2, "Cosine"), ("b", "x", 3, "Cosine")], "item_id string, collection_name string, dimension int, distance_metric string")
    with pytest.raises(ValueError):
        search.verify_collection(store, "x", 2)
    search.verify_collection(store, "y", 2)


def test_batches_of_a_migration(spark, seeded):
    n = 1000
    rows = spark.range(n).select(F.format_string("d:%04d", "id").alias("chunk_id"), F.lit("doc-1").alias("doc_id"), F.lit(1).alias("doc_version"), F.lit("s").alias("strategy_name"), F.lit("1.0.0").alias("strategy_version"), (F.col("id") + 10).cast("int").alias("chunk_index"), F.col("id").cast("string").alias("chunk_text"), F.lit("h").alias("chunk_hash"))
    seeded.insert("chunks", rows)
    seeded.insert("vectors", rows.select(F.concat(F.lit("v"), "chunk_id").alias("vector_id"), "chunk_id", F.lit("bge-small").alias("model_name"), F.lit("2.0.0").alias("model_version"), F.lit("scifact_v2").alias("collection_name"), F.lit(8).alias("dimension")))
    args = (("bge-small", "2.0.0"), ("bge-small", "1.0.0"), "next", "mig_5", migration.hash_embedder(8), 8)
    done = migration.fault_run(seeded, *args, fault=lambda batch, attempt: ConnectionError() if batch == 3 or batch % 2 and attempt < 1 else None)
    assert done == {"migrated": 1001 - 64, "failed_attempts": 4 + 7, "batches": 16, "failed_batches": 1, "source_unchanged": True}
    rest = migration.apply(seeded, *args)
    assert [r["rows"] for r in migration.batch_ledger(migration.embed_batches(migration.due_batches(seeded.table("chunks"), seeded.table("chunks"), seeded.table("vectors").limit(0), "x"), args[4], 8), "m").orderBy("batch_no").collect()] == [64] * 15 + [41]
    assert rest.vectors.count() == 64 and migration.stored_vectors(seeded, "next").count() == 1001 == seeded.table("vectors").filter("collection_name = 'next'").count()


def test_two_writers(spark, seeded):
    from strataloom.sources.pointer import Conflict

    other = Catalog(spark, seeded.folder)
    with pytest.raises(Conflict):
        with seeded.transaction():
            seeded.set_alias("live", "a")
            other.set_alias("live", "b")
    assert seeded.alias("live") == "b" and other.set_alias("live", "c") == "b"


def test_numbers_and_percentiles_over_partitions(spark):
    from strataloom.operators.numbering import exact_percentiles, numbered

    rng = np.random.default_rng(1)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400))] + [(None, 5), (None, 6)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g int, v int, i int")
    want, seen = {}, {}
    for g, v, i in sorted([(g, v, i) for i, (g, v) in enumerate(rows)], key=lambda r: (r[0] is not None, r)):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r.i: r.row_no for r in numbered(df, ["v", "i"], ["g"]).collect()} == want
    assert sorted(r.row_no for r in numbered(df, ["v", "i"]).collect()) == list(range(1, 403)) and numbered(df.limit(0), ["v"]).count() == 0
    for r in exact_percentiles(df, "v", ["g"], [0.5, 0.95, 1.0, 0.0]).collect():
        assert math.isclose(r.value, np.percentile([v for g, v in rows if g == r.g], r.share * 100))


def test_gate_between_collections(spark, tmp_path):
    from strataloom.api import quality_gate

    store = spark.createDataFrame([("a", "old", [1.0, 0.0]), ("b", "old", [0.0, 1.0]), ("a", "new", [1.0, 0.1]), ("b", "new", [0.9, 1.0])], "item_id string, collection_name string, vector array<double>")
    queries = spark.createDataFrame([("q", [0.2, 1.0])], "query_id string, vector array<double>")
    qrels = spark.createDataFrame([("q", "b")], "query_id string, doc_id string")
    assert quality_gate(store, queries, qrels, "old", "new")["passed"]
    swapped = store.withColumn("item_id", F.when(F.col("collection_name") == "old", F.col("item_id")).otherwise(F.translate("item_id", "ab", "ba")))
    assert not quality_gate(swapped, queries, qrels, "old", "new")["passed"]
    c = Catalog(spark, str(tmp_path / "c"))
    c.insert("embedding_models", spark.createDataFrame([("m", "1", "p", 2)], "model_name string, model_version string, provider string, dimensions int"))
    failed = quality_gate(store, queries, qrels, "old", "new", errors=spark.createDataFrame([("q", "timeout")], "query_id string, error string"), catalog=c, model=("m", "1"))
    assert failed["error_rate"] == 1.0 and not failed["passed"] and quality_gate(store, queries, qrels, "old", "new", catalog=c, model=("m", "1"))["passed"]
    assert sorted((r.dataset_name, r.status, r.error_rate) for r in c.table("retrieval_eval_runs").collect()) == [("old-new:baseline", "failed", 0.0), ("old-new:baseline", "passed", 0.0), ("old-new:candidate", "failed", 1.0), ("old-new:candidate", "passed", 0.0)]


def test_bootstrap_twice(spark, tmp_path):
    meta = ("u", "a", "public", "en")
    records = spark.createDataFrame([("d1", "T", "mail a@b.co " + "w " * 12, meta), ("d2", "T", "x y", meta), ("d3", None, "x", meta)], DOCUMENT)
    c = Catalog(spark, str(tmp_path / "c"))
    run = lambda: bootstrap.run(records, c, ChunkStrategy("s", "1", 8, 2), "m", "1", "col", migration.hash_embedder(4), 4)
    report, vectors = run()
    assert (report.valid, report.invalid, report.chunks, report.vectors) == (2, 1, 3, 3) and vectors.count() == 3
    assert sorted(r.vector_id for r in c.table("vectors").collect()) == ["vec_0001", "vec_0002", "vec_0003"]
    assert c.table("documents").filter("doc_id = 'd1'").first().pii_masked_flag and "a@b.co" not in "".join(r.chunk_text for r in c.table("chunks").collect())
    assert run()[0].vectors == 0 and c.table("chunks").count() == 3


def test_ir_metrics(spark):
    q = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c"), ("q3", "z"), ("q4", None)], "query_id string, doc_id string")
    r = spark.createDataFrame([("q1", "x", 1), ("q1", "a", 2), ("q1", "b", 3), ("q2", "c", 1), ("q2", "y", 2), ("q9", "a", 1)], "query_id string, doc_id string, rank int")
    m = {x.query_id: x for x in evaluation.query_metrics(q, r).collect()}
    assert set(m) == {"q1", "q2", "q3", "q4"} and m["q1"].recall_at_5 == 1 and m["q1"].reciprocal_rank == 0.5 and math.isclose(m["q1"].ndcg_at_10, 0.693426, abs_tol=1e-6)
    assert m["q3"].recall_at_10 == 0 and m["q4"].recall_at_10 == 0 and m["q4"].ndcg_at_10 == 0
    two = evaluation.macro(evaluation.query_metrics(q.filter("query_id < 'q3'"), r)).first()
    assert math.isclose(two.mrr, 0.75) and math.isclose(two.ndcg_at_10, 0.846713, abs_tol=1e-6)
    twice = spark.createDataFrame([("q", "a", 1), ("q", "a", 2)], r.schema)
    one = spark.createDataFrame([("q", "a")], q.schema)
    assert math.isclose(evaluation.query_metrics(one, twice).first().ndcg_at_10, 1.630930, abs_tol=1e-6) and evaluation.query_metrics(one, twice, dedupe=True).first().ndcg_at_10 == 1
    with pytest.raises(Exception, match="no queries"):
        evaluation.macro(evaluation.query_metrics(q.limit(0), r)).collect()
    a = evaluation.macro(evaluation.query_metrics(one, twice, True))
    b = evaluation.macro(evaluation.query_metrics(one, spark.createDataFrame([("q", "y", 1), ("q", "a", 2)], r.schema)))
    assert evaluation.gate(a, a).first().passed and not evaluation.gate(a, b).first().passed
    p = evaluation.latency_summary(spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4)], "k string, v double"), "v", ["k"]).first()
    assert p.p50 == 2.5 and p.mean == 2.5


def vec(spark, rows):
    return spark.createDataFrame([(f"c{i}", [float(x) for x in v]) for i, v in enumerate(rows)], "item_id string, vector array<double>")


def test_drift(spark):
    same = drift.report(vec(spark, [[i, 1, 0] for i in range(6)]), vec(spark, [[i, 1, 0, 0] for i in range(6)]), k=2).first()
    assert (same.dimensions_before, same.dimensions_after, same.jaccard_mean, same.collapse, same["shift"]) == (3, 4, 1.0, False, False)
    a, b = vec(spark, [[i, 1] for i in range(8)]), vec(spark, [[1, 1, 1]] * 8)
    one, two = (drift.report(a, b, n=5, seed=7).first() for _ in range(2))
    assert one == two and one.sampled == 5 and one.collapse and one["shift"]
    for x, y in ((a, b.withColumn("item_id", F.concat("item_id", F.lit("z")))), (a, vec(spark, [[0, 0]] * 8))):
        with pytest.raises(ValueError):
            drift.report(x, y)


@pytest.mark.parametrize("metric", search.METRICS)
def test_search_blocks_equal_brute_force(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5)).round(1)
    x[7] = x[3]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0])], "item_id int, vector array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(12)] + [(80, None)], "query_id int, vector array<double>")
    want = set()
    for i in range(12):
        s = np.round(search.score_matrix(x[i : i + 1], x, metric)[0], 9)
        want |= {(i, int(j), n + 1) for n, j in enumerate(sorted(range(60), key=lambda j: (-s[j], j))[:4])}
    got = lambda: {(r.query_id, r.item_id, r["rank"]) for r in search.top_k(corpus, queries, 4, metric).collect()}
    assert got() == want
    monkeypatch.setattr(search, "MOST_QUERIES", 5)
    monkeypatch.setattr(search, "CORPUS_BLOCK", 20)
    assert got() == want
    with pytest.raises(ValueError):
        search.top_k(corpus, queries, 0)
    with pytest.raises(ValueError):
        search.top_k(corpus, queries, 1, "Manhattan")


def test_service_search(spark, seeded):
    embed = migration.hash_embedder(16)
    texts = {"a": "red apple", "b": "green pear", "c": "slow train"}
    store = spark.createDataFrame([(k, "live", embed([t])[0].tolist()) for k, t in texts.items()], "item_id string, collection_name string, vector array<double>")
    s = Service(seeded, store, embed, {"active_collection": "live", "active_model": "m"})
    hits = s.search("green pear", 2)
    assert hits[0]["id"] == "b" and abs(hits[0]["score"] - 1) < 1e-6 and 'embedding_tokens_total{model_name="m"} 2.0' in s.metrics()
    both = store.unionByName(store.filter("item_id <> 'b'").withColumn("collection_name", F.lit("next")))
    s = Service(seeded, both, embed, {"active_collection": "live", "shadow_collection": "next", "shadow_read_enabled": True})
    assert s.search("green pear", 2)[0]["id"] == "b" and "shadow_reads_total 1.0" in s.metrics() and "shadow_shared_items_total" in s.metrics() and "shadow_latency_delta_seconds_sum" in s.metrics()

    def broken(texts):
        raise ConnectionError

    s = Service(seeded, both, embed, s.policy, shadow_embed=broken)
    assert s.search("green pear", 1)[0]["id"] == "b" and "shadow_errors_total 1.0" in s.metrics()
    seeded.set_alias("active", "next")
    assert "b" not in [h["id"] for h in s.search("green pear", 2)]


def test_facets_and_events(spark):
    schema = "collection_name string, batch_no int, model_name string, model_version string, dimension int, distance_metric string, strategy_name string, strategy_version string, chunk_size_tokens int"
    df = spark.createDataFrame([("c", 1, "m", "1", 384, "Cosine", "s", "1", 300), ("c", 2, None, "1", 0, "Manhattan", "s", "1", None)], schema)
    found = [r.facet_errors for r in lineage_events.facet_errors(df).orderBy("batch_no").collect()]
    assert found == [[], ["required:model_name", "required:chunk_size_tokens", "enum:distance_metric", "minimum:dimension"]]
    events = [json.loads(r.event) for r in lineage_events.batch_events(df.filter("batch_no = 1")).collect()]
    assert [e["eventType"] for e in events] == ["START", "COMPLETE"] and events[0]["run"] == events[1]["run"]
    assert events[0]["outputs"][0]["name"] == "vectors_c" and events[0]["outputs"][0]["facets"]["vectorEmbedding"]["dimension"] == 384


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 9:02d}:{i % 60:02d}", "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string, k string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rates.stream_rate(rates.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema), "ts", ["k"])
    got = rates.run_once(stream, ["window_start", "k"], str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, telemetry.rate(df, "ts", ["k"]).collect()))
    h = telemetry.histogram(spark.createDataFrame([(0.01,), (0.3,), (99.0,), (None,)], "v double"), F.col("v"), [], telemetry.HTTP_BUCKETS)
    assert {r.le: r.n for r in h.collect()}[0.01] == 1 and {r.le: r.n for r in h.collect()}[float("inf")] == 3


def test_command_line(spark, seeded, capsys):
    assert main(["--catalog", seeded.folder, "lineage", "vec_0001"]) == 0 and "fastembed" in capsys.readouterr().out
    assert main(["--catalog", seeded.folder, "lineage", "none"]) == 1
    assert main(["--catalog", seeded.folder, "plan", "bge-small", "2.0.0"]) == 0 and '"total_vectors": 1' in capsys.readouterr().out
    assert main(["--catalog", seeded.folder, "status"]) == 0 and main(["--catalog", seeded.folder, "staleness", "bge-small", "2.0.0"]) == 0
    assert main(["--catalog", seeded.folder, "apply", "bge-small", "2.0.0", "bge-small", "1.0.0", "next", "mig_9"]) == 0 and '"vectors": 1' in capsys.readouterr().out
    assert main(["--catalog", seeded.folder, "faults", "1.0"]) == 0 and "None" not in capsys.readouterr().out
    store = spark.createDataFrame([("a", "old", [1.0, 0.0]), ("b", "old", [0.0, 1.0])], "item_id string, collection_name string, vector array<double>")
    store.write.parquet(seeded.folder + "/store")
    spark.createDataFrame([("q", [0.2, 1.0])], "query_id string, vector array<double>").write.parquet(seeded.folder + "/q")
    spark.createDataFrame([("q", "b")], "query_id string, doc_id string").write.parquet(seeded.folder + "/r")
    assert main(["--catalog", seeded.folder, "strategies"]) == 0 and capsys.readouterr().out.splitlines()[0].split() == ["name", "active", "stale"]
    assert main(["--catalog", seeded.folder, "cutover", "scifact_v2", "scifact_v1"]) == 0 and main(["--catalog", seeded.folder, "rollback"]) == 0 and '"active_collection": "scifact_v2"' in capsys.readouterr().out
    gate = ["--catalog", seeded.folder, "gate", *(f"{seeded.folder}/{x}" for x in ("store", "q", "r")), "old"]
    assert main([*gate, "old"]) == 0 and main([*gate, "none"]) == 1


def test_http(spark, seeded):
    import threading
    import urllib.error
    import urllib.request

    from strataloom.http_api import make_server

    embed = migration.hash_embedder(16)
    store = spark.createDataFrame([("a", "live", embed(["red apple"])[0].tolist())], "item_id string, collection_name string, vector array<double>")
    server = make_server(Service(seeded, store, embed, {"active_collection": "live", "active_model": "bge-small", "active_version": "1.0.0"}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())) as r:
                raw = r.read().decode()
                return r.status, json.loads(raw) if r.headers["Content-Type"] == "application/json" else raw
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    try:
        assert call("/health") == (200, {"status": "ok"}) and call("/nowhere")[0] == 404 and call("/v1/nowhere", {})[0] == 404
        assert call("/v1/search", {"query": "red apple", "top_k": 1})[1]["results"][0]["id"] == "a"
        assert call("/v1/search", {})[0] == 400 and call("/v1/search", {"query": "x", "top_k": 0})[0] == 400 and call("/v1/search", [1])[0] == 400
        assert call("/v1/catalog/lineage/vec_0001")[1]["doc_id"] == "doc-1" and call("/v1/catalog/lineage/none")[0] == 404
        assert call("/v1/catalog/staleness")[1]["total"] == 2
        assert call("/v1/admin/routing", {"traffic_split_ratio": 0.5, "active_model": None})[1]["active_model"] == "bge-small"
        assert "embedding_tokens_total" in call("/metrics")[1]
    finally:
        server.shutdown()
