"""Every query of the subpackage runs on the smallest tables; those with a SQL twin give its rows."""

import duckdb
import pyarrow.parquet as pq
import pytest

from strataloom.llm import registry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["source_table", "keep_key", "copy_key"], "p2_found": ["doc_id", "doc_version", "strategy_name", "strategy_version"], "p3_found": ["vector_id_a", "vector_id_b"],
    "p5_found": ["source_table", "record_key", "pii_type"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in registry.ORACLES:
        c = duckdb.connect()
        for t in ("document_records", "chunk_strategies", "chunks", "documents", "vectors"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        rel = c.sql(registry.ORACLES[name])
        assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in rows))) == sorted(map(str, rel.fetchall()))


def test_pairs_of_vectors_equal_brute_force(spark):
    import numpy as np

    t = pq.read_table(f"{FOLDER}/vectors.parquet").to_pandas().drop_duplicates("vector_id")
    want = set()
    for (_, dim), g in t.groupby(["collection_name", "dimension"]):
        ok = [e is not None and len(e) == dim and np.isfinite(e).all() and np.any(e) for e in g.embedding]
        x, ids = np.stack(g.embedding[ok].to_numpy()).astype(float), g.vector_id[ok].to_numpy()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(x)):
            for j in np.argsort(-s[i])[:10]:
                if s[i, j] >= 0.9:
                    want.add(tuple(sorted((ids[i], ids[j]))))
    assert {tuple(r) for r in registry.QUERIES["p3_found"](spark, FOLDER).collect()} == want


def test_piece_texts_cover_the_records(spark):
    rows = registry.QUERIES["p2_piece_texts"](spark, FOLDER).collect()
    sizes = {(r.strategy_name, r.strategy_version): r.chunk_size_tokens for r in spark.read.parquet(f"{FOLDER}/chunk_strategies.parquet").collect()}
    for r in rows:
        assert r.n_tokens <= sizes[r.strategy_name, r.strategy_version] and r.piece_text and not r.piece_text[0].isspace()
