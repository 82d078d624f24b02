"""Null keys, rows of nulls only, repeated rows, very long texts and empty tables, through every operator on texts."""

import pytest
from pyspark.sql import functions as F

from strataloom.llm import byte_bpe, copies, neighbours, packing, pii, quality, splitting

LONG = "Some words here. " * 20_000
ROWS = [(None, None, None), (None, "alpha beta", None), ("k1", None, "en"), ("k2", "", None), ("k3", "alpha beta", "en"), ("k3", "alpha beta", "en"), ("k4", LONG, "de"), ("k5", "x" * 300_000, "en")]
COLUMNS = "k string, t string, lang string, loaded_at timestamp, n_tokens string, item string, source string, piece_no string, kind string, node string"


@pytest.fixture(scope="module")
def frames(spark):
    df = spark.createDataFrame([(*r, None, "a", "b", "c", "d", "e", "f") for r in ROWS], COLUMNS)
    return df, df.limit(0)


def outputs(spark, df):
    strategies = spark.createDataFrame([("s", "1", 50, 5), (None, None, None, None)], "strategy_name string, strategy_version string, chunk_size_tokens int, chunk_overlap_tokens int")
    words = spark.createDataFrame([("en", "the"), (None, None), ("de", None)], "lang string, word string")
    parts = spark.read.parquet("/root/testdata/sf0.001/name_parts.parquet").unionByName(spark.createDataFrame([(None, None)], "part_kind string, name_text string"))
    yield "ids", byte_bpe.encode_column(df, "k", "t")
    yield "packs", packing.pack_texts(df, "k", "t")
    yield "pieces", splitting.split_texts(df, strategies, ["k"], "t", range_chars=100_000)
    yield "types", pii.find_types(df, parts, "k", "t")
    yield "masked", pii.mask_texts(df, parts, "k", "t")
    yield "scores", quality.scored_texts(df, words, "k", "t", "lang")
    yield "pairs", copies.collapse([copies.sign(df, "s", "k", "t", "loaded_at")]).pairs()


def test_every_operator(spark, frames):
    got = {name: df.collect() for name, df in outputs(spark, frames[0])}
    assert len(got["ids"]) == len(got["masked"]) == len(got["scores"]) == len(ROWS)
    assert sorted(len(r.ids) for r in got["ids"] if r.k in (None, "k1", "k2"))[:3] == [0, 0, 0]
    assert {r.k for r in got["packs"]} == {None, "k1", "k2", "k3", "k4", "k5"} and got["pairs"] == [] and got["types"] == []
    tokens = {}
    for r in got["pieces"]:
        tokens[r.k] = max(tokens.get(r.k, 0), r.first_token + r.n_tokens)
        assert r.n_tokens <= 50
    assert tokens == {None: 2, "k3": 2, "k4": 60_000, "k5": 1}
    assert sum(r.n_words is None for r in got["scores"]) == 3


def test_empty_tables(spark, frames):
    for name, df in outputs(spark, frames[1]):
        assert df.count() == 0, name


def test_vectors_of_nulls_only(spark):
    df = spark.createDataFrame([(None, None, None, None)] * 3, "vector_id string, collection_name string, dimension int, embedding array<float>")
    usable = neighbours.usable_vectors(df)
    nodes = neighbours.nodes_of(usable)
    graph = neighbours.neighbour_graph(nodes)
    assert neighbours.ranked(usable, nodes, graph).count() == 0
    asked = usable.select(F.col("vector_id").alias("query"), "grp", "small", "vec")
    assert neighbours.greedy_search(graph, nodes, usable, asked).count() == 0
