import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataloom.llm.copies import CopyLedger, collapse, new_ledger, sign


def norm(t):
    return " ".join(re.findall(r"[^\W_]+", t.casefold()))


SAME = [
    ("a01", "The limit, was 3.4 for KR-3."), ("a02", "the  LIMIT\nwas 3 4 for kr_3"), ("a03", "The limit was 34 for KR3"),
    ("b01", "model: x-1\ndim: 5"), ("b02", "DIM=5; Model = x 1"), ("b03", json.dumps({"Dim": 5, "model": "X 1"})), ("b04", "model x 1 dim 5"),
    ("b05", "- dim: 5\n- model: x-1"), ("b06", "model: x-1\ndim: 5\nand more words"), ("b07", "dim: 5\ndim: 5\nmodel: x_1"),
    ("c01", "Straße"), ("c02", "STRASSE"), ("d01", None), ("d02", " --- "), ("d03", ""), ("e01", "only one"),
    ("f01", "first. second."), ("f02", "second. first."), ("a02", "the  LIMIT\nwas 3 4 for kr_3"),
]
WANT = {("a01", "a02"), *(("b01", k) for k in ("b02", "b03", "b04", "b05", "b07")), ("c01", "c02")}


def frame(spark, rows, extra="source string"):
    return spark.createDataFrame([(k, t, "x", None) for k, t in rows], f"k string, t string, {extra}, item string")


def test_copies_of_every_form(spark):
    ledger = collapse([sign(frame(spark, SAME), "docs", "k", "t")], batches=1)
    assert {(r.keep, r.item) for r in ledger.pairs().collect()} == WANT
    assert {r.keep: r.copies for r in ledger.entries().collect()} == {"a01": 2, "a03": 1, "b01": 6, "b06": 1, "c01": 2, "e01": 1, "f01": 1, "f02": 1}


def test_batches_in_any_order_give_the_same(spark):
    ledger = new_ledger(spark, 3)
    for part in (SAME[10:], SAME[:5], [], SAME[3:12], SAME):
        ledger.absorb(sign(frame(spark, part), "docs", "k", "t"))
    assert {(r.keep, r.item) for r in ledger.pairs().collect()} == WANT
    assert sum(r.copies for r in ledger.entries().collect()) == len({k for k, t in SAME if t and norm(t)})


def test_words_read_as_different_fields(spark):
    rows = [("1", "a: b c"), ("2", "a b: c"), ("3", "x: y\na: b c"), ("4", "a: b c\nx: y"), ("5", "a b: c\nx: y")]
    ledger = collapse([sign(frame(spark, rows), "docs", "k", "t")], batches=1)
    assert {(r.keep, r.item) for r in ledger.pairs().collect()} == {("1", "2"), ("3", "4"), ("3", "5")}


def test_ledger_goes_on_in_another_session(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    CopyLedger.open(spark, folder, 3).absorb(sign(frame(spark, SAME[:9]), "docs", "k", "t"))
    later = spark.newSession()
    CopyLedger.open(later, folder).absorb(sign(frame(later, SAME[9:]), "docs", "k", "t"))
    stale = CopyLedger.open(later, folder)
    CopyLedger.open(later, folder).absorb(sign(frame(later, SAME), "docs", "k", "t"))
    with pytest.raises(RuntimeError):  # it was opened before the last batch
        stale.absorb(sign(frame(later, SAME), "docs", "k", "t"))
    last = CopyLedger.open(spark, folder)
    assert last.buckets == 3 and last.step == 3 and {(r.keep, r.item) for r in last.pairs().collect()} == WANT
    assert [p.name for p in (tmp_path / "ledger").glob("manifest-*")] == ["manifest-3.json"]
    held = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for ps in last.paths["counts"].values() for p in ps}
    assert {p.parent.name for p in (tmp_path / "ledger").glob("counts-*/b=*") if any(p.glob("*.parquet"))} >= held


def test_many_field_orders_of_one_content(spark):
    """A class of 100,000 word keys meets its one row by a broadcast, not in one task."""
    n = 100_000
    names = [f"f{i}" for i in range(8)]
    order = F.concat(*(F.concat(F.element_at(F.array(*map(F.lit, names)), ((F.col("id") / 8**i).cast("int") % 8 + 1).cast("int")), F.lit(": v\n")) for i in range(6)), F.concat_ws("\n", *(F.lit(f"{x}: v") for x in names)))
    df = spark.range(n).select(F.format_string("%06d", "id").alias("k"), order.alias("t"))
    ledger = collapse([sign(df, "docs", "k", "t")], batches=1)
    assert ledger.entries().collect()[0].copies == n and ledger._link_classes().select("class_key").distinct().count() == 1
    pairs = ledger.pairs()
    assert pairs.agg(F.count("*"), F.min("keep"), F.max("keep")).first() == (n - 1, "000000", "000000")
    assert max(r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()) < 0.6 * n


def test_hot_group_and_empty(spark):
    rows = [(f"{i:05d}", "Same, text" if i % 2 else "same text") for i in range(3000)] + [(f"z{i}", f"own {i}") for i in range(50)] + [("y1", "OWN 1")]
    ledger = collapse([sign(frame(spark, rows), "docs", "k", "t")], batches=1)
    got = {(r.keep, r.item) for r in ledger.pairs().collect()}
    assert got == {("00000", f"{i:05d}") for i in range(1, 3000)} | {("y1", "z1")}
    assert collapse([sign(frame(spark, []), "docs", "k", "t")]).pairs().count() == 0


def test_against_brute_force_on_a_table(spark):
    from strataloom.llm.copies_queries import p1_found
    import pandas as pd

    folder = "/root/testdata/sf0.001"
    d = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).dropna()
    groups = defaultdict(set)
    for k, t in zip(d.doc_id.astype(str), d.text):
        if norm(t):
            groups[norm(t)].add(k)
    want = {(min(v), k) for v in groups.values() for k in v if k != min(v)}
    got = {(r.keep_key, r.copy_key) for r in p1_found(spark, folder).collect() if r.source_table == "documents"}
    assert want <= got
