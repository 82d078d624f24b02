"""Queries of problem 1: contents that differ only in layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.copies import CopyLedger, collapse, sign
from strataloom.sources.tables import table


def _ledger(spark: SparkSession, folder: str) -> CopyLedger:
    return collapse([
        sign(table(spark, folder, "chunks"), "chunks", "chunk_id", "chunk_text", "loaded_at"),
        sign(table(spark, folder, "documents"), "documents", "doc_id", "text", "loaded_at"),
    ])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each key of a set of copies with the smallest key of the set."""
    return _ledger(spark, folder).pairs().select(F.col("source").alias("source_table"), F.col("keep").alias("keep_key"), F.col("item").alias("copy_key"))


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each content with the number of its copies and the key that is kept."""
    return _ledger(spark, folder).entries().select(F.col("source").alias("source_table"), F.col("keep").alias("keep_key"), "copies")


QUERIES = {"p1_found": p1_found, "p1_entries": p1_entries}

_NAME = r"[\p{L}][\p{L}\p{N}]*(?:[^\p{L}\p{N}:=.,!?]{1,3}[\p{L}\p{N}]+){0,5}"
_FIELD = rf"(?s)^[^\p{{L}}\p{{N}}:=]*({_NAME})[^\p{{L}}\p{{N}}:=]*[:=](.*)$"


def _sql_words(x: str) -> str:
    return rf"array_to_string(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), ' ')"


def _sql_pair(name: str, value: str) -> str:
    return f"{_sql_words(name)} || '=' || {_sql_words(value)}"


_PARTS = r"list_filter(regexp_split_to_array(t, '[\n\r;|]'), lambda p: regexp_matches(p, '[\p{L}\p{N}]'))"
_LINES = f"""CASE WHEN len({_PARTS}) > 0 AND len(list_filter({_PARTS}, lambda p: NOT regexp_matches(p, '{_FIELD}'))) = 0
    THEN list_sort(list_distinct(list_transform({_PARTS}, lambda p: {_sql_pair(f"regexp_extract(p, '{_FIELD}', 1)", f"regexp_extract(p, '{_FIELD}', 2)")}))) END"""
_JSON = f"""CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' AND len(json_keys(t)) > 0 THEN list_sort(list_distinct(list_transform(json_keys(t), lambda k: {_sql_pair('k', "coalesce(json_extract_string(t, '$.\"' || k || '\"'), '')")}))) END"""

#: The same classes in SQL: words in order, folded by the set of fields where a text is nothing else.
_CLASSES = rf"""
        WITH x AS (SELECT DISTINCT 'chunks' AS s, chunk_id AS k, chunk_text AS t FROM chunks UNION SELECT 'documents', doc_id::VARCHAR, text FROM documents),
        w AS (SELECT s, k, {_sql_words('t')} AS w, CASE WHEN regexp_matches(t, '(?s)^\s*\{{\s*".*\}}\s*$') THEN coalesce({_JSON}, {_LINES}) WHEN regexp_matches(t, '(?s)^[^\p{{L}}\p{{N}}:=]*{_NAME}[^\p{{L}}\p{{N}}:=]*[:=]') THEN {_LINES} END AS f FROM x WHERE regexp_matches(t, '[\p{{L}}\p{{N}}]')),
        c AS (SELECT s, k, coalesce(min(array_to_string(f, chr(10))) OVER (PARTITION BY s, w), chr(1) || w) AS c FROM w)"""
ORACLES = {
    "p1_found": f"""{_CLASSES}, m AS (SELECT s, k, min(k) OVER (PARTITION BY s, c) AS first FROM c)
        SELECT DISTINCT s AS source_table, first AS keep_key, k AS copy_key FROM m WHERE k <> first""",
    "p1_entries": f"{_CLASSES} SELECT s AS source_table, min(k) AS keep_key, count(*) AS copies FROM c GROUP BY s, c",
}
