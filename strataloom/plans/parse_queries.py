"""Queries of problem 4: rows that fail to parse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import ensure_checkpoint_dir, forget_at_exit
from strataloom.sources.delimited import ALLOWED, COLUMNS, LENGTHS, Contract, parse_rows, read_records_of_files, split_valid
from strataloom.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_id and reason of every row that is not a valid record."""
    parsed = parse_rows(table(spark, folder, "raw_records"), table(spark, folder, "raw_feeds"), with_values=False)
    return parsed.filter("reason is not null").select("record_id", "reason")


def p4_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records with all their columns."""
    return split_valid(parse_rows(table(spark, folder, "raw_records"), table(spark, folder, "raw_feeds")))[0]


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records, written as quoted files and read again by byte ranges: record ends found by quote parity."""
    path = forget_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}")
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in COLUMNS]
    valid = p4_valid(spark, folder)
    valid.select(F.concat_ws(",", F.col("record_id").cast("string"), *quoted).alias("value")).write.text(path)
    feed = spark.createDataFrame([("file", ",", '"')], "feed string, delimiter string, quote_char string")
    rows = read_records_of_files(spark, f"{path}/part-*").withColumn("feed", F.lit("file"))
    contract = Contract(("record_id", *COLUMNS))
    parsed = parse_rows(rows, feed, key="offset", contract=contract).filter("reason is null")
    return parsed.select(F.col("record_id").cast("bigint").alias("record_id"), *COLUMNS)


#: A field, the row and its seven values as expressions built from each feed's dialect; a private character stands for no quote.
_FIELD = """'(?:' || q || '(?:[^' || q || ']|' || q || q || ')*' || q || '|[^' || q || d || ']*)'"""
_ROW = "'(?s)^(' || " + " || ')[' || d || '](' || ".join(["f"] * 7) + " || ')$'"
_VALUES = ", ".join(f"regexp_extract(t, {_ROW}, {i + 1}) AS r{i}" for i in range(7))
_PLAIN = ", ".join(f"CASE WHEN starts_with(r{i}, q) THEN replace(substr(r{i}, 2, length(r{i}) - 2), q || q, q) ELSE r{i} END AS v{i}" for i in range(7))
_BOUNDS = " OR ".join([f"length(v{i}) < {a}" + (f" OR length(v{i}) > {b}" if b else "") for i, (a, b) in enumerate(LENGTHS[c] for c in COLUMNS[:5])] + [f"NOT (v{5 + i} IN ({', '.join(repr(v) for v in ALLOWED[c])}))" for i, c in enumerate(COLUMNS[5:])])
_PARSED = f"""
    WITH a AS (SELECT record_id, raw_line AS t, coalesce(delimiter, ',') AS d, CASE WHEN delimiter IS NULL THEN '"' ELSE coalesce(quote_char, chr(57344)) END AS q FROM raw_records LEFT JOIN raw_feeds USING (feed)),
    b AS (SELECT *, {_FIELD} AS f FROM a),
    c AS (SELECT *, regexp_full_match(t, '(?s)' || f || '(?:[' || d || ']' || f || ')*') AS sound, regexp_replace(t, q || '(?:[^' || q || ']|' || q || q || ')*' || q, '', 'g') AS bare FROM b),
    e AS (SELECT *, length(bare) - length(replace(bare, d, '')) + 1 AS n, {_VALUES} FROM c),
    g AS (SELECT *, {_PLAIN} FROM e)
    SELECT record_id, CASE WHEN t IS NULL THEN 'column_count' WHEN NOT sound THEN 'quoting' WHEN n <> 7 THEN 'column_count' WHEN {_BOUNDS} THEN 'invalid_value' END AS reason, {', '.join(f'v{i} AS {c}' for i, c in enumerate(COLUMNS))} FROM g"""

QUERIES = {"p4_found": p4_found, "p4_valid": p4_valid, "p4_files": p4_files}
ORACLES = {
    "p4_found": f"SELECT record_id, reason FROM ({_PARSED}) WHERE reason IS NOT NULL",
    "p4_valid": f"SELECT record_id, {', '.join(COLUMNS)} FROM ({_PARSED}) WHERE reason IS NULL",
}
ORACLES["p4_files"] = ORACLES["p4_valid"]
