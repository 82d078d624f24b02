"""Scans of JSON, JSONL, TSV and YAML files, and the sinks that go with them."""

from __future__ import annotations

import json
import os
import zipfile

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.numbering import numbered

CORPUS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
DOCUMENT = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("doc_id", "title", "text")),
    T.StructField("metadata", T.StructType([T.StructField(c, T.StringType()) for c in ("source_uri", "author", "classification_level", "language")])),
])
_BAD = "_corrupt"


def unknown_keys(value: Column, schema: T.StructType) -> Column:
    """The keys of a JSON object that a closed schema lacks, those of nested objects as parent.key; empty for what is no object."""
    own = F.array_except(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), F.array(*map(F.lit, schema.names)))
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            inner = F.coalesce(F.json_object_keys(F.get_json_object(value, f"$.{f.name}")), F.array().cast("array<string>"))
            prefix = F.lit(f"{f.name}.")
            own = F.concat(own, F.transform(F.array_except(inner, F.array(*map(F.lit, f.dataType.names))), lambda n: F.concat(prefix, n)))  # noqa: B023
    return own


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """(file, line_no, record columns, _corrupt): objects of one line each; blank lines are skipped but counted.

    Lines are numbered per file by the order of its splits and their offsets. _corrupt holds a line that is no JSON object of
    the schema; strict makes that an error instead. extra has the names of an object's keys that the schema lacks."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = numbered(lines, ["block", "at"], ["file"], "line_no")
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select("file", "line_no", F.from_json("value", full, {"columnNameOfCorruptRecord": _BAD, "mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"), unknown_keys(F.col("value"), schema).alias("extra"))
    return parsed.select("file", "line_no", "r.*", "extra")


def read_records(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """Records with record_number from 1 and extra, the keys that the schema lacks: a .json file of one object or a list, or
    a .jsonl file."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema).withColumnRenamed("line_no", "record_number").drop("file")
    if not path.endswith(".json"):
        raise ValueError("records come as .json or .jsonl")
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    items = whole.select(F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "value"))  # each object as its JSON text
    return items.select((F.col("pos") + 1).alias("record_number"), F.from_json("value", schema).alias("r"), unknown_keys(F.col("value"), schema).alias("extra")).select("record_number", "r.*", "extra")


def canonical_corpus(df: DataFrame) -> DataFrame:
    """Corpus rows (_id, title, text) in the governed envelope."""
    meta = F.struct(F.concat(F.lit("beir://scifact/"), "_id").alias("source_uri"), F.lit("BEIR/SciFact").alias("author"), F.lit("public").alias("classification_level"), F.lit("en").alias("language"))
    return df.select(F.col("_id").alias("doc_id"), "title", "text", F.when(F.col("_id").isNotNull(), meta).alias("metadata"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score, place) of a tab-separated file; its header must name the three columns, scores of 0 are
    dropped; place orders the rows as the file has them."""
    df = spark.read.csv(path, sep="\t", header=True)
    if set(df.columns) != {"query-id", "corpus-id", "score"}:
        raise ValueError(f"unexpected qrels columns {df.columns}")
    return df.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").cast("int").alias("score"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place")).filter("score > 0")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text); bad lines, missing or blank fields and repeated ids are errors."""
    df = read_jsonl(spark, path, T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())]))
    blank = F.coalesce(F.trim("_id") == "", F.lit(True)) | F.coalesce(F.trim("text") == "", F.lit(True))
    if bad := df.filter(F.col(_BAD).isNotNull() | blank).select("line_no").limit(5).collect():
        raise ValueError(f"unusable queries in lines {[r.line_no for r in bad]}")
    if twice := df.groupBy("_id").count().filter("count > 1").limit(5).collect():
        raise ValueError(f"repeated query ids {[r._id for r in twice]}")
    return df.select(F.col("_id").alias("query_id"), "text")


def evaluation_catalog(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text, relevant_doc_ids), numeric ids first by value; an id of qrels without a query is an error. Relevant
    ids stand in the order of the qrels' place with their repeats, or sorted if there is no place."""
    from strataloom.functions.scalars import numeric_first

    if lost := qrels.join(queries, "query_id", "left_anti").select("query_id").distinct().orderBy("query_id").limit(5).collect():
        raise ValueError(f"qrels name unknown queries {[r.query_id for r in lost]}")
    if "place" in qrels.columns:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda r: r["doc_id"])
    else:
        listed = F.array_sort(F.collect_list("doc_id"))
    grouped = qrels.groupBy("query_id").agg(listed.alias("relevant_doc_ids"))
    return queries.join(grouped, "query_id").select("query_id", "text", "relevant_doc_ids").orderBy(*numeric_first(F.col("query_id")))


def read_evaluation_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects with query_id, text and relevant_doc_ids; an item without one of them is an error."""
    item = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("relevant_doc_ids", T.ArrayType(T.StringType()))])
    raw = spark.read.text(path, wholetext=True)
    if raw.filter(F.ltrim("value").startswith("[")).isEmpty():
        raise ValueError("an evaluation catalog is a JSON list")
    df = raw.select(F.explode(F.from_json("value", T.ArrayType(item))).alias("c")).select("c.*")
    if not df.filter("query_id is null or text is null or relevant_doc_ids is null").isEmpty():
        raise ValueError("an evaluation item lacks query_id, text or relevant_doc_ids")
    return df


def read_vector_map(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, vector) of a JSON object of arrays; a byte order mark is ignored."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    return raw.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("item_id", "vector"))


def read_config(path: str, required: tuple[str, ...]) -> dict:
    """A YAML mapping; missing keys are an error."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    if lacking := [k for k in required if k not in raw]:
        raise ValueError(f"{path} lacks {lacking}")
    return raw


def update_config(path: str, changes: dict) -> dict:
    """Merges the changes that are not null and replaces the file in one step."""
    with open(path, encoding="utf-8") as f:
        merged = (yaml.safe_load(f) or {}) | {k: v for k, v in changes.items() if v is not None}
    with open(path + ".new", "w", encoding="utf-8") as f:
        yaml.safe_dump(merged, f, sort_keys=False)
    os.replace(path + ".new", path)
    return merged


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A Parquet folder; nothing to write is an error."""
    if df.isEmpty():
        raise ValueError("there are no rows to write")
    df.write.mode(mode).parquet(path)


def write_quarantine(invalid: DataFrame, path: str) -> bool:
    """Writes rejected records as JSON, only if there are any; whether it did."""
    if invalid.isEmpty():
        return False
    invalid.write.mode("overwrite").json(path)
    return True


def write_json_list(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """A small table as one JSON list, replaced in one step; refused beyond `most` rows."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one JSON file")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    os.replace(path + ".new", path)
    return len(rows)


def unpack_member(archive: str, suffix: str, target: str) -> None:
    """Checks an archive and writes its one member of that suffix to target in one step."""
    with zipfile.ZipFile(archive) as z:
        if z.testzip() is not None:
            raise ValueError("damaged archive")
        names = [n for n in z.namelist() if n.endswith(suffix)]
        if len(names) != 1:
            raise ValueError(f"{len(names)} members end with {suffix}")
        with z.open(names[0]) as source, open(target + ".new", "wb") as out:
            while block := source.read(1 << 20):
                out.write(block)
    os.replace(target + ".new", target)
