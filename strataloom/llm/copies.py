"""One entry for each content, whatever its spacing, letter case, punctuation or field order: an incremental ledger.

Every text gets a word key (digest of its words: maximal runs of letters and digits, case folded, in order). A text
that is nothing but named fields also gets a field key (digest of its sorted set of name-value pairs). The ledger keeps,
per bucket of word keys, one row for each word key: how many distinct item keys carry it and the earliest, that is
smallest, of them. A new batch is made distinct, freed of keys that arrived before (anti-join with the members of the
buckets it touches), aggregated, and full-outer-joined with those buckets only: counts add up, the smaller
representative stays. Buckets that a batch does not touch are neither read nor written. Links from word keys to field
keys are kept apart and fold word keys of equal fields into one class when the ledger is read.

The ledger outlives the session: each batch ends with a manifest that is renamed into place, `CopyLedger.open(folder)`
reads the last one, two writers cannot both commit a step, and files that a step replaced are deleted after its commit.

Skew: counts are pre-aggregated before each shuffle. Where many rows meet one row of their key, the keys that more than
1/(4 * partitions) of those rows have (members of a word key, word keys of a class, links of a field key) are broadcast;
there are fewer than 4 * partitions of them whatever the data, as they are counted in the rows that are joined.

Defined cases: null texts and texts without a word are no items; a null item key is none either; an item key delivered
again counts once; an empty batch leaves the ledger as it is; columns beyond the named ones are not read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, ensure_checkpoint_dir, forget_at_exit, partitions_for

BUCKET_ROWS = 20_000  # rows of a bucket of a small ledger; a large one has as many buckets as shuffles have partitions

_NAME = r"\p{L}[\p{L}\p{N}]*(?:[^\p{L}\p{N}:=.,!?]{1,3}[\p{L}\p{N}]+){0,5}"
FIELD = rf"(?s)^[^\p{{L}}\p{{N}}:=]*+({_NAME})[^\p{{L}}\p{{N}}:=]*+[:=](.*)$"
MAYBE_FIELDS = rf"(?s)^[^\p{{L}}\p{{N}}:=]*+{_NAME}[^\p{{L}}\p{{N}}:=]*+[:=]"
MAYBE_JSON = r'(?s)^\s*\{\s*".*\}\s*$'


def words(text: Column) -> Column:
    """The words of a text in order, one blank apart, case folded: upper first, so that letters which fold to two do.

    The replacement stands between the two, as the optimizer drops an upper right under a lower."""
    return F.trim(F.lower(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", " ")))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _pair(name: Column, value: Column) -> Column:
    return F.concat(words(name), F.lit("="), words(F.coalesce(value, F.lit(""))))


def _set_digest(pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, _digest(F.concat_ws("\n", F.array_sort(F.array_distinct(pairs)))))


def field_key(text: Column) -> Column:
    """Digest of the set of name-value pairs, or null if the text holds anything but named fields."""
    parts = F.filter(F.split(text, r"[\n\r;|]"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    lines = F.when(
        F.forall(parts, lambda p: p.rlike(FIELD)),
        _set_digest(F.transform(parts, lambda p: _pair(F.regexp_extract(p, FIELD, 1), F.regexp_extract(p, FIELD, 2)))),
    )
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    json = _set_digest(F.transform(entries, lambda e: _pair(e["key"], e["value"])))
    return F.when(text.rlike(MAYBE_JSON), F.coalesce(json, lines)).when(text.rlike(MAYBE_FIELDS), lines)


def sign(df: DataFrame, source: str, key: str, text: str, arrived: str | None = None) -> DataFrame:
    """(source, item, arrived, word_key, field_key) of every item that has a word."""
    body = F.col(text).cast("string")
    return (
        df.select(F.col(key).cast("string").alias("item"), body.alias("body"), (F.col(arrived) if arrived else F.lit(None)).cast("timestamp").alias("arrived"))
        .filter(F.col("item").isNotNull() & F.col("body").rlike(r"[\p{L}\p{N}]"))
        .select(F.lit(source).alias("source"), "item", "arrived", _digest(words(F.col("body"))).alias("word_key"), field_key(F.col("body")).alias("field_key"))
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source", "word_key"), F.lit(buckets)).cast("int")


def join_one(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of many rows with the one row of their keys, without a hot key; counts has `n`, the rows of each key."""
    counts = cut_lineage(many.groupBy(*keys).agg(F.count("*").alias("n"))) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counts.filter(F.col("n") > max(1000, total // (4 * parts))).select(*keys)
    if hot.isEmpty():
        return many.join(one, keys)
    hot = F.broadcast(hot)
    return many.join(F.broadcast(one.join(hot, keys, "left_semi")), keys).unionByName(many.join(hot, keys, "left_anti").join(one, keys))


@dataclass
class CopyLedger:
    """Counts and representatives by word key in `buckets` buckets under a folder that all executors share."""

    spark: SparkSession
    folder: str
    buckets: int = 16
    #: for each kind of file and each bucket, the paths that hold it now
    paths: dict[str, dict[int, list[str]]] = field(default_factory=lambda: {"counts": {}, "members": {}, "links": {}})
    step: int = 0

    _SCHEMAS = {
        "counts": "source string, word_key binary, copies bigint, keep string, bucket int",
        "members": "source string, word_key binary, item string, bucket int",
        "links": "source string, word_key binary, field_key binary, bucket int",
    }

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int = 16) -> CopyLedger:
        """The ledger in a folder as its last committed batch left it; an empty one of `buckets` buckets if there is none."""
        ledger = cls(spark, folder, buckets)
        fs, path = ledger._fs(folder)
        steps = [int(n[9:-5]) for n in ([x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []) if n.startswith("manifest-")]
        if steps:
            held = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifest-{max(steps)}.json", wholetext=True).collect()))
            ledger.step, ledger.buckets = held["step"], held["buckets"]
            ledger.paths = {kind: {int(b): [f"{folder}/{p}" for p in ps] for b, ps in own.items()} for kind, own in held["paths"].items()}
        return ledger

    def _fs(self, path: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commit(self, replaced: list[str]) -> None:
        """Makes this step the ledger's state, then deletes what it replaced."""
        own = {k: {b: [p[len(self.folder) + 1 :] for p in ps] for b, ps in v.items()} for k, v in self.paths.items()}
        fs, draft = self._fs(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"step": self.step, "buckets": self.buckets, "paths": own}).encode()))
        out.close()
        _, final = self._fs(f"{self.folder}/manifest-{self.step}.json")
        _, last = self._fs(f"{self.folder}/manifest-{self.step - 1}.json")
        if fs.exists(final) or self.step > 1 and not fs.exists(last) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed step {self.step} of {self.folder}")
        for old in (last, *(self._fs(x)[1] for x in replaced)):
            fs.delete(old, True)

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        chosen = sorted({p for b, ps in self.paths[kind].items() if buckets is None or b in buckets for p in ps})
        if not chosen:
            return self.spark.createDataFrame([], self._SCHEMAS[kind])
        return self.spark.read.schema(self._SCHEMAS[kind]).parquet(*chosen)

    def _write(self, kind: str, df: DataFrame, buckets: list[int], replace: bool) -> list[str]:
        """Writes a step's rows of a kind; the paths that they replace."""
        out = f"{self.folder}/{kind}-{self.step}-{uuid.uuid4().hex[:8]}"
        few = max(1, min(len(buckets), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        df.repartition(few, "bucket").withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(out)
        fs, root = self._fs(out)
        replaced = []
        for status in fs.listStatus(root):  # at most one folder a bucket
            name = status.getPath().getName()
            if name.startswith("b="):
                held = self.paths[kind].setdefault(int(name[2:]), [])
                if replace:
                    replaced += held
                    held.clear()
                held.append(f"{out}/{name}")
        return replaced

    def absorb(self, signed: DataFrame) -> None:
        """Adds one batch of sign()'s rows, which should be a table or a checkpoint."""
        batch = signed.withColumn("bucket", _bucket(self.buckets))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        self.step += 1
        members = batch.select("source", "word_key", "item", "bucket").distinct()
        if any(b in self.paths["members"] for b in touched):
            members = members.join(self._read("members", touched).drop("bucket"), ["source", "word_key", "item"], "left_anti")
        held = self._read("counts", touched) if any(b in self.paths["counts"] for b in touched) else None
        before = {b: len(self.paths["members"].get(b, [])) for b in touched}
        self._write("members", members, touched, replace=False)
        new = [p for b in touched for p in self.paths["members"].get(b, [])[before[b] :]]
        replaced = []
        if new:
            rows = self.spark.read.schema(self._SCHEMAS["members"]).parquet(*new)
            counts = rows.groupBy("source", "word_key", "bucket").agg(F.count("*").alias("copies"), F.min("item").alias("keep"))
            if held is not None:
                added = counts.withColumnsRenamed({"copies": "n", "keep": "first"})
                counts = added.join(held, ["source", "word_key", "bucket"], "full_outer").select(
                    "source", "word_key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("keep", "first").alias("keep"), "bucket")
            replaced = self._write("counts", counts.select("source", "word_key", "copies", "keep", "bucket"), touched, replace=True)
        links = batch.filter(F.col("field_key").isNotNull()).select("source", "word_key", "field_key", "bucket").distinct()
        self._write("links", links, touched, replace=False)
        self._commit(replaced)

    def _link_classes(self) -> DataFrame:
        """(source, word_key, class_key): the smallest field key that a word key reaches through shared keys."""
        links = cut_lineage(self._read("links").select("source", "word_key", "field_key").distinct())
        label = cut_lineage(links.groupBy("source", "word_key").agg(F.min("field_key").alias("class_key"), F.count("*").alias("n")))
        if label.filter("n > 1").isEmpty():  # every word key has one field key, as good as always
            return label.drop("n")
        label = label.drop("n")
        counts = cut_lineage(links.groupBy("source", "field_key").agg(F.count("*").alias("n")))
        while True:  # equal words read as different fields: pass the smallest key on until nothing changes
            by_field = links.join(label, ["source", "word_key"]).groupBy("source", "field_key").agg(F.min("class_key").alias("class_key"))
            after = cut_lineage(join_one(links, by_field, ["source", "field_key"], counts).groupBy("source", "word_key").agg(F.min("class_key").alias("class_key")))
            if after.join(label, ["source", "word_key", "class_key"], "left_anti").isEmpty():
                return after
            label = after

    def _entries(self, classes: DataFrame) -> DataFrame:
        rows = self._read("counts").join(classes, ["source", "word_key"], "left")
        return rows.groupBy("source", F.coalesce("class_key", "word_key").alias("class_key")).agg(F.sum("copies").alias("copies"), F.min("keep").alias("keep"))

    def entries(self) -> DataFrame:
        """(source, class_key, copies, keep): one row for each content."""
        return self._entries(self._link_classes())

    def pairs(self) -> DataFrame:
        """(source, keep, item): every item of a content with several, but the one that is kept."""
        classes = self._link_classes()
        repeated = cut_lineage(self._entries(classes).filter("copies > 1").select("source", "class_key", "keep"))
        # back to word keys, which the members carry
        folded = join_one(classes, repeated, ["source", "class_key"]).select("source", "word_key", "keep")
        plain = repeated.join(classes.select("source", "class_key").distinct(), ["source", "class_key"], "left_anti").select("source", F.col("class_key").alias("word_key"), "keep")
        counts = self._read("counts").select("source", "word_key", F.col("copies").alias("n"))
        met = join_one(self._read("members").select("source", "word_key", "item"), cut_lineage(plain.unionByName(folded)), ["source", "word_key"], counts)
        return met.filter(F.col("item") != F.col("keep")).select("source", "keep", "item")


def new_ledger(spark: SparkSession, buckets: int | None = None) -> CopyLedger:
    """An empty ledger in the shared folder that goes with the session; CopyLedger.open makes one that stays."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return CopyLedger(spark, forget_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"), buckets or max(8, most))


def collapse(tables: list[DataFrame], batches: int = 2, buckets: int | None = None) -> CopyLedger:
    """Signs once, then absorbs the items in batches by arrival time (rows without one come first)."""
    signed = cut_lineage(reduce(DataFrame.unionByName, tables))
    spark = signed.sparkSession
    ledger = new_ledger(spark, buckets or partitions_for(spark, signed.count(), BUCKET_ROWS))
    shares = [i / batches for i in range(1, batches)]
    at = signed.agg(F.percentile_approx(F.unix_micros("arrived"), shares, 1000).alias("at")).first()["at"] if shares else None
    cuts = sorted(set(at or []))
    number = reduce(lambda a, c: a + F.when(F.unix_micros("arrived") > c, 1).otherwise(0), cuts, F.lit(0))
    for i in range(len(cuts) + 1):
        ledger.absorb(signed.filter(number == i))
    return ledger
