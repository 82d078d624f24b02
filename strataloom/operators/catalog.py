"""The relational catalog on Parquet: validated inserts, snapshots with an atomic pointer, constraint queries.

A table is a list of Parquet folders in a state file on the shared store. An insert adds a folder and reads of the rest
only the keys; a change of rows writes a new snapshot. Writers stage every changed table first and then replace the state
in one rename that fails if another writer was faster, so several tables change together or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.schemas import TABLES, Table
from strataloom.sources.pointer import Pointer


def latest(df: DataFrame, keys: list[str], arrival: str = "loaded_at") -> DataFrame:
    """One row for each key: the first delivery (null arrivals last; full ties are equal rows)."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(arrival).isNull().alias("__n"), F.col(arrival).alias("__a"))
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return kept.select(*keys, "__r.*")


def with_defaults(df: DataFrame, table: Table) -> DataFrame:
    """The table's columns in order and type; absent columns take their default or null, unknown ones are an error."""
    if unknown := [c for c in df.columns if c not in table.columns]:
        raise ValueError(f"{table.name} has no columns {unknown}")
    return df.select(*((F.col(c) if c in df.columns else F.expr(table.defaults.get(c, "null"))).cast(t).alias(c) for c, t in table.columns.items()))


def key_violations(df: DataFrame, table: Table) -> DataFrame:
    """(rule, n): null keys, repeated keys, repeated unique sets."""
    found = []
    for rule, columns in [("primary_key", table.key), *((f"unique_{'_'.join(u)}", u) for u in table.unique)]:
        some = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
        if rule == "primary_key":
            found.append(df.agg(F.count_if(some).alias("n")).select(F.lit("key_null").alias("rule"), "n"))
        found.append(df.filter(~some).groupBy(*columns).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found)


def key_conflicts(current: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    """(rule, n): key_violations() within new rows, and keys or unique sets of theirs that the table holds already."""
    found = [key_violations(new, table)]
    for rule, columns in [("primary_key", table.key), *((f"unique_{'_'.join(u)}", u) for u in table.unique)]:
        held = new.join(current.select(*columns), list(columns), "left_semi").agg(F.count("*").alias("n"))
        found.append(held.select(F.lit(rule).alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found)


def check_violations(df: DataFrame, table: Table) -> DataFrame:
    """(rule, n): rows that break each check, and nulls in each required column, in one pass."""
    rules = {f"not_null_{c}": F.col(c).isNull() for c in table.required if c in df.columns} | {r: ~F.expr(e) for r, e in table.checks.items()}
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, n bigint")
    row = df.agg(*(F.count_if(c).alias(r) for r, c in rules.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("v")).select("v.*")


def reference_violations(tables: dict[str, DataFrame], names: Iterable[str] = TABLES) -> DataFrame:
    """(table_name, reference, n): rows whose reference points nowhere; null references point to nothing and are fine."""
    found = []
    for name in names:
        for own, other, theirs in TABLES[name].references:
            if name not in tables or other not in tables:
                continue
            left = tables[name].select(*own).dropna()
            right = tables[other].select(*(F.col(t).alias(o) for t, o in zip(theirs, own)))
            missing = left.join(right, list(own), "left_anti").agg(F.count("*").alias("n"))
            found.append(missing.select(F.lit(name).alias("table_name"), F.lit(other).alias("reference"), "n"))
    return reduce(DataFrame.unionByName, found)


def missing_rows(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted whose key present lacks."""
    return wanted.join(present.select(*keys), keys, "left_anti")


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of equal key; the other rows stay."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


class Catalog:
    """Tables, aliases and the routing policy under a folder. Inserts are validated; `transaction` makes several changes
    visible at once. A writer whose state another one replaced meanwhile gets a Conflict."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._pointer = Pointer(spark, folder)
        self._staged: dict | None = None

    def _state(self) -> dict:
        return self._staged if self._staged is not None else self._pointer.read()[1]

    def _change(self, part: str, name: str, value) -> None:
        if self._staged is not None:
            self._staged.setdefault(part, {})[name] = value
            return
        number, state = self._pointer.read()
        state.setdefault(part, {})[name] = value
        self._pointer.write(number, state)

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        with_defaults(df, TABLES[name]).write.parquet(path)
        return path

    @contextmanager
    def transaction(self):
        """Changes inside become visible together at the end, or not at all if an error leaves the block."""
        if self._staged is not None:
            raise RuntimeError("transactions do not nest")
        number, self._staged = self._pointer.read()
        try:
            yield self
            self._pointer.write(number, self._staged)
        finally:
            self._staged = None

    def alias(self, name: str) -> str | None:
        """The collection that an alias stands for."""
        return self._state().get("aliases", {}).get(name)

    def set_alias(self, name: str, collection: str) -> str | None:
        """Points an alias to a collection in one step; the collection it stood for before."""
        before = self.alias(name)
        self._change("aliases", name, collection)
        return before

    def policy(self) -> dict:
        return dict(self._state().get("policy", {}))

    def set_policy(self, **changes) -> dict:
        """Merges the changes that are not null into the routing policy."""
        with nullcontext() if self._staged is not None else self.transaction():
            for name, value in changes.items():
                if value is not None:
                    self._change("policy", name, value)
            return self.policy()

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a log beside the tables (lineage events, vectors of a store), which has no keys to check."""
        rows.write.mode("append").parquet(f"{self.folder}/logs/{name}")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/logs/{name}")

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"unknown table {name}")
        paths = self._state().get("tables", {}).get(name)
        schema = TABLES[name].ddl
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a snapshot and points the table to it."""
        if name not in TABLES:
            raise KeyError(f"unknown table {name}")
        self._change("tables", name, [self._write(name, df)])

    def insert(self, name: str, rows: DataFrame) -> int:
        """Appends rows; refuses null or repeated keys, broken checks and references that point nowhere. The number of rows."""
        if name not in TABLES:
            raise KeyError(f"unknown table {name}")
        table = TABLES[name]
        new = with_defaults(rows, table).cache()
        try:
            n = new.count()
            broken = [f"{r.rule}: {r.n}" for r in key_conflicts(self.table(name), new, table).unionByName(check_violations(new, table)).filter("n > 0").collect()]
            if table.references:
                others = self.tables() | {name: new}
                broken += [f"{r.table_name} -> {r.reference}: {r.n}" for r in reference_violations(others, [name]).filter("n > 0").collect()]
            if broken:
                raise ValueError(f"{name}: {', '.join(broken)}")
            if n:
                self._change("tables", name, [*self._state().get("tables", {}).get(name, []), self._write(name, new)])
            return n
        finally:
            new.unpersist()

    def query(self, sql: str, **args) -> DataFrame:
        """A SQL query with named parameters over the current snapshots."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args)
