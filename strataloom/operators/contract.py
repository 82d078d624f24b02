"""The document contract: closed schema, required fields, lengths and allowed values, as column expressions.

Structural errors (missing or empty fields) come first; only a record without them is held against lengths and allowed
values, so a record has errors of one stage."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the governed-document contract.
FIELDS = ("doc_id", "title", "text")
METADATA_FIELDS = ("source_uri", "author", "classification_level", "language")
CHARACTER_LIMITS = {
    "doc_id": (1, 256), "title": (1, 1000), "text": (1, 10_000_000), "source_uri": (1, 2048), "author": (1, 512), "classification_level": (1, 32), "language": (2, 8),
}
ALLOWED_VALUES = {
    "classification_level": ("public", "internal", "confidential", "restricted"),
    "language": ("en", "ar", "de", "es", "fr", "it", "ja", "ko", "pt", "zh"),
}
MINIMUM = {"language": 2}


@dataclass(frozen=True)
class DocumentContract:
    limits: dict = field(default_factory=lambda: dict(CHARACTER_LIMITS))
    allowed: dict = field(default_factory=lambda: dict(ALLOWED_VALUES))

    @classmethod
    def from_yaml(cls, path: str) -> DocumentContract:
        """Reads a contract file; the parts it must have are checked."""
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
        for part in ("required_fields", "required_metadata_fields", "allowed_values", "character_limits"):
            if part not in (raw or {}):
                raise ValueError(f"contract lacks {part}")
        return cls({k: (v["min"], v["max"]) for k, v in raw["character_limits"].items()}, {k: tuple(v) for k, v in raw["allowed_values"].items()})


def _column(name: str) -> Column:
    return F.col(name) if name in FIELDS else F.col(f"metadata.{name}")


def _error(name: str, rule: str) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"))


def errors(contract: DocumentContract = DocumentContract(), extra: Column | None = None) -> Column:
    """array<struct<field, rule>> of a record with columns doc_id, title, text and metadata; extra: names of unknown fields."""
    structural, rules = [], []
    for name in (*FIELDS, *METADATA_FIELDS):
        c = _column(name)
        structural.append(F.when(c.isNull(), _error(name, "missing")).when(F.length(c) < MINIMUM.get(name, 1), _error(name, "too_short")))
        if name in contract.limits:
            low, high = contract.limits[name]
            rules.append(F.when((F.length(c) < low) | (F.length(c) > high), _error(name, "length")))
        if name in contract.allowed:
            rules.append(F.when(~c.isin(*contract.allowed[name]), _error(name, "allowed_values")))
    first = F.array_compact(F.array(*structural))
    if extra is not None:
        first = F.concat(first, F.transform(extra, lambda n: F.struct(n.alias("field"), F.lit("extra").alias("rule"))))
    return F.when(F.size(first) > 0, first).otherwise(F.array_compact(F.array(*rules)))


def validate(df: DataFrame, contract: DocumentContract = DocumentContract(), extra: Column | None = None) -> DataFrame:
    return df.withColumn("errors", errors(contract, extra))


def split(df: DataFrame, contract: DocumentContract = DocumentContract()) -> tuple[DataFrame, DataFrame]:
    """Valid records, and invalid ones with their errors."""
    checked = validate(df, contract)
    return checked.filter("size(errors) = 0").drop("errors"), checked.filter("size(errors) > 0")


def split_counts(df: DataFrame, contract: DocumentContract = DocumentContract()) -> DataFrame:
    """(valid, invalid) in one pass."""
    bad = F.size("errors") > 0
    return validate(df, contract).agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))
