"""Column expressions of the data model; all built in, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of name-based identifiers, as bytes.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """The name-based (version 5) identifier in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def traffic_bucket(query: Column) -> Column:
    """The SHA-256 of a query as one number, modulo 1,000, by Horner over words of 32 bits; null stays null."""
    h = F.sha2(query.cast("binary"), 256)
    total = F.lit(0).cast("bigint")
    for i in range(8):
        word = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        total = (total * ((1 << 32) % 1000) + word) % 1000
    return total.cast("int")


def route(query: Column, ratio: float, has_shadow: bool = True) -> Column:
    """live or shadow: everything is live at a ratio of 1 or without a shadow, shadow at 0, else by the query's bucket."""
    if ratio >= 1 or not has_shadow:
        return F.lit("live")
    if ratio <= 0:
        return F.lit("shadow")
    return F.when(traffic_bucket(query) / 1000 < ratio, "live").otherwise("shadow")


#: White space by Unicode's property, as a class for the JVM's expressions.
WHITE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(text: Column) -> Column:
    """Maximal runs without white space, in order."""
    return F.regexp_extract_all(text, F.lit(f"[^{WHITE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+"))


def planned_tokens(text: Column) -> Column:
    """Tokens to plan with: 1.3 for each word, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(word_count(text) * 1.3)).cast("bigint")


def metered_tokens(text: Column) -> Column:
    """Tokens to meter: one for each word, one at least."""
    return F.greatest(F.lit(1), word_count(text)).cast("bigint")


def batches(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("bigint")


def chunk_hash(text: Column, version: Column) -> Column:
    return F.sha2(F.concat(text, version), 256)


def chunk_id(doc_id: Column, index: Column) -> Column:
    """doc_id:index, the index with four digits at least."""
    return F.concat(doc_id, F.lit(":"), F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string")))


def short_model_name(name: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(name, "/", -1)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in per cent, 0 of nothing."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def numeric_first(identifier: Column) -> list[Column]:
    """Sort keys: whole numbers by value first, then the rest by text."""
    number = F.when(identifier.rlike(r"^\d{1,38}$"), identifier.cast("decimal(38,0)"))
    return [number.isNull(), number, identifier]


def row_digest(columns: list[Column]) -> Column:
    """A digest of a row's values."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)


def fingerprint(digest: Column) -> Column:
    """An aggregate over row digests that does not depend on their order and changes with any value: count and sum."""
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string"))


def migration_id() -> Column:
    """mig_ and twelve random hexadecimal digits."""
    return F.concat(F.lit("mig_"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12))


def ranking_id(id_: Column, doc_id: Column, document_id: Column) -> Column:
    """An item's id under the first of the three names that is set."""
    return F.coalesce(id_, doc_id, document_id)


def fault(key: Column, fail_rate: float) -> Column:
    """A fault drawn by hash: rate_limit, connection or malformed in equal parts of fail_rate, else null."""
    kind = traffic_bucket(F.concat(key, F.lit(":kind"))) / 1000
    drawn = F.when(kind < 1 / 3, "rate_limit").when(kind < 2 / 3, "connection").otherwise("malformed")
    return F.when(traffic_bucket(F.concat(key, F.lit(":fault"))) / 1000 < fail_rate, drawn)


def backoff_seconds(attempt: Column, base: float, chance: Column) -> Column:
    """base * 2^attempt * (0.5 + chance), chance from 0 to 1."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt) * (F.lit(0.5) + chance)
