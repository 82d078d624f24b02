"""Text statistics of every document, their exact ranks within each language, and outlier scores from tail probabilities.

1. One narrow pass reads each text and gives its statistics, unrounded, among them the shares of its characters in list,
   table and junk lines.
2. Each distinct content counts once, so that a text which a third of all documents repeat moves no rank. Its values are
   counted per language and statistic with map-side aggregation; the distinct values are range-partitioned by (statistic,
   value) and sorted. Each partition sums its counts per language and over all languages, the sums of earlier partitions
   are its offsets, and offset plus running count is the exact rank of a value, within its language and among all.
3. A value's tail probabilities P(X <= x) and P(X >= x) are those of its language, with those among all languages weighing
   as much as PRIOR contents, so that a language of one document has a reference too. SIDES says on which side a statistic
   leaves prose; only those count.
4. Each document's tails come by joining its values with the rank table; values that more than 1/(4 x partitions) of all
   documents share, a bounded number, are broadcast, so no join key is hot. The outlier score is the sum of the negative
   logarithms of the tails. A document of at least LEAST_SCORE is an outlier; it is of the kind whose share lies furthest
   in its upper tail.

Defined cases: null and blank texts have null statistics, no rank, no score and no kind; an unknown, null or differently
written language falls to its first part in lower case or to `und`; ties share a rank; repeated rows are each scored; an
outlier without any list, table or junk line has no kind; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.text_parts import KINDS, CommonWords, read_texts
from strataloom.session import cut_lineage

STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "distinct_words", "list_share", "table_share", "junk_share")
#: The side on which a statistic leaves prose; the others are ranked on both sides and do not enter the score.
SIDES = {"symbol_ratio": "upper", "digit_ratio": "upper", "punctuated_lines": "lower", "common_words": "lower", "list_share": "upper", "table_share": "upper", "junk_share": "upper"}
PRIOR = 200
#: About a ninth of prose and all but a thousandth of the rest reach it on the test tables.
LEAST_SCORE = 4.0
MOST_COMMON_WORDS = 100_000
MOST_SPAN = 2_000_000  # characters of texts that are read at once


def read_common(words: DataFrame) -> CommonWords:
    """The common-word table, a dictionary of the languages; refused beyond MOST_COMMON_WORDS rows."""
    rows = words.select("lang", "word").filter("lang is not null and word is not null and word <> ''").limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    return CommonWords([(r.lang, r.word) for r in rows])


def _spans(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts that are not blank, in stretches of about MOST_SPAN characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if text is not None and not text.isspace() and text:
            held.append(i)
            size += len(text)
            if size > MOST_SPAN:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_statistics(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, digest of the text, language, the statistics) of every row, in one narrow pass."""
    common = read_common(common_words)
    body = F.col(text).cast("string")
    source = df.select(F.col(key).alias("__key"), F.unhex(F.md5(body)).alias("digest"), body.alias("__text"), F.lower(F.regexp_extract(F.coalesce(F.col(lang).cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1)).alias("__lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            values = np.full((len(STATISTICS), len(texts)), np.nan)
            for span in _spans(texts):
                for i, (stats, _) in zip(span, read_texts([texts[i] for i in span], common)):
                    values[:, i] = [stats[s] for s in STATISTICS]
            languages = [x if x in common.languages else "und" for x in batch.column(3).to_pylist()]
            columns = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), *columns], ["__key", "digest", "language", *STATISTICS])

    key_type = source.schema["__key"].dataType.simpleString()
    schema = f"__key {key_type}, digest binary, language string, {', '.join(f'{s} double' for s in STATISTICS)}"
    return source.mapInArrow(run, schema).withColumnRenamed("__key", key)


def long_values(*columns: str) -> list:
    """columns, then statistic (its number) and value: a row for each statistic."""
    pairs = ", ".join(f"{i}, `{s}`" for i, s in enumerate(STATISTICS))
    return [*columns, F.expr(f"stack({len(STATISTICS)}, {pairs}) as (statistic, value)")]


RANKS = "statistic int, value double, language string, copies bigint, below bigint, upto bigint, total bigint, all_below bigint, all_upto bigint, all_total bigint"


def exact_ranks(stats: DataFrame) -> DataFrame:
    """RANKS: contents below and up to each distinct value, in its language and in all; copies counts repeated rows too."""
    contents = stats.filter(F.col(STATISTICS[0]).isNotNull()).groupBy("language", "digest").agg(*(F.first(s).alias(s) for s in STATISTICS), F.count("*").alias("copies"))
    counted = contents.select(*long_values("language", "copies")).groupBy("statistic", "value", "language").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal values of all languages lie in one partition: a row for each language
    ordered = cut_lineage(counted.repartitionByRange(parts, "statistic", "value").sortWithinPartitions("statistic", "value", "language"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for batch in batches:
            statistic, language, n = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), object), batch.column(3).to_numpy()
            for s in np.unique(statistic):
                for x in set(language[statistic == s]):
                    found[int(s), x] = found.get((int(s), x), 0) + int(n[(statistic == s) & (language == x)].sum())
        part = TaskContext.get().partitionId()
        rows = [{"part": part, "statistic": s, "language": x, "n": n} for (s, x), n in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("statistic", pa.int32()), ("language", pa.string()), ("n", pa.int64())]))

    # a row for each partition, language and statistic in it: about (partitions + statistics) x languages, as partitions are ranges
    totals: dict[tuple, int] = {}
    offsets: dict[tuple, int] = {}
    for r in sorted(ordered.select("statistic", "value", "language", "n").mapInArrow(sums, "part int, statistic int, language string, n bigint").collect(), key=lambda r: r.part):
        for group in ((r.statistic, r.language), (r.statistic, None)):
            offsets.setdefault((r.part, *group), totals.get(group, 0))
            totals[group] = totals.get(group, 0) + r.n

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, rest = TaskContext.get().partitionId(), {}, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            statistic, value = table["statistic"].to_numpy(), table["value"].to_numpy()
            same = (statistic == statistic[-1]) & (value == value[-1]) if len(value) else np.zeros(0, bool)
            cut = len(value) - int(same.sum())  # the last value may go on in the next batch
            if cut:
                yield numbered(table.slice(0, cut), part, seen)
            rest = table.slice(cut).combine_chunks().to_batches()[0] if cut < len(value) else None
        if rest is not None:
            yield numbered(pa.Table.from_batches([rest]), part, seen)

    def numbered(table: pa.Table, part: int, seen: dict) -> pa.RecordBatch:
        statistic, value, n = table["statistic"].to_numpy(), table["value"].to_numpy(), table["n"].to_numpy()
        language = np.array(table["language"].to_pylist(), object)
        out = np.zeros((6, len(n)), np.int64)
        for s in np.unique(statistic):
            at = np.flatnonzero(statistic == s)
            first = np.flatnonzero(np.r_[True, value[at][1:] != value[at][:-1]])
            size = np.add.reduceat(n[at], first)
            start = offsets[part, int(s), None] + seen.get((s, None), 0)
            upto = start + np.cumsum(size)
            times = np.diff(np.append(first, len(at)))
            out[3, at], out[4, at], out[5, at] = np.repeat(upto - size, times), np.repeat(upto, times), totals[int(s), None]
            seen[s, None] = seen.get((s, None), 0) + int(size.sum())
            for x in set(language[at]):
                own = at[language[at] == x]
                upto = offsets[part, int(s), x] + seen.get((s, x), 0) + np.cumsum(n[own])
                out[0, own], out[1, own], out[2, own] = upto - n[own], upto, totals[int(s), x]
                seen[s, x] = seen.get((s, x), 0) + int(n[own].sum())
        columns = [table[c].combine_chunks() for c in ("statistic", "value", "language", "copies")]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, out)], [f.split()[0] for f in RANKS.split(", ")])

    return ordered.mapInArrow(ranks, RANKS)


def tails_of(ranks: DataFrame) -> DataFrame:
    """(statistic, value, language, copies, tail): the tail on the side of SIDES, or the smaller one."""
    def mixed(own, every):
        return (own + PRIOR * every / F.col("all_total")) / (F.col("total") + PRIOR)

    lower, upper = mixed(F.col("upto"), F.col("all_upto")), mixed(F.col("total") - F.col("below"), F.col("all_total") - F.col("all_below"))
    side = F.create_map(*(x for i, s in enumerate(STATISTICS) for x in (F.lit(i), F.lit(SIDES.get(s, "both")))))[F.col("statistic")]
    tail = F.when(side == "upper", upper).when(side == "lower", lower).otherwise(F.least(lower, upper))
    return ranks.select("statistic", "value", "language", "copies", tail.alias("tail"))


def outlier_scores(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, language, the statistics, a tail for each, outlier_score and kind. stats should be a table or checkpoint."""
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["statistic", "value", "language"]
    ranks = cut_lineage(tails_of(exact_ranks(stats)))
    numbered = stats.drop("digest").withColumn("__row", F.monotonically_increasing_id())
    values = numbered.select(*long_values("__row", "language")).filter("value is not null")
    is_hot = F.col("copies") * (4 * parts) > stats.count()  # at most 4 * parts values a statistic
    hot = values.join(F.broadcast(ranks.filter(is_hot).select(*names, "tail")), names, "left")
    cold = hot.filter("tail is null").drop("tail").join(ranks.filter(~is_hot).select(*names, "tail"), names)
    each = hot.filter("tail is not null").select("__row", "statistic", "tail").unionByName(cold.select("__row", "statistic", "tail"))
    tails = {s: f"tail_{s}" for s in STATISTICS}
    wide = each.groupBy("__row").agg(*(F.max(F.when(F.col("statistic") == i, F.col("tail"))).alias(tails[s]) for i, s in enumerate(STATISTICS)))
    score = sum((-F.log(tails[s]) for s in list(SIDES)[1:]), -F.log(tails[next(iter(SIDES))]))
    largest = F.greatest(*(F.col(f"{k}_share") for k in KINDS))
    able = [F.when((largest > 0) & (F.col(f"{k}_share") * 2 > largest), F.col(tails[f"{k}_share"])) for k in KINDS]  # no scraps beside a larger part
    kind = F.coalesce(*(F.when(own == F.least(*able), F.lit(k)) for k, own in zip(KINDS, able)))
    scored = numbered.join(wide, "__row", "left").withColumn("outlier_score", score)
    return scored.withColumn("kind", F.when(F.col("outlier_score") >= LEAST_SCORE, kind)).select(key, "language", *STATISTICS, *tails.values(), "outlier_score", "kind")


def scored_texts(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Statistics, tail probabilities, outlier score and kind of every row; texts are read once."""
    return outlier_scores(cut_lineage(text_statistics(df, common_words, key, text, lang)), key)


def not_prose(scored: DataFrame) -> DataFrame:
    """The outliers of a kind whose lines of all three kinds hold more characters than those of prose."""
    return scored.filter(F.col("kind").isNotNull() & (sum((F.col(f"{k}_share") for k in KINDS[1:]), F.col(f"{KINDS[0]}_share")) > 0.5))
