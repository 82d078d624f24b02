"""Row numbers and exact percentiles over a whole order, by sorted partitions and their offsets: no task sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

MOST_OFFSETS = 1_000_000


def numbered(df: DataFrame, order: list[str], by: list[str] = [], name: str = "row_no") -> DataFrame:
    """df with a number from 1 in the order of `order`, within each group of `by` if there are any.

    Rows are range-partitioned by (by, order) and sorted; a partition's rows count on from the rows of the group in earlier
    ones, of which there is a count for each partition and group in it, refused beyond MOST_OFFSETS."""
    keys = [*by, *order]
    ordered = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("__part"), *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).limit(MOST_OFFSETS + 1).toPandas()
    if len(counts) > MOST_OFFSETS:
        raise ValueError(f"more than {MOST_OFFSETS} parts of groups")
    counts = counts.sort_values(["__part", "__first"], kind="stable")
    before = (counts.groupby(by, dropna=False)["__n"].cumsum() if by else counts["__n"].cumsum()) - counts["__n"]
    rows = list(zip(counts["__part"].tolist(), counts["__first"].tolist(), before.tolist()))
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0, 0)], "__p bigint, __f bigint, __b bigint")
    # a group's rows of a partition lie together, so its first place there stands for it
    if by:
        theirs = [f"__k{i}" for i in range(len(by))]
        firsts = ordered.groupBy(part.alias("__p"), *(F.col(b).alias(t) for b, t in zip(by, theirs))).agg(F.min("__at").alias("__f"))
        offsets = firsts.join(F.broadcast(offsets), ["__p", "__f"]).withColumnRenamed("__p", "__q")
        same = [F.col(b).eqNullSafe(F.col(t)) for b, t in zip(by, theirs)]
        joined = ordered.withColumn("__p", part).join(F.broadcast(offsets), [F.col("__p") == F.col("__q"), *same])
    else:
        joined = ordered.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return joined.select(*df.columns, (F.col("__b") + F.col("__at") - F.col("__f") + 1).alias(name))


def exact_percentiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, value): interpolated percentiles as of all values of a group in order; nulls are left out.

    Equal values are counted before the sort, and only the values at the wanted places leave a partition."""
    v = F.col(value).cast("double")
    counted = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
    ordered = cut_lineage(counted.repartitionByRange(*by, "__v").sortWithinPartitions(*by, "__v"))
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields[: len(by)]]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f.assign(**{"__g": 0}).groupby([*by, "__g"], dropna=False, sort=False)["__n"].sum().reset_index() for f in frames if len(f)]
        if held:
            total = pd.concat(held).groupby([*by, "__g"], dropna=False, sort=False)["__n"].sum().reset_index()
            yield total.drop(columns="__g").assign(__part=TaskContext.get().partitionId())

    found = ordered.mapInPandas(sums, ", ".join([*keys, "__n bigint", "__part int"])).limit(MOST_OFFSETS + 1).collect()
    if len(found) > MOST_OFFSETS:
        raise ValueError(f"more than {MOST_OFFSETS} parts of groups")
    totals: dict[tuple, int] = {}
    offsets: dict[tuple, int] = {}
    for r in sorted(found, key=lambda r: r["__part"]):
        group = tuple(r[b] for b in by)
        offsets[(r["__part"], *group)] = totals.get(group, 0)
        totals[group] = totals.get(group, 0) + r["__n"]

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), {}
        for f in frames:
            for _, rows in f.assign(**{"__g": 0}).groupby([*by, "__g"], dropna=False, sort=False):
                group = tuple(None if pd.isna(x) else x for x in rows[by].iloc[0])
                start = offsets[(part, *group)] + seen.get(group, 0)
                upto = start + rows["__n"].to_numpy().cumsum()
                seen[group] = seen.get(group, 0) + int(rows["__n"].sum())
                values = rows["__v"].to_numpy()
                out = []
                for share in shares:
                    at = share * (totals[group] - 1)
                    low = int(np.floor(at))
                    for place, weight in ((low, 1 - (at - low)), (low + 1, at - low)):
                        i = int(np.searchsorted(upto, place, side="right"))
                        if weight and start <= place < upto[-1]:
                            out.append((*group, share, values[i] * weight))
                if out:
                    yield pd.DataFrame(out, columns=[*by, "__share", "__w"])

    parts = ordered.mapInPandas(places, ", ".join([*keys, "__share double", "__w double"]))
    return parts.groupBy(*by, F.col("__share").alias("share")).agg(F.sum("__w").alias("value"))


def batch_number(row_no: Column, size: int) -> Column:
    """Number from 0 of the batch of `size` rows that a row number from 1 falls in."""
    return F.floor((row_no - 1) / size).cast("bigint")
