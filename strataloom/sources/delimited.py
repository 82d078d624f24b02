"""Delimited rows checked and parsed by structural indexing in numpy; failing rows come out with a reason.

The rows of a batch that share delimiter and quote character lie end to end in one array of code points. A mask marks
the quotes, a running count of them within each row gives the parity at every position, and a delimiter at even parity
ends a field. If every field so found either holds no quote or opens and closes with one and doubles those inside, the
fields are the true ones; otherwise the row's quoting is broken. (A reader that goes from left to right meets the same
ends as long as all fields are well formed, so the first ill-formed one shows in both readings.) Field counts, lengths
and allowed values follow. The first reason that holds is given: quoting, column_count, invalid_value.

Defined cases: a null row has no fields (column_count); an empty row has one empty field; a row of a feed that the feed
table lacks is read with the default dialect; a null quote character means that nothing is quoted; line breaks outside
quotes belong to the field; columns beyond those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

#: Columns in order, with the least and the largest length in characters.
COLUMNS = ("doc_id", "title", "text", "source_uri", "author", "classification_level", "language")
LENGTHS = {"doc_id": (1, 256), "title": (1, 1000), "text": (1, None), "source_uri": (1, 2048), "author": (1, 512)}
ALLOWED = {
    "classification_level": ("public", "internal", "confidential", "restricted"),
    "language": ("en", "ar", "de", "es", "fr", "it", "ja", "ko", "pt", "zh"),
}
MOST_FEEDS = 10_000
CHARS = 4_000_000  # code points indexed at once


@dataclass(frozen=True)
class Contract:
    """What a row has to meet."""

    columns: tuple[str, ...] = COLUMNS
    lengths: tuple = tuple(LENGTHS.items())
    allowed: tuple = tuple(ALLOWED.items())


def index_rows(rows: list[str], delimiter: str, quote: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each field, its start and end within the row, whether it is quoted, whether the row's quoting is sound)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    chars = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    quotes = chars == ord(quote) if quote else np.zeros(len(chars), bool)
    seen = np.concatenate([[0], np.cumsum(quotes)])  # quotes before each position
    cut = np.flatnonzero(chars == ord(delimiter))
    cut = cut[(seen[cut] - seen[starts[owner[cut]]]) % 2 == 0]
    # fields: one from each row's start and one after each cut
    row = np.concatenate([np.arange(len(rows)), owner[cut]])
    begin = np.concatenate([starts, cut + 1])
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    end = np.where(last, ends[row], np.r_[begin[1:] - 1, 0] if len(begin) else begin)
    count = seen[end] - seen[begin]
    at = np.flatnonzero(quotes)
    padded = np.append(chars, 0)
    opens = (count > 0) & (padded[begin] == (ord(quote) if quote else 0)) & (end > begin)
    closes = (end - begin >= 2) & (padded[np.maximum(end - 1, 0)] == (ord(quote) if quote else 0))
    sound = (count == 0) | (opens & closes & (count % 2 == 0))
    # quotes inside a field: the 2nd and 3rd, 4th and 5th ... must touch
    inner = np.repeat(np.arange(len(row)), count)
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    first = np.flatnonzero((place % 2 == 1) & (place < count[inner] - 1))
    broken = inner[first[at[np.minimum(first + 1, len(at) - 1)] != at[first] + 1]] if len(first) else first
    sound[broken] = False
    fine = np.ones(len(rows), bool)
    fine[row[~sound]] = False
    return row, begin - starts[row], end - starts[row], opens & sound, fine


def check_rows(rows: list[str], delimiter: str, quote: str | None, contract: Contract) -> tuple[list[str | None], list[list[str | None]]]:
    """The reason of each row (None if it is valid) and its values by column (None if it is not)."""
    row, begin, end, quoted, fine = index_rows(rows, delimiter, quote)
    width = len(contract.columns)
    counts = np.bincount(row, minlength=len(rows))
    reasons = np.where(~fine, "quoting", np.where(counts != width, "column_count", "")).astype(object)
    ok = np.flatnonzero(reasons == "")
    values = np.full((len(rows), width), None, object)
    lead = np.cumsum(counts) - counts
    for c, name in enumerate(contract.columns):
        fields = lead[ok] + c
        for i, b, e, q in zip(ok.tolist(), begin[fields].tolist(), end[fields].tolist(), quoted[fields].tolist()):
            values[i, c] = rows[i][b + 1 : e - 1].replace(quote * 2, quote) if q else rows[i][b:e]
    good = np.ones(len(ok), bool)
    for name, (least, most) in contract.lengths:
        sizes = np.fromiter((len(v) for v in values[ok, contract.columns.index(name)]), np.int64, len(ok))
        good &= (sizes >= least) & ((sizes <= most) if most is not None else True)
    for name, allowed in contract.allowed:
        known = frozenset(allowed)
        good &= np.fromiter((v in known for v in values[ok, contract.columns.index(name)]), bool, len(ok))
    bad = ok[~good]
    reasons[bad] = "invalid_value"
    values[bad] = None
    return [r or None for r in reasons.tolist()], values.T.tolist()


def dialects(feeds: DataFrame) -> dict[str, tuple[str, str | None]]:
    """The feed table as a dictionary; it describes sources, one row each, and is refused beyond MOST_FEEDS rows."""
    rows = feeds.select("feed", "delimiter", "quote_char").limit(MOST_FEEDS + 1).collect()
    if len(rows) > MOST_FEEDS:
        raise ValueError(f"more than {MOST_FEEDS} feeds")
    found = {r.feed: (r.delimiter, r.quote_char or None) for r in rows if r.feed is not None and r.delimiter}
    if odd := [f for f, (d, q) in found.items() if len(d) != 1 or (q and len(q) != 1)]:
        raise ValueError(f"delimiter and quote character must be single characters: {odd[:5]}")
    return found


def parse_rows(df: DataFrame, feeds: DataFrame, key: str = "record_id", feed: str = "feed", line: str = "raw_line", contract: Contract = Contract(), default: tuple[str, str | None] = (",", '"'), with_values: bool = True) -> DataFrame:
    """(key, reason, the contract's columns) of every row in one narrow pass; reason is null for valid rows."""
    known = dialects(feeds)
    source = df.select(F.col(key).alias("__key"), F.col(feed).cast("string").alias("__feed"), F.col(line).cast("string").alias("__line"))
    key_type = source.schema["__key"].dataType.simpleString()
    names = list(contract.columns) if with_values else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(np.fromiter((len(x or "") for x in whole.column(2).to_pylist()), np.int64, whole.num_rows))
            at = 0
            while at < whole.num_rows:
                base = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + CHARS, side="right")))
                yield one(whole.slice(at, end - at))
                at = end

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, groups = batch.column(2).to_pylist(), {}
        for i, name in enumerate(batch.column(1).to_pylist()):
            if lines[i] is not None:
                groups.setdefault(known.get(name, default), []).append(i)
        reasons: list[str | None] = ["column_count"] * len(lines)
        columns: list[list[str | None]] = [[None] * len(lines) for _ in contract.columns]
        for (delimiter, quote), own in groups.items():
            found, values = check_rows([lines[i] for i in own], delimiter, quote, contract)
            for k, i in enumerate(own):
                reasons[i] = found[k]
            for column, value in zip(columns, values):
                for k, i in enumerate(own):
                    column[i] = value[k]
        arrays = [batch.column(0), pa.array(reasons, pa.string())]
        if with_values:
            arrays += [pa.array(c, pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, ["__key", "reason", *names])

    schema = ", ".join([f"__key {key_type}", "reason string", *(f"`{c}` string" for c in names)])
    return source.mapInArrow(run, schema).withColumnRenamed("__key", key)


def split_valid(parsed: DataFrame, key: str = "record_id", contract: Contract = Contract()) -> tuple[DataFrame, DataFrame]:
    """The valid records, and the rejected rows with their reason."""
    return parsed.filter("reason is null").select(key, *contract.columns), parsed.filter("reason is not null").select(key, "reason")


def _raw(path: str, low: int, high: int) -> bytes:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        f.seek(low)
        return f.read(high - low)


def read_records_of_files(spark: SparkSession, path: str, quote: str | None = '"', range_bytes: int = 32 << 20) -> DataFrame:
    """(path, offset, raw_line): the records of delimited UTF-8 files, whose fields may hold line breaks in quotes.

    Workers read byte ranges. A first pass counts each range's quotes; prefix sums of them, one number a range, give the
    parity at each range's start. With it a range's quote mask tells which line breaks end a record. A record belongs to
    the range that it begins in, which reads on to its end. A quote that is never closed runs to the end of its file."""
    mark = quote.encode() if quote else None
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    n = F.ceil(F.col("size") / range_bytes).cast("int")
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("range_no")).repartition("path", "range_no")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_raw(r["path"], r["range_no"] * range_bytes, min(r["size"], (r["range_no"] + 1) * range_bytes)).count(mark) if mark else 0 for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "quotes"])

    counted = cut_lineage(ranges.mapInArrow(count, "path string, size bigint, range_no int, quotes bigint"))
    before = F.sum("quotes").over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    known = counted.select("path", "size", "range_no", F.coalesce(before, F.lit(0)).alias("before"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from records(r["path"], r["size"], r["range_no"] * range_bytes, r["before"])

    def ends_of(raw: bytes, parity: int) -> np.ndarray:
        """Places of the line breaks outside quotes."""
        data = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(data == 10)
        if mark is None:
            return breaks
        seen = np.concatenate([[parity], parity + np.cumsum(data == mark[0])])
        return breaks[seen[breaks] % 2 == 0]

    def records(path: str, size: int, offset: int, before: int) -> Iterator[pa.RecordBatch]:
        high = min(size, offset + range_bytes)
        low = max(0, offset - 1)  # a line break right before the range begins a record in it
        raw = _raw(path, low, high)
        if offset and mark and raw[:1] == mark:
            before -= 1  # that byte's quote is counted already
        ends = ends_of(raw, before)
        starts = np.concatenate([[0] if not offset else [], ends + 1]).astype(np.int64)
        starts = starts[starts + low < high]
        if not len(starts):
            return
        parity = before + (raw.count(mark) if mark else 0)
        while not len(ends) or ends[-1] < starts[-1]:  # the last record goes on
            more = _raw(path, high, min(size, high + (1 << 20)))
            if not more:
                ends = np.append(ends, len(raw))
                break
            found = ends_of(more, parity)
            ends = np.append(ends, found[:1] + len(raw))
            parity += more.count(mark) if mark else 0
            raw, high = raw + more, high + len(more)
        stops = ends[np.searchsorted(ends, starts)]
        lines = [raw[a:b].removesuffix(b"\r").decode("utf-8", "replace") for a, b in zip(starts.tolist(), stops.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(starts + low), pa.array(lines, pa.string())], ["path", "offset", "raw_line"])

    return known.mapInArrow(cut, "path string, offset bigint, raw_line string")
