"""Cutting oversized texts into overlapping pieces at natural boundaries, range by range.

1. Every text is cut into ranges of `range_chars`; of a range, with a few characters of halo on either side, a worker
   finds where tokens (maximal runs without Unicode white space) begin, and how strong the boundary before each is:
   3 paragraph (two line breaks or more), 2 line, 1 sentence end, 0 neither. That boundary table and a summary of the
   range are written to the shared folder, compressed.
2. What a range cannot know (tokens before it, the last token's end, line breaks and sentence end since then, the starts
   of the last tokens) comes from the summaries, folded in order with prefix sums of the token counts. The one range of
   a short text has nothing before it.
3. Each range finds the cuts in it and hands out the pieces that begin and end in it. Cuts whose window reaches into
   another range, and the two ends of pieces that do, meet by (text, strategy, number), so that no task gathers a text.

Cuts lie on a grid, so that each is found where it lies and giant texts are cut in parallel: with room = size - overlap
and slack = room // 2, the k-th cut is the strongest boundary, the latest of equals, among the `slack` boundaries up to
token overlap + k * (room - slack). Piece k begins `overlap` tokens before cut k - 1 and ends at cut k; it never exceeds `size`,
and consecutive pieces share exactly `overlap` tokens. Texts within the size are one piece.

Files are read by byte range in the same way, spread over the workers, never whole. Offsets count code points (bytes for
files), so pieces can be cut out of the source later. A file that is not UTF-8 in every range is read as Latin-1 in all.

Defined cases: null texts and texts without tokens have no pieces; a strategy whose size is null or below 1 is left
out, an overlap is taken between 0 and size - 1, null as 0; deliveries of one key are taken to carry the same text and
count once; ties take the latest boundary; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import write_shared

RANGE_CHARS = 16_384
RANGE_BYTES = 8 << 20
MOST_STRATEGIES = 1000
HALO = 4
BATCH_CHARS = 2_000_000

#: Unicode White_Space, and those of it that break a line.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BREAKS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)
ENDERS = ".!?…。！？؟।"
CLOSERS = "\"')]}»”’*_"
_TOP = 0xFF60  # code points from here on are in no class
_CLASS = np.zeros(_TOP + 1, np.uint8)
for _flag, _points in ((1, WHITE), (2, BREAKS), (4, map(ord, ENDERS)), (8, map(ord, CLOSERS))):
    for _p in _points:
        _CLASS[_p] |= _flag


@dataclass(frozen=True)
class Strategy:
    name: str
    version: str
    size: int
    overlap: int

    @property
    def slack(self) -> int:
        return (self.size - self.overlap) // 2

    @property
    def step(self) -> int:
        return self.size - self.overlap - self.slack


@dataclass
class Carry:
    """What a range has to know of the ranges before it, and the number of tokens of the whole text."""

    total: int = 0
    tokens: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end: int = -1
    breaks: int = 0
    sentence: bool = False


def read_strategies(strategies: DataFrame) -> list[Strategy]:
    """The strategy table as objects; it is configuration and is refused beyond MOST_STRATEGIES rows."""
    rows = strategies.select("strategy_name", "strategy_version", "chunk_size_tokens", "chunk_overlap_tokens").distinct().limit(MOST_STRATEGIES + 1).collect()
    if len(rows) > MOST_STRATEGIES:
        raise ValueError(f"more than {MOST_STRATEGIES} strategies")
    return [Strategy(a, b, n, min(max(o or 0, 0), n - 1)) for a, b, n, o in sorted(map(tuple, rows), key=str) if n is not None and n >= 1]


def scan(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, token ends (exclusive), whether each end closes a sentence, and line breaks before each position."""
    kind = _CLASS[np.minimum(chars, _TOP)]
    solid = (kind & 1) == 0
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    padded = np.concatenate([[0, 0], kind])  # padded[e + 1] is the last character of a token that ends at e
    last, second, third = padded[ends + 1], padded[ends], padded[np.maximum(ends - 1, 0)]
    closing, closing2 = (last & 8) > 0, (second & 8) > 0
    sentence = ((last & 4) > 0) | (closing & ((second & 4) > 0)) | (closing & closing2 & ((third & 4) > 0))
    line = (kind & 2) > 0
    line[:-1] &= ~((chars[:-1] == 13) & (chars[1:] == 10))
    return starts, ends, sentence, np.concatenate([[0], np.cumsum(line)])


def strengths(breaks: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    return np.where(breaks >= 2, 3, np.where(breaks == 1, 2, sentence.astype(np.int64)))


def candidates(tokens: int, total: int, strength: np.ndarray, s: Strategy) -> tuple[np.ndarray, np.ndarray]:
    """Of each grid window that the range touches: its number and the best boundary, as strength << 40 | token."""
    t = tokens + np.arange(len(strength))
    k = -(-(t - s.overlap) // s.step)
    on = (k > 0) & (t > s.overlap + k * s.step - max(s.slack, 1)) & (k < -(-(total - s.overlap) // s.step))
    t, k, value = t[on], k[on], (strength[on] << 40) | t[on]
    if not len(k):
        return k, value
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.maximum.reduceat(value, first)


_MASK = (1 << 40) - 1
PIECE = "strategy_name string, strategy_version string, piece_no int, n_pieces int, first_token bigint, n_tokens bigint, char_start bigint, char_end bigint"
SUMMARY = "n_starts bigint, last_starts binary, last_end bigint, all_breaks bigint, breaks_first bigint, breaks_last bigint, sentence_last boolean"
TABLE = f"range_no int, n_ranges int, offset bigint, starts binary, ends binary, strength binary, {SUMMARY}"
CARRY = "range_no int, total bigint, tokens bigint, c_starts binary, c_end bigint, c_breaks bigint, c_sentence boolean, closes boolean"
_NAMES = {x: [f.split()[0] for f in x.split(", ")] for x in (PIECE, SUMMARY, TABLE, CARRY)}


def scan_ranges(parts: list[str], leads: list[int], cores: list[int], most_overlap: int) -> list[tuple]:
    """Boundary table and summary of each range: `lead` characters of halo, `core` own ones, halo or the text's end.

    Positions count from the core's start. A token belongs to the range it begins in, an end to that of the token's last
    character. ends has the end before each start, -1 if none is in this range; the strength of such a start counts line
    breaks since the core's start (breaks_first) and is mended when the carry is known."""
    chars = np.frombuffer("\n".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends, sentence, lines = scan(chars)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(np.concatenate([[1], size[:-1] + 1]))
    low = begin + np.array(leads, np.int64)  # of the core
    high = low + np.array(cores, np.int64)
    s0, s1 = np.searchsorted(starts, low), np.searchsorted(starts, high)
    # a token that runs on into the halo ends in the next range
    e0, e1 = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="right")
    out = []
    for i in range(len(parts)):
        a, b, c, d = int(s0[i]), int(s1[i]), int(e0[i]), int(e1[i])
        own_starts, own_ends = starts[a:b], ends[c:d]
        before = np.searchsorted(own_ends, own_starts, side="right") - 1
        known = before >= 0
        if len(own_ends):
            at = own_ends[before]
            breaks = np.where(known, lines[own_starts] - lines[at], lines[own_starts] - lines[low[i]])
            strength = strengths(breaks, known & sentence[c:d][before])
            ends_before = np.where(known, at - low[i], -1)
        else:
            breaks = lines[own_starts] - lines[low[i]]
            strength, ends_before = strengths(breaks, known), np.full(len(own_starts), -1)
        all_breaks = int(lines[high[i]] - lines[low[i]])
        summary = (
            b - a, (own_starts[-most_overlap:] - low[i] if most_overlap else own_starts[:0]), int(own_ends[-1] - low[i]) if d > c else -1, all_breaks, int(breaks[0]) if b > a and not known[0] else -1,
            int(lines[high[i]] - lines[own_ends[-1]]) if d > c else all_breaks, bool(sentence[d - 1]) if d > c else False,
        )
        out.append((own_starts - low[i], ends_before, strength, summary))
    return out


def _tables(keys: list[pa.Array], names: list[str], rows: list[int], head: list[tuple], scanned: list[tuple], units: list | None = None) -> pa.RecordBatch:
    """Range tables as a batch; head has (range_no, n_ranges, offset) of each, units maps positions to bytes."""
    cols: list[list] = [[] for _ in _NAMES[TABLE]]
    for i, (starts, ends, strength, summary) in enumerate(scanned):
        last_starts, last_end = summary[1], summary[2]
        if units is not None:
            u = units[i]
            starts, ends, last_starts = u[starts], np.where(ends >= 0, u[np.maximum(ends, 0)], -1), u[last_starts]
            last_end = int(u[last_end]) if last_end >= 0 else -1
        values = (*head[i], np.diff(starts, prepend=0).astype(np.int32).tobytes(), np.where(ends >= 0, starts - ends, -1).astype(np.int32).tobytes(), strength.astype(np.uint8).tobytes(), summary[0], last_starts.astype(np.int64).tobytes(), last_end, *summary[3:])
        for col, v in zip(cols, values):
            col.append(v)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in TABLE.split(", ")]
    take = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([*(k.take(take) for k in keys), *(pa.array(c, t) for c, t in zip(cols, types))], [*names, *_NAMES[TABLE]])


def range_tables(source: DataFrame, names: list[str], range_chars: int, most_overlap: int) -> DataFrame:
    """A row for each range of each text: its boundary table and summary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i) for i in range(len(names))]
            held: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for row, text in enumerate(batch.column(len(names)).to_pylist()):
                count = max(1, -(-len(text) // range_chars))
                for no in range(count):
                    at = no * range_chars
                    lead = min(at, HALO)
                    part = text[at - lead : at + range_chars + HALO] if count > 1 else text
                    for column, value in zip(held, (row, (no, count, at), part, lead, min(range_chars, len(text) - at))):
                        column.append(value)
                    size += len(part)
                    if size >= BATCH_CHARS:
                        yield _tables(keys, names, held[0], held[1], scan_ranges(*held[2:], most_overlap))
                        held, size = ([], [], [], [], []), 0
            if held[0]:
                yield _tables(keys, names, held[0], held[1], scan_ranges(*held[2:], most_overlap))

    return source.mapInArrow(run, f"{_key_schema(source, names)}, {TABLE}")


def _key_schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def fold(rows: list[dict], most_overlap: int) -> list[Carry]:
    """The carry of each range from the summaries of one text's ranges, in order."""
    out, c = [], Carry(total=sum(r["n_starts"] for r in rows))
    for r in rows:
        out.append(Carry(c.total, c.tokens, c.starts, c.end, c.breaks, c.sentence))
        c.tokens += r["n_starts"]
        if most_overlap:
            c.starts = np.concatenate([c.starts, np.frombuffer(r["last_starts"], np.int64) + r["offset"]])[-most_overlap:]
        if r["last_end"] >= 0:
            c.end, c.breaks, c.sentence = r["last_end"] + r["offset"], r["breaks_last"], r["sentence_last"]
        else:
            c.breaks += r["all_breaks"]
    return out


def carries(scanned: DataFrame, names: list[str], most_overlap: int) -> DataFrame:
    """CARRY for each range of the texts of several, by a pass over the summaries in order."""
    summaries = scanned.filter("n_ranges > 1").select(*names, "range_no", "offset", *_NAMES[SUMMARY])
    ordered = summaries.repartition(*names).sortWithinPartitions(*names, "range_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[n] != held[0][n] for n in names):
                    yield carried(held, batch.schema)
                    held = []
                if not held or row["range_no"] != held[-1]["range_no"]:  # a key delivered again
                    held.append(row)
        if held:
            yield carried(held, batch.schema)

    def carried(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        closing = max((i for i, r in enumerate(rows) if r["last_end"] >= 0), default=-1)  # holds the text's last end
        found = fold(rows, most_overlap)
        arrays = [pa.array([r[n] for r in rows], schema.field(n).type) for n in [*names, "range_no"]]
        arrays += [pa.array([c.total for c in found], pa.int64()), pa.array([c.tokens for c in found], pa.int64()), pa.array([c.starts.astype(np.int64).tobytes() for c in found], pa.binary()), pa.array([c.end for c in found], pa.int64()), pa.array([c.breaks for c in found], pa.int64()), pa.array([c.sentence for c in found], pa.bool_()), pa.array([i == closing for i in range(len(rows))], pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, [*names, *_NAMES[CARRY]])

    return ordered.mapInArrow(run, f"{_key_schema(scanned, names)}, {CARRY}")


CUT = "strategy int, k bigint, value bigint, end_before bigint, start_from bigint, total bigint, first_token bigint, end_token bigint, char_start bigint, char_end bigint"


def cuts_of(starts: np.ndarray, ends: np.ndarray, strength: np.ndarray, tokens: int, total: int, reach: np.ndarray, closing: int, s: Strategy) -> tuple[np.ndarray, np.ndarray]:
    """Of one range the pieces that lie in it (k, first_token, end_token, char_start, char_end), and the cuts (k, value,
    end_before, start_from, whether the piece that begins and the one that ends with it are complete) of the others; closing is the text's last end or -1.

    Cut 0 is the text's beginning and the last cut its end. reach has the starts of the tokens before the range, then
    starts."""
    n, shift = len(starts), len(reach) - len(starts)
    last = -(-(total - s.overlap) // s.step) if total > s.size else 1
    k, value = candidates(tokens, total, strength, s) if total > s.size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    top = s.overlap + k * s.step
    whole = (top - max(s.slack, 1) + 1 >= tokens) & (top < tokens + n)  # windows that no other range has a part of
    token = value & _MASK
    end_before, start_from = ends[token - tokens], reach[token - tokens + shift - s.overlap]
    if tokens == 0 and n:
        k, value, whole = np.r_[0, k], np.r_[0, value], np.r_[True, whole]
        end_before, start_from, token = np.r_[-1, end_before], np.r_[starts[0], start_from], np.r_[s.overlap, token]
    if closing >= 0:
        k, value, whole = np.r_[k, last], np.r_[value, total], np.r_[whole, True]
        end_before, start_from, token = np.r_[end_before, closing], np.r_[start_from, -1], np.r_[token, total]
    on = np.flatnonzero(whole[:-1] & whole[1:] & (k[1:] == k[:-1] + 1)) if len(k) else np.zeros(0, np.int64)
    pieces = np.stack([k[on], token[on] - s.overlap, token[on + 1], start_from[on], end_before[on + 1]])
    # a cut is done with if the pieces on both sides of it are; else only its open side counts
    begun, ended = np.zeros(len(k), bool), np.zeros(len(k), bool)
    begun[on], ended[on + 1] = True, True
    left = ~((begun | (k == last)) & (ended | (k == 0)))
    return pieces, np.stack([k, value, end_before, start_from, begun.astype(np.int64), ended.astype(np.int64)])[:, left]


def pieces_in(tables: DataFrame, names: list[str], strategies: list[Strategy], only_cut: bool) -> DataFrame:
    """CUT rows of range tables that carry TABLE and CARRY: complete pieces have a null value, cuts a null first_token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cell = {n: column[n].to_pylist() for n in [*_NAMES[TABLE], *_NAMES[CARRY]]}
            rows, strategy, done, parts, totals = [], [], [], [], []
            open_rows, open_strategy, open_totals = [], [], []
            for i in range(batch.num_rows):
                total, tokens, offset = cell["total"][i], cell["tokens"][i], cell["offset"][i]
                wanted = [j for j, s in enumerate(strategies) if total > (s.size if only_cut else 0)]
                if not wanted:
                    continue
                starts = np.cumsum(np.frombuffer(cell["starts"][i], np.int32), dtype=np.int64) + offset
                gap = np.frombuffer(cell["ends"][i], np.int32)
                ends = np.where(gap >= 0, starts - gap, cell["c_end"][i])
                strength = np.frombuffer(cell["strength"][i], np.uint8).astype(np.int64)
                if cell["breaks_first"][i] >= 0 and tokens:
                    strength[0] = strengths(np.array([cell["c_breaks"][i] + cell["breaks_first"][i]]), np.array([cell["c_sentence"][i]]))[0]
                reach = np.concatenate([np.frombuffer(cell["c_starts"][i], np.int64), starts])
                closing = cell["last_end"][i] + offset if cell["closes"][i] else -1
                for j in wanted:
                    pieces, cuts = cuts_of(starts, ends, strength, tokens, total, reach, closing, strategies[j])
                    for found, numbers, kept, which, sums in ((pieces, done, rows, strategy, totals), (cuts, parts, open_rows, open_strategy, open_totals)):
                        if found.shape[1]:
                            numbers.append(found)
                            kept.append(np.full(found.shape[1], i))
                            which.append(np.full(found.shape[1], j, np.int32))
                            sums.append(np.full(found.shape[1], total))
            for numbers, kept, which, sums, whole in ((done, rows, strategy, totals, True), (parts, open_rows, open_strategy, open_totals, False)):
                if numbers:
                    x = np.concatenate(numbers, axis=1)
                    take, none = pa.array(np.concatenate(kept)), pa.nulls(x.shape[1], pa.int64())
                    own = [pa.array(v) for v in x[1:]]
                    if whole:
                        values = [none, none, none, pa.array(np.concatenate(sums)), *own]
                    else:  # a side whose piece is complete is not asked for
                        begun, ended = x[4] == 1, x[5] == 1
                        values = [own[0], pa.array(x[2], mask=ended), pa.array(x[3], mask=begun), pa.array(np.concatenate(sums)), none, none, none, none]
                    yield pa.RecordBatch.from_arrays([*(column[n].take(take) for n in names), pa.array(np.concatenate(which)), pa.array(x[0]), *values], [*names, *(f.split()[0] for f in CUT.split(", "))])

    return tables.mapInArrow(run, f"{_key_schema(tables, names)}, {CUT}")


def stitched(found: DataFrame, names: list[str], strategies: list[Strategy]) -> DataFrame:
    """names and PIECE: the complete pieces, and those made of the cuts of several ranges."""
    spark = found.sparkSession
    spec = spark.createDataFrame([(i, s.name, s.version, s.size, s.overlap, s.step) for i, s in enumerate(strategies)], "strategy int, strategy_name string, strategy_version string, size int, overlap int, step int")
    found = found.join(F.broadcast(spec), "strategy")  # at most MOST_STRATEGIES rows
    count = F.when(F.col("total") > F.col("size"), F.ceil((F.col("total") - F.col("overlap")) / F.col("step"))).otherwise(1).cast("int")
    found = found.withColumn("n_pieces", count)
    piece = ["strategy_name", "strategy_version", F.col("k").cast("int").alias("piece_no"), "n_pieces"]
    whole = found.filter("value is null").select(*names, *piece, "first_token", (F.col("end_token") - F.col("first_token")).alias("n_tokens"), "char_start", "char_end")
    place = [*names, "strategy_name", "strategy_version", "overlap", "n_pieces", "k"]
    best = found.filter("value is not null").groupBy(*place).agg(F.max(F.struct("value", "end_before", "start_from")).alias("best"))
    token = F.col("best.value").bitwiseAND(F.lit(_MASK))
    begin = F.struct(F.col("k").alias("piece"), F.when(F.col("k") == 0, 0).otherwise(token - F.col("overlap")).alias("first"), F.col("best.start_from").alias("char_start"), F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("bigint").alias("char_end"))
    end = F.struct((F.col("k") - 1).alias("piece"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("char_start"), token.alias("end"), F.col("best.end_before").alias("char_end"))
    halves = best.select(*names, "strategy_name", "strategy_version", "n_pieces", F.explode(F.filter(F.array(F.when(F.col("k") < F.col("n_pieces"), begin), F.when(F.col("k") > 0, end)), lambda h: h.isNotNull())).alias("h")).select("*", "h.*").drop("h")
    asked = halves.filter("char_start is not null or char_end is not null")
    joined = asked.groupBy(*names, "strategy_name", "strategy_version", "n_pieces", "piece").agg(*(F.max(c).alias(c) for c in ("first", "char_start", "end", "char_end")))
    made = joined.select(*names, "strategy_name", "strategy_version", F.col("piece").cast("int").alias("piece_no"), "n_pieces", F.col("first").alias("first_token"), (F.col("end") - F.col("first")).alias("n_tokens"), "char_start", "char_end")
    return whole.unionByName(made)


def _pieces(tables: DataFrame, names: list[str], strategies: list[Strategy], only_cut: bool) -> DataFrame:
    overlap = max((s.overlap for s in strategies), default=0)
    scanned = write_shared(tables)
    nothing = {"total": F.col("n_starts"), "tokens": F.lit(0).cast("bigint"), "c_starts": F.lit(b""), "c_end": F.lit(-1).cast("bigint"), "c_breaks": F.lit(0).cast("bigint"), "c_sentence": F.lit(False), "closes": F.col("last_end") >= 0}
    alone = scanned.filter("n_ranges = 1").select("*", *(c.alias(n) for n, c in nothing.items()))
    several = scanned.filter("n_ranges > 1").join(carries(scanned, names, overlap), [*names, "range_no"])
    columns = [*names, *_NAMES[TABLE], *(n for n in _NAMES[CARRY] if n != "range_no")]
    both = alone.select(*columns).unionByName(several.select(*columns))
    pieces = stitched(write_shared(pieces_in(both, names, strategies, only_cut)), names, strategies)  # read twice
    return pieces.dropDuplicates([*names, "strategy_name", "strategy_version", "piece_no"])


def split_texts(df: DataFrame, strategies: DataFrame, keys: list[str], text: str, range_chars: int = RANGE_CHARS, only_cut: bool = False) -> DataFrame:
    """keys, strategy_name, strategy_version, piece_no, n_pieces, first_token, n_tokens, char_start, char_end.

    only_cut leaves out the texts that are within a strategy's size and stay one piece."""
    known = read_strategies(strategies)
    names = [f"__k{i}" for i in range(len(keys))]
    source = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(text).cast("string").alias("__text")).filter("__text is not null")
    out = _pieces(range_tables(source, names, range_chars, max((s.overlap for s in known), default=0)), names, known, only_cut)
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *_NAMES[PIECE])


def split_files(spark: SparkSession, path: str, strategies: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path and the pieces of files by byte offset. Workers read their byte range and a halo, no file is read whole."""
    known = read_strategies(strategies)
    overlap = max((s.overlap for s in known), default=0)
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    n = F.ceil(F.col("size") / range_bytes).cast("int")
    ranges = listed.select("path", "size", n.alias("n_ranges"), F.explode(F.sequence(F.lit(0), n - 1)).alias("range_no")).repartition("path", "range_no")

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [_is_utf8(r["path"], r["size"], r["range_no"] * range_bytes, range_bytes) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine)], ["path", "fine"])

    decided = ranges.mapInArrow(valid, "path string, fine boolean").groupBy("path").agg(F.bool_and("fine").alias("utf8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                offset = r["range_no"] * range_bytes
                text, lead, core, units = _read_range(r["path"], r["size"], offset, range_bytes, r["utf8"])
                yield _tables([batch.column(0)], ["__k0"], [i], [(r["range_no"], r["n_ranges"], offset)], scan_ranges([text], [lead], [core], overlap), [units])

    tables = ranges.join(decided, "path").select("path", "size", "n_ranges", "range_no", "utf8").mapInArrow(run, f"__k0 string, {TABLE}")
    return _pieces(tables, ["__k0"], known, False).withColumnRenamed("__k0", "path")


def _raw(path: str, low: int, high: int) -> bytes:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        f.seek(low)
        return f.read(high - low)


def _is_utf8(path: str, size: int, offset: int, range_bytes: int) -> bool:
    """Whether the characters that begin in a range are whole UTF-8 ones."""
    raw = _raw(path, offset, min(size, offset + range_bytes + 3))
    begin = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), len(raw)) if offset else 0
    end = len(raw)
    if offset + range_bytes < size:  # up to the first character that begins in the next range
        end = next((i for i in range(min(range_bytes, len(raw)), len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
    try:
        raw[begin:end].decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _read_range(path: str, size: int, offset: int, range_bytes: int, utf8: bool) -> tuple[str, int, int, np.ndarray]:
    """The text of a byte range with its halos, characters of halo before it and of its own, and the byte of each position."""
    low, high = max(0, offset - 4 * HALO), min(size, offset + range_bytes + 4 * HALO)
    raw = _raw(path, low, high)
    if utf8:
        data = np.frombuffer(raw, np.uint8)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        end = len(raw)
        if high < size:  # the last character may be cut off
            end, heads = int(heads[-1]), heads[:-1]
        text, at = raw[heads[0] if len(heads) else 0 : end].decode("utf-8"), heads + low
        last = end + low
    else:
        text, at, last = raw.decode("latin-1"), np.arange(low, high), high
    lead = int(np.searchsorted(at, offset))
    core = int(np.searchsorted(at, min(size, offset + range_bytes))) - lead
    return text, lead, core, np.append(at[lead:], last) - offset


def piece_text(text: Column | str) -> Column:
    """The text of a piece, beside char_start and char_end."""
    return F.substring(text, F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
