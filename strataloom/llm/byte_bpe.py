"""Byte-level BPE encoding of whole text columns in padded numpy matrices.

A batch's texts are split by the vocabulary's pattern; each distinct piece is encoded once per worker. Pieces wait in
matrices bucketed by length, one row a piece, padded with -1. In every round all rows merge their leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table held in numpy arrays, and finished rows are compacted
away. Only the two pairs beside a merge are looked up again. Rows wider than WIDE merge all occurrences of their
minimum pair in one round, which gives the same ids (a pair that holds the new token always ranks later) and keeps the
rounds of a giant piece few.

Defined cases: null and empty texts give an empty list of ids; any other text, however long, is encoded whole; repeated
rows each give their ids; an empty table gives no rows; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern published with the vocabulary, and the same for text that is all ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("STRATALOOM_TOKENIZERS", "/opt/tokenizers")

NO_RANK = np.int32(2**31 - 1)
WIDE = 256
CELLS = 2_000_000  # cells of one matrix
CACHED_PIECES, CACHED_IDS = 300_000, 5_000_000  # distinct pieces, and ids of them, that a worker keeps
SPAN = 1_000_000  # characters whose pieces are held at once
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _byte_letters() -> dict[str, int]:
    """The vocabulary files write bytes as letters: printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        letters[chr(256 + i)] = b
    return letters


@dataclass(frozen=True)
class PairTable:
    """Ids of the 256 bytes and a hash table from a pair of ids to its rank and the id it becomes."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    shift: int

    @classmethod
    def of(cls, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> PairTable:
        bits = max(4, int(len(left) * 4).bit_length())
        size, shift = 1 << bits, 64 - bits
        keys, ranks, ids = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32), np.full(size, -1, np.int32)
        pair = (left.astype(np.int64) << 32) | right
        slots = ((pair.astype(np.uint64) * _GOLDEN) >> np.uint64(shift)).astype(np.int64)
        for rank, (key, slot) in enumerate(zip(pair.tolist(), slots.tolist())):
            while keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            keys[slot], ranks[slot], ids[slot] = key, rank, merged[rank]
        return cls(byte_ids.astype(np.int32), keys, ranks, ids, shift)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot of each pair, or -1; a negative id is padding and has none."""
        found = np.full(left.shape, -1, np.int64)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left.ravel()[ask].astype(np.int64) << 32) | right.ravel()[ask]
        slot = ((key.astype(np.uint64) * _GOLDEN) >> np.uint64(self.shift)).astype(np.int64)
        flat = found.ravel()
        while len(ask):
            there = self.keys[slot]
            hit = there == key
            flat[ask[hit]] = slot[hit]
            on = ~hit & (there >= 0)
            ask, key, slot = ask[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)

    def rank_of(self, slot: np.ndarray) -> np.ndarray:
        return np.where(slot >= 0, self.ranks[slot], NO_RANK)


def load_pairs(path: str) -> PairTable:
    """The merges of a byte-level vocabulary file in the tokenizers library's JSON form."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    byte_ids = np.zeros(256, np.int32)
    for letter, byte in _byte_letters().items():
        byte_ids[byte] = vocab[letter]
    left = np.array([vocab[a] for a, _ in merges], np.int32)
    right = np.array([vocab[b] for _, b in merges], np.int32)
    merged = np.array([vocab[a + b] for a, b in merges], np.int32)
    made = np.full(len(vocab) + 1, -1, np.int64)  # the merge that makes a token, -1 for bytes
    made[merged[::-1]] = np.arange(len(merged))[::-1]
    if (np.maximum(made[left], made[right]) >= np.arange(len(merged))).any():
        raise ValueError(f"{path}: a merge comes before one that makes its parts, so wide rows may not be merged at once")
    return PairTable.of(byte_ids, left, right, merged)


def merge_matrix(rows: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Merges every row of a padded id matrix to its end; the ids of each row without padding."""
    done: list[np.ndarray | None] = [None] * len(rows)
    where = np.arange(len(rows))
    slots = table.find(rows[:, :-1], rows[:, 1:])
    ranks = table.rank_of(slots)
    while len(rows):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        line = np.arange(len(rows))
        open_ = ranks[line, at] < NO_RANK if ranks.shape[1] else np.zeros(len(rows), bool)
        if not open_.all():
            for i in np.flatnonzero(~open_):
                done[where[i]] = rows[i][rows[i] >= 0]
            rows, slots, ranks, where, at = rows[open_], slots[open_], ranks[open_], where[open_], at[open_]
            if not len(rows):
                break
            longest = int((rows >= 0).sum(axis=1).max())
            rows, slots, ranks = rows[:, :longest], slots[:, : longest - 1], ranks[:, : longest - 1]
            line = np.arange(len(rows))
        width = rows.shape[1]
        new = table.merged[slots[line, at]]
        ids = np.full((len(rows), width), -1, rows.dtype)
        take = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None])
        ids[:, :-1] = np.take_along_axis(rows, take, axis=1)
        ids[line, at] = new
        pair_take = np.minimum(np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None]), width - 2)
        slots = np.take_along_axis(slots, pair_take, axis=1)
        slots[:, -1] = -1
        before = np.maximum(at - 1, 0)
        slots[line, at] = table.find(ids[line, at], ids[line, at + 1])
        has = at > 0
        slots[line[has], before[has]] = table.find(ids[line[has], before[has]], ids[line[has], at[has]])
        rows, ranks = ids, table.rank_of(slots)
    return done  # type: ignore[return-value]


def merge_wide(row: np.ndarray, table: PairTable) -> np.ndarray:
    """One long piece: each round merges every non-overlapping occurrence of its minimum pair, from the left."""
    while len(row) > 1:
        slots = table.find(row[:-1], row[1:])
        ranks = table.rank_of(slots)
        least = ranks.min()
        if least == NO_RANK:
            break
        at = np.flatnonzero(ranks == least)
        start = np.r_[True, np.diff(at) > 1]  # runs of overlapping occurrences take every second one
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        row = row.copy()
        row[at] = table.merged[slots[at[0]]]
        keep = np.ones(len(row), bool)
        keep[at + 1] = False
        row = row[keep]
    return row


class Encoder:
    """Encodes texts with one table; keeps the ids of the pieces it has seen."""

    def __init__(self, table: PairTable):
        self.table = table
        self.any_text = regex.compile(PATTERN)
        self.ascii_text = re.compile(ASCII_PATTERN, re.A)
        self._forget()

    def _forget(self) -> None:
        outer = self
        outer.fresh: list[str] = []

        class Numbers(dict):
            def __missing__(self, piece: str) -> int:
                number = self[piece] = len(self)
                outer.fresh.append(piece)
                return number

        self.numbers = Numbers()
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not self.fresh:
            return
        raw = [p.encode("utf-8") for p in self.fresh]
        self.fresh.clear()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        for i in np.flatnonzero(sizes > WIDE):
            out[i] = merge_wide(self.table.byte_ids[np.frombuffer(raw[i], np.uint8)], self.table)
        width = 2
        low = 0
        while low < WIDE:
            bucket = np.flatnonzero((sizes > low) & (sizes <= width))
            step = max(1, CELLS // width)
            for begin in range(0, len(bucket), step):
                own = bucket[begin : begin + step]
                flat = self.table.byte_ids[np.frombuffer(b"".join(raw[i] for i in own), np.uint8)]
                matrix = np.full((len(own), width), -1, np.int32)
                matrix[np.arange(width)[None, :] < sizes[own][:, None]] = flat
                for i, ids in zip(own, merge_matrix(matrix, self.table)):
                    out[i] = ids
            low, width = width, width * 2
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        begin = len(self.flat)
        self.flat = np.concatenate([self.flat, *out])
        self.starts = np.concatenate([self.starts, begin + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])

    def _pieces(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of a text's pieces, SPAN pieces at most at a time."""
        pattern = self.ascii_text if text.isascii() else self.any_text
        if len(text) <= SPAN:
            found = pattern.findall(text)
            yield np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
            return
        pieces = (m.group() for m in pattern.finditer(text))
        while len(part := list(islice(pieces, SPAN // 4))):
            yield np.fromiter(map(self.numbers.__getitem__, part), np.int64, len(part))

    def batches(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of ids of each text, all ids) over consecutive texts."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SPAN):
                size += len(texts[end] or "")
                end += 1
            if len(self.numbers) > CACHED_PIECES or len(self.flat) > CACHED_IDS:
                self._forget()
            parts, counts = [], np.zeros(end - at, np.int64)
            for i in range(at, end):
                if texts[i]:
                    for part in self._pieces(texts[i]):
                        parts.append(part)
                        counts[i - at] += len(part)
            self._learn()
            numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            lengths = self.lengths[numbers]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(total)]
            owner = np.repeat(np.arange(end - at), counts)
            yield np.bincount(owner, lengths, end - at).astype(np.int64), ids
            at = end


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The worker's one encoder for a broadcast table."""
    digest, *parts = shared.value
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoder(PairTable(*parts))
    return _ENCODERS[digest]


def share_pairs(df: DataFrame, path: str | None):
    """Broadcasts the pair table, whose size is that of the vocabulary file and never grows with the data."""
    t = load_pairs(path or f"{TOKENIZERS}/byte_bpe_50k.json")
    digest = hashlib.sha256(t.keys.tobytes() + t.merged.tobytes() + t.byte_ids.tobytes()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, t.byte_ids, t.keys, t.ranks, t.merged, t.shift))


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) for every row: the ids of its text, without special tokens. One narrow stage, no shuffle."""
    shared = share_pairs(df, path)
    source = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    key_type = source.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            at = 0
            for counts, ids in encoder.batches(batch.column(1).to_pylist()):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), lists], ["__key", "ids"])
                at += len(counts)

    return source.mapInArrow(run, f"__key {key_type}, ids array<int>").withColumnRenamed("__key", key)


def count_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) for every row, by the same encoder without keeping ids."""
    shared = share_pairs(df, path)
    source = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    key_type = source.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            counts = [c for c, _ in encoder.batches(batch.column(1).to_pylist())]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], ["__key", "n_tokens"])

    return source.mapInArrow(run, f"__key {key_type}, n_tokens bigint").withColumnRenamed("__key", key)
