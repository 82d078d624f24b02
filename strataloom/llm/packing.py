"""Filling containers of one fixed capacity by the sum-of-squares rule.

Each item goes where the sum over all residual gaps of the squared number of open containers with that gap becomes
smallest (a tie goes to the tighter gap); closed and empty containers do not count. An item larger than the capacity,
and no other, is first cut into pieces of the capacity and a remainder. Items are spread by a hash of their key over
groups of about `group_items`; each group is packed by one task that holds one counter per gap and the numbers of its
open containers, so neither skew nor the size of the data changes what a task holds. Room is lost only in the last few
open containers of a group.

Defined cases: an item without tokens (null or empty text) takes no room and joins the container placed last; ties and
repeated rows are items of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.byte_bpe import count_column
from strataloom.session import cut_lineage

CAPACITY = 2048
GROUP_ITEMS = 100_000
MOST_GROUPS = 20_000


class SquaresPacker:
    """Places items of 0..capacity one by one; keeps the number of open containers of each gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # by gap; gaps 0 and capacity stay 0
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made, self.last = 0, -1
        self.never = np.int64(2**62)

    def place(self, size: int) -> int:
        """The container of an item."""
        if size == 0:
            if self.last < 0:
                self._keep(self._new(), self.capacity)
            return self.last
        there = self.open[size:]
        cost = np.where(there > 0, 2 * (self.open[: self.capacity - size + 1] - there) + 2, self.never)
        cost[0] -= (there[0] > 0)  # a container that becomes full leaves the sum
        cost[-1] = 2 * self.open[self.capacity - size] + 1 if size < self.capacity else 0
        gap = int(cost.argmin()) + size
        if self.waiting[gap]:
            container = self.waiting[gap].pop()
            self.open[gap] -= gap < self.capacity
        else:
            container = self._new()
        self._keep(container, gap - size)
        return container

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _keep(self, container: int, gap: int) -> None:
        self.last = container
        if gap:
            self.waiting[gap].append(container)
            self.open[gap] += gap < self.capacity


def pack_sizes(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(key, piece_no, start, n_tokens, container_id) for items whose sizes are at hand.

    items is counted once and should be a table or a checkpoint."""
    groups = max(1, min(MOST_GROUPS, -(-items.count() // group_items)))
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    cap = F.lit(capacity).cast("bigint")
    pieces = (
        items.select(F.col(key).alias("__key"), n.alias("__n"))
        .select("__key", "__n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__n") / cap), F.lit(1)) - 1)).alias("piece_no"))
        .select("__key", F.col("piece_no").cast("int"), (F.col("piece_no") * cap).alias("start"), F.least(cap, F.col("__n") - F.col("piece_no") * cap).alias("n_tokens"))
        .withColumn("__order", F.xxhash64("__key", "piece_no"))
        .repartition(groups, "__order")
        .sortWithinPartitions("__order", "__key", "piece_no", "n_tokens")
        .drop("__order")
    )
    key_type = pieces.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = SquaresPacker(capacity), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = np.fromiter(map(packer.place, batch.column(3).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed + base)], [*batch.schema.names, "container_id"])

    schema = f"__key {key_type}, piece_no int, start bigint, n_tokens bigint, container_id bigint"
    return pieces.mapInArrow(run, schema).withColumnRenamed("__key", key)


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Measures texts in tokens of byte_bpe_50k and packs them; the sizes are written once, so texts are encoded once."""
    return pack_sizes(cut_lineage(count_column(df, key, text, path)), key, "n_tokens", capacity, group_items)
