"""The k most similar vectors of every vector: a neighbour graph by NN-descent, and greedy search on it.

1. Vectors of one group (collection and dimension) with equal bytes are one node, so copies cost nothing and make no
   hubs. Nodes are numbered in the order of their cell (nearest of centroids that are fitted to a bounded sample) and a
   sign code, so that like nodes have like numbers; the cells serve for nothing else but to place nodes. A node's home is
   its number without the lowest HOME bits.
2. The descent starts from short lists: each node meets those of a small block of its cell and of its second cell.
3. Each round of NN-descent joins neighbours of neighbours: at every node its neighbours and reverse neighbours meet and
   are compared, in random groups of `group`, where one of a pair is new to the list that brought it. A node's vector
   (one byte a component) goes once to each home where it meets others, not once to each meeting. Better pairs go back
   into the lists, which lie in a table bucketed by node, so that they are not shuffled. Rounds end when less than STOP
   of the `joined` first links of all nodes are new.
4. Exact cosines in double precision decide what is handed out.

Work grows with n * joined * group, shuffles with n. Sizes that are broadcast: centroids, at most MOST_CELLS a group and
MOST_GROUPS groups.

Defined cases: vectors that are null, of another length than their dimension, all zero or with a null, NaN or infinite
component take no part, nor do null ids, collections or dimensions; an id delivered again is one vector; equal
similarities rank by id, copies of one vector too; a group of one has no neighbours; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, ensure_checkpoint_dir, forget_at_exit, partitions_for, write_shared

KEEP, JOINED, GROUP, BLOCK = 26, 26, 96, 512
STOP, MOST_ROUNDS = 0.05, 12
HOME = 13  # bits: nodes of a home are at most 2 ** HOME
PART_NODES = 5000  # nodes of a partition while there are few
DEGREE = 48  # links of a node that a search follows, either way, the most similar ones
ENTRIES, MOST_ENTRIES = 1024, 65_536  # nodes of a group among which the starts of a search are chosen, and of all groups
CELL_NODES, MOST_CELLS, SAMPLE, MOST_GROUPS = 20_000, 1024, 16_384, 10_000
SECOND = 1 << 40  # marks places by second cell and second code
MARGIN = 0.02  # how far a one-byte cosine may be off
SAME = 1 - 1e-12  # cosines from here on are those of one direction
LISTS = "node bigint, nbrs array<bigint>, sims array<float>"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow for very large or small components
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _small(x: np.ndarray) -> np.ndarray:
    """Components of one byte each."""
    x = x.astype(np.float64)
    return np.round(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _widths(column: pa.Array, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of a binary column's values."""
    values = column.to_pylist()
    length = np.fromiter(map(len, values), np.int64, len(values))
    for w in np.unique(length):
        rows = np.flatnonzero(length == w)
        yield rows, np.frombuffer(b"".join(values[i] for i in rows), kind).reshape(len(rows), -1)


def usable_vectors(df: DataFrame) -> DataFrame:
    """(vector_id, grp, vec, small, digest) of the vectors that take part; vec holds float32 bytes."""
    source = df.select(F.col("vector_id").cast("string"), F.col("collection_name").cast("string"), F.col("dimension").cast("int"), F.col("embedding").cast("array<float>")).filter("vector_id is not null and collection_name is not null and dimension > 0 and size(embedding) = dimension")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            start = batch.column(3).offsets.to_numpy()[:-1].astype(np.int64)
            flat = batch.column(3).values
            values = flat.to_numpy(zero_copy_only=False).astype(np.float32)
            values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.float32(np.nan), values) + np.float32(0)  # no negative zeros
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = values[start[rows][:, None] + np.arange(d)]
                on = np.isfinite(x).all(axis=1) & x.any(axis=1)
                rows, x = rows[on], x[on]
                if len(rows):
                    take = pa.array(rows)
                    grp = pa.array([f"{d}|{c}" for c in batch.column(1).take(take).to_pylist()], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), grp, _rows(x), _rows(_small(x))], ["vector_id", "grp", "vec", "small"])

    return source.mapInArrow(run, "vector_id string, grp string, vec binary, small binary").withColumn("digest", F.unhex(F.md5("vec")))


def fit_cells(usable: DataFrame) -> dict[str, np.ndarray]:
    """Unit centroids of each group, by spherical k-means on at most about SAMPLE of its vectors."""
    counts = {r.grp: r["count"] for r in usable.groupBy("grp").count().limit(MOST_GROUPS + 1).collect()}
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    if not counts:
        return {}
    spark = usable.sparkSession
    share = spark.createDataFrame([(g, min(1.0, SAMPLE / n), min(MOST_CELLS, -(-n // CELL_NODES))) for g, n in counts.items()], "grp string, share double, cells int")
    chosen = usable.join(F.broadcast(share), "grp").filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:  # at most about SAMPLE rows
        rows = rows.sort_values("digest")
        x = _unit(np.frombuffer(b"".join(rows.small), np.int8).reshape(len(rows), -1))
        m = min(int(rows.cells.iloc[0]), len(x))
        c = x[np.random.default_rng(5).permutation(len(x))[:m]].copy()
        for _ in range(8 if m > 1 else 0):
            own = (x @ c.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            first = np.searchsorted(own[order], np.arange(m))
            sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]), np.float32)]), first, axis=0)
            full = np.bincount(own, minlength=m) > 0
            length = np.linalg.norm(sums, axis=1)
            c[full & (length > 0)] = (sums / np.maximum(length, 1e-30)[:, None])[full & (length > 0)]
        return pd.DataFrame({"grp": [rows.grp.iloc[0]], "cells": [m], "centroids": [c.astype(np.float32).tobytes()]})

    distinct = chosen.select("grp", "digest", "small", "cells").dropDuplicates(["grp", "digest"])
    fitted = distinct.groupBy("grp").applyInPandas(fit, "grp string, cells int, centroids binary").collect()
    cells = {r.grp: np.frombuffer(r.centroids, np.float32).reshape(r.cells, -1) for r in fitted}
    for g in counts.keys() - cells.keys():  # a group so small that the sample missed it is one cell
        cells[g] = np.zeros((1, int(g.split("|", 1)[0])), np.float32)
    return cells


def _codes(x: np.ndarray, seed: int = 11) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], 16)).astype(np.float32)
    return ((x @ planes > 0) @ (1 << np.arange(16)[::-1])).astype(np.int32)


def nodes_of(usable: DataFrame) -> DataFrame:
    """(node, grp, digest, rep, copies, small, cell, cell2, code, code2): one row for each distinct vector of a group."""
    spark = usable.sparkSession
    cells = fit_cells(usable)
    shared = spark.sparkContext.broadcast(({g: i for i, g in enumerate(sorted(cells))}, cells))
    ids = usable.select("grp", "digest", "vector_id").distinct().groupBy("grp", "digest").agg(F.min("vector_id").alias("rep"), F.count("*").alias("copies"))
    smalls = usable.groupBy("grp", "digest").agg(F.first("small").alias("small"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, cells = shared.value
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            out = np.zeros((4, len(groups)), np.int64)
            for g in sorted(set(groups.tolist())):
                rows = np.flatnonzero(groups == g)
                x = _unit(np.frombuffer(b"".join(batch.column(4).take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1))
                near = x @ cells[g].T
                best = np.argsort(-near, axis=1, kind="stable")[:, :2]
                out[0, rows], out[1, rows] = (numbers[g] << 12) | best[:, 0], (numbers[g] << 12) | best[:, -1]
                out[2, rows], out[3, rows] = _codes(x), _codes(x, 12)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, "cell", "cell2", "code", "code2"])

    schema = "grp string, digest binary, rep string, copies bigint, small binary"
    placed = ids.join(smalls, ["grp", "digest"]).select("grp", "digest", "rep", "copies", "small").mapInArrow(place, f"{schema}, cell bigint, cell2 bigint, code bigint, code2 bigint")
    placed = write_shared(placed)
    parts = partitions_for(spark, placed.count(), PART_NODES)
    ordered = placed.repartitionByRange(parts, "cell", "code").sortWithinPartitions("cell", "code", "digest")
    return write_shared(ordered.select(F.monotonically_increasing_id().alias("node"), "*"))


def _home(node: str) -> Column:
    return F.shiftright(node, HOME)


def _lists(nodes: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(nbrs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sims.astype(np.float32)))], ["node", "nbrs", "sims"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.diff(batch.column(1).offsets.to_numpy())
    return np.repeat(batch.column(0).to_numpy(), counts), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def best_of(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, nbrs, sims, counts): of each node the `keep` best distinct neighbours, best first, then by number."""
    o = np.lexsort((-sim, nbr, node))
    node, nbr, sim = node[o], nbr[o], sim[o]
    fresh = np.r_[True, (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])] & (node != nbr)
    node, nbr, sim = node[fresh], nbr[fresh], sim[fresh]
    o = np.lexsort((nbr, -sim, node))
    node, nbr, sim = node[o], nbr[o], sim[o]
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(node)))
    on = np.arange(len(node)) - np.repeat(start, size) < keep
    return node[start], nbr[on], sim[on], np.minimum(size, keep)



MET = "home bigint, node bigint, small binary, least float, places array<int>"


def meet(rows: DataFrame, parts: int, group: int, keep: int = KEEP, turn: int = 0) -> DataFrame:
    """Lists of the better pairs among the nodes that meet. rows (MET): a node with the places of a home where it meets
    others, by number within the home; a place p that it is new to is written as -1 - p. Of two nodes one has to be new."""
    ordered = rows.repartition(parts, "home").sortWithinPartitions("home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            home = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                if key != home[a]:
                    if held:
                        yield from one(held)
                    held, key = [], home[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        for rows, small in _widths(table["small"].combine_chunks(), np.int8):
            own = table.take(pa.array(rows))
            node, first, inverse = np.unique(own["node"].to_numpy(), return_index=True, return_inverse=True)
            x = small[first].astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            least = own["least"].to_numpy()[first]
            places = own["places"].combine_chunks()
            at = np.repeat(inverse, np.diff(places.offsets.to_numpy()))
            place = places.flatten().to_numpy()
            fresh = place < 0
            place = np.where(fresh, -1 - place, place)
            o = np.lexsort((~fresh, at, place))  # a node that two lists bring to a place is new if one of them is
            place, at, fresh = place[o], at[o], fresh[o]
            once = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1])]
            place, at, fresh = place[once], at[once], fresh[once]
            o = np.lexsort(((node[at] * 0x9E3779B97F4A7C1 + turn * 0x632BE5AB) >> 17, place))
            place, at, fresh = place[o], at[o], fresh[o]
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            size = np.diff(np.append(start, len(place)))
            count = -(-size // group)  # groups of a place, of even size
            fresh = fresh | (count > 1).repeat(size)  # other groups each round, so old pairs may not have met
            number = np.concatenate([[0], np.cumsum(count)])[:-1].repeat(size) + (np.arange(len(place)) - start.repeat(size)) * count.repeat(size) // size.repeat(size)
            start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            size = np.diff(np.append(start, len(number)))
            found: list[tuple] = []
            some = np.logical_or.reduceat(fresh, start) & (size > 1)
            start, size = start[some], size[some]
            order = np.argsort(size, kind="stable")
            i = 0
            while i < len(order):
                step = max(1, 1_000_000 // int(size[order[min(i + 2000, len(order) - 1)]]) ** 2)
                chosen = order[i : i + step]
                i += step
                found.append(compare(start[chosen], size[chosen], at, fresh, x, least))
            if found:
                a, b, sim = (np.concatenate(f) for f in zip(*found))
                if len(a):
                    yield _lists(*best_of(node[a], node[b], sim, keep))

    def compare(start: np.ndarray, size: np.ndarray, at: np.ndarray, fresh: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple:
        most = int(size.max())
        where = np.minimum(start[:, None] + np.arange(most), len(at) - 1)
        real = np.arange(most) < size[:, None]
        member = at[where]
        full = x[member]
        s = full @ full.transpose(0, 2, 1)
        new = fresh[where] & real
        good = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (s > least[member][:, :, None])
        good[:, np.arange(most), np.arange(most)] = False
        if most > keep + 1:  # the best of each row are enough
            s = np.where(good, s, -9)
            top = np.argpartition(-s, keep, axis=2)[:, :, :keep]
            g, i, j = np.nonzero(np.take_along_axis(s, top, axis=2) > -9)
            j = top[g, i, j]
        else:
            g, i, j = np.nonzero(good)
        return member[g, i], member[g, j], s[g, i, j]

    return ordered.mapInArrow(run, LISTS)


GRAPH = "node bigint, small binary, nbrs array<bigint>, sims array<float>, fresh array<boolean>"


def _bucketed(df: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, bucketed by node, so that joins on node do not shuffle it; and its path."""
    spark = df.sparkSession
    name = f"graph_{uuid.uuid4().hex}"
    path = forget_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/{name}")
    df.write.format("parquet").option("compression", "zstd").bucketBy(parts, "node").sortBy("node").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved; the catalog's entry is no longer needed, the files stay
    spark.sql(f"DROP TABLE {name}")
    return table, path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merged(graph: DataFrame, lists: DataFrame, parts: int, keep: int = KEEP) -> tuple[DataFrame, str]:
    """The graph with better links out of lists, and its path; fresh marks links that it did not have."""
    joined = graph.select("node", "small", "nbrs", "sims").join(lists.select("node", F.col("nbrs").alias("u_nbrs"), F.col("sims").alias("u_sims")), "node", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            node = table["node"].to_numpy()
            cut = int(np.flatnonzero(node == node[-1])[0]) if node[-1] != node[0] else 0  # rows of the last node may go on
            if cut:
                yield one(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks().to_batches()[0]
        if rest is not None:
            yield one(pa.Table.from_batches([rest]))

    def one(table: pa.Table) -> pa.RecordBatch:
        node = table["node"].to_numpy()
        ids, first = np.unique(node, return_index=True)
        parts = []
        for old, (nbrs, sims) in ((True, ("nbrs", "sims")), (False, ("u_nbrs", "u_sims"))):
            own = table.take(pa.array(first)) if old else table
            lists = own[nbrs].combine_chunks()
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            at = np.repeat(own["node"].to_numpy(), counts)
            parts.append((at, lists.flatten().to_numpy(), own[sims].combine_chunks().flatten().to_numpy(), np.full(len(at), old)))
        a, b, sim, old = (np.concatenate(p) for p in zip(*parts))
        o = np.lexsort((-sim, ~old, b, a))
        a, b, sim, old = a[o], b[o], sim[o], old[o]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b, sim, old = a[once], b[once], sim[once], old[once]
        o = np.lexsort((b, -sim, a))
        a, b, sim, old = a[o], b[o], sim[o], old[o]
        start = np.searchsorted(a, ids)
        size = np.diff(np.append(start, len(a)))
        on = np.arange(len(a)) - np.repeat(start, size) < keep
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(size, keep))]).astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, pa.array(v[on])) for v in (b, sim.astype(np.float32), ~old)]
        return pa.RecordBatch.from_arrays([pa.array(ids), table["small"].combine_chunks().take(pa.array(first)), *columns], [f.split()[0] for f in GRAPH.split(", ")])

    return _bucketed(joined.mapInArrow(run, GRAPH), parts)


def first_lists(nodes: DataFrame, parts: int, keep: int = KEEP, block: int = BLOCK) -> DataFrame:
    """LISTS out of small blocks: each node meets the nodes of a stretch of its cell, and of one of its second cell."""
    spark = nodes.sparkSession
    sizes = [(r.cell, max(0, int(np.ceil(np.log2(max(1, r["count"] / block)))))) for r in nodes.groupBy("cell").count().collect()]  # at most MOST_CELLS a group
    sizes += [(c + SECOND, b) for c, b in sizes]
    bits = F.broadcast(spark.createDataFrame(sizes, "cell bigint, bits int")) if sizes else spark.createDataFrame([], "cell bigint, bits int")
    both = nodes.select("cell", "code", "node", "small").unionByName(nodes.select((F.col("cell2") + SECOND).alias("cell"), F.col("code2").alias("code"), "node", "small"))
    both = both.join(bits, "cell", "left").withColumn("piece", F.expr("shiftright(code, 16 - least(16, coalesce(bits, 0)))"))
    place = F.col("cell") * (1 << 17) + F.col("piece")
    return meet(both.select(place.alias("home"), "node", "small", F.lit(-2.0).cast("float").alias("least"), F.array(F.lit(-1)).alias("places")), parts, 2 * block, keep)


def descend(graph: DataFrame, parts: int, keep: int = KEEP, joined: int = JOINED, group: int = GROUP, turn: int = 0) -> DataFrame:
    """One round of NN-descent: LISTS of the better pairs among neighbours of neighbours."""
    # each node learns the homes of the nodes whose neighbour it is; those of its neighbours it knows
    edges = graph.select("node", F.posexplode(F.slice("nbrs", 1, joined)).alias("i", "nbr"), "fresh")
    inward = edges.select(F.col("nbr").alias("node"), F.when(F.element_at("fresh", F.col("i") + 1), -1 - F.col("node")).otherwise(F.col("node")).alias("of")).repartition(parts, "node")
    whose = F.when(F.col("of") < 0, -1 - F.col("of")).otherwise(F.col("of"))
    place = whose.bitwiseAND((1 << HOME) - 1).cast("int")
    told = inward.select("node", F.shiftright(whose, HOME).alias("home"), F.when(F.col("of") < 0, -1 - place).otherwise(place).alias("place"))
    there = told.groupBy("node", "home").agg(F.collect_list("place").alias("places"))  # at most the nodes of a home
    least = F.when(F.size("sims") >= keep, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float")
    own = graph.select("node", "small", least.alias("least"), F.slice("nbrs", 1, joined).alias("nbrs"), F.slice("fresh", 1, joined).alias("fresh"))
    both = own.join(there, "node", "left").select("node", "small", "least", "nbrs", "fresh", "home", "places")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            ids, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            take = pa.array(first)
            lists, fresh = batch.column(3).take(take), batch.column(4).take(take)
            out = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            nbr = lists.flatten().to_numpy()
            sign = fresh.flatten().to_numpy(zero_copy_only=False)
            local = nbr & ((1 << HOME) - 1)
            told = np.nan_to_num(batch.column(6).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            home = np.repeat(batch.column(5).fill_null(0).to_numpy(), told)
            at = np.concatenate([out, np.repeat(inverse, told)])
            home = np.concatenate([nbr >> HOME, home])
            place = np.concatenate([np.where(sign, -1 - local, local), batch.column(6).flatten().to_numpy()]).astype(np.int32)
            o = np.lexsort((home, at))
            at, home, place = at[o], home[o], place[o]
            begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (home[1:] != home[:-1])]) if len(at) else np.zeros(0, np.int64)
            row = pa.array(first[at[begin]])
            offsets = pa.array(np.append(begin, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(home[begin]), pa.array(ids[at[begin]]), batch.column(1).take(row), batch.column(2).take(row), pa.ListArray.from_arrays(offsets, pa.array(place))], ["home", "node", "small", "least", "places"])

    rows = both.mapInArrow(spread, MET)
    return meet(rows, parts, group, keep, turn)


def neighbour_graph(nodes: DataFrame, keep: int = KEEP, rounds: int = MOST_ROUNDS, block: int = BLOCK, joined: int = JOINED) -> DataFrame:
    """GRAPH: the links of every node, best first. Rounds of descent end at STOP, or after `rounds`."""
    n, spark = nodes.count(), nodes.sparkSession
    parts = partitions_for(spark, n, PART_NODES)
    empty = nodes.select("node", "small", F.array().cast("array<bigint>").alias("nbrs"), F.array().cast("array<float>").alias("sims"), F.array().cast("array<boolean>").alias("fresh"))
    graph, path = merged(empty, first_lists(nodes, parts, keep, block), parts, keep)
    for turn in range(rounds):
        before = path
        graph, path = merged(graph, descend(graph, parts, keep, joined, turn=turn), parts, keep)
        _delete(spark, before)
        gc.collect()
        spark._jvm.System.gc()  # lets Spark delete the shuffle files of the round, which nothing refers to any more
        new = graph.agg(F.sum(F.size(F.filter(F.slice("fresh", 1, joined), lambda f: f)))).first()[0] or 0
        if new < STOP * n * joined:
            break
    return graph


def exact_pairs(edges: DataFrame, nodes: DataFrame, usable: DataFrame) -> DataFrame:
    """(a, b, cosine) of edges (a, b) in double precision. A node's vector goes once to each home of nodes that it is linked from."""
    edges = cut_lineage(edges.select("a", "b"))
    parts = partitions_for(edges.sparkSession, edges.count(), 16 * PART_NODES)
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    known = nodes.select("node", "grp", "digest").join(ends, "node")
    vecs = usable.select("grp", "digest", "vec").join(known, ["grp", "digest"]).groupBy("node").agg(F.first("vec").alias("vec"))
    there = edges.groupBy(F.col("b").alias("node"), _home("a").alias("home")).agg(F.collect_list("a").alias("places"))
    own = edges.select(F.col("a").alias("node")).distinct().select("node", _home("node").alias("home"), F.array().cast("array<bigint>").alias("places"))
    rows = there.unionByName(own).join(vecs, "node").select("home", "node", "vec", "places")
    ordered = rows.repartition(parts, "home").sortWithinPartitions("home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            home = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if key != home[a]:
                    if held:
                        yield from one(held)
                    held, key = [], home[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        for rows, vec in _widths(table["vec"].combine_chunks(), np.float32):
            own = table.take(pa.array(rows))
            node, first = np.unique(own["node"].to_numpy(), return_index=True)
            x = vec[first].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            length = np.sqrt((x * x).sum(axis=1))
            places = own["places"].combine_chunks()
            b = np.repeat(own["node"].to_numpy(), np.diff(places.offsets.to_numpy()))
            a = places.flatten().to_numpy()
            i, j = np.searchsorted(node, a), np.searchsorted(node, b)
            for begin in range(0, len(a), 100_000):
                p, q = i[begin : begin + 100_000], j[begin : begin + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(a[begin : begin + 100_000]), pa.array(b[begin : begin + 100_000]), pa.array((x[p] * x[q]).sum(axis=1) / (length[p] * length[q]))], ["a", "b", "cosine"])

    return ordered.mapInArrow(run, "a bigint, b bigint, cosine double")


def ranked(usable: DataFrame, nodes: DataFrame, graph: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """(vector_id, neighbour_id, cosine, rank): the k most similar of every vector, copies included, of at least `least`."""
    edges = graph.select(F.col("node").alias("a"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("a", F.col("e.nbrs").alias("b"), F.col("e.sims").alias("sim"))
    if least is not None:
        edges = edges.filter(F.col("sim") >= least - MARGIN)
    exact = exact_pairs(edges, nodes, usable)
    if least is not None:
        exact = exact.filter(F.col("cosine") >= least)
    info = nodes.select("node", "rep", "copies")
    lists = exact.join(info.withColumnsRenamed({"node": "a", "rep": "rep_a", "copies": "size_a"}), "a").join(info.withColumnsRenamed({"node": "b", "rep": "rep_b", "copies": "size_b"}), "b")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"))  # at most `keep` rows a node
    upto = F.sum("size_b").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("size_b").over(Window.partitionBy("a", "cosine"))
    lists = lists.withColumn("before", F.when(F.col("cosine") < SAME, F.col("size_a") - 1).otherwise(0) + upto).filter(F.col("before") < k)
    # copies: the first k + 1 of a vector stand for all where its copies are asked for
    several = nodes.filter("copies > 1").select("node", "grp", "digest")
    ids = cut_lineage(usable.select("grp", "digest", "vector_id").join(several, ["grp", "digest"]).select("node", "vector_id").distinct())
    place = F.row_number().over(Window.partitionBy("node").orderBy("vector_id"))  # limited before the shuffle, so many copies are no large group
    heads = ids.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list("vector_id")).alias("some"))
    heads = cut_lineage(heads)
    copies = ids.join(heads, "node").select("vector_id", F.explode("some").alias("neighbour_id"), F.lit(1.0).alias("cosine")).filter("vector_id <> neighbour_id")
    # between vectors: each copy on the one side, on the other the first k
    right = lists.join(heads.withColumnRenamed("node", "b"), "b", "left")
    other = F.when(F.col("size_b") == 1, F.array("rep_b")).otherwise(F.slice("some", 1, k))
    right = right.select("a", "rep_a", "size_a", "cosine", F.explode(other).alias("neighbour_id"))
    single = right.filter("size_a = 1").select(F.col("rep_a").alias("vector_id"), "neighbour_id", "cosine")
    multi = right.filter("size_a > 1").join(ids.select(F.col("node").alias("a"), "vector_id"), "a").select("vector_id", "neighbour_id", "cosine")
    rows = single.unionByName(multi).unionByName(copies)
    rank = F.row_number().over(Window.partitionBy("vector_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def greedy_search(graph: DataFrame, nodes: DataFrame, usable: DataFrame, queries: DataFrame, k: int = 10, beam: int = 48, starts: int = 48, most_rounds: int = 12) -> DataFrame:
    """(query, node, cosine, rank): for each row (query, grp, small, vec) the best nodes that a greedy walk over the graph meets.

    All queries walk together: each round joins the open nodes of the beams with the graph, looks at the vectors of
    their neighbours and keeps the `beam` best, until no beam changes or for most_rounds. A walk starts
    at the `starts` most similar of up to ENTRIES nodes that are spread over its group by hash, so it begins in the right
    part of a large group too."""
    spread = F.row_number().over(Window.partitionBy("grp", "shard").orderBy("h"))
    hashed = nodes.select("node", "grp", F.xxhash64("digest").alias("h")).withColumn("shard", F.pmod("h", F.lit(256)))
    groups = nodes.select("grp").distinct().count()
    most = max(starts, min(ENTRIES, MOST_ENTRIES // max(1, groups)))
    entry = hashed.withColumn("r", spread).filter(F.col("r") <= most)
    entry = entry.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("r", "h"))).filter(F.col("r") <= most).select("node")  # 256 * most a group at most
    held: dict[str, list] = {}
    for r in nodes.select("node", "grp", "small").join(entry, "node").collect():  # MOST_ENTRIES in all, or `starts` a group
        held.setdefault(r.grp, []).append((r.node, bytes(r.small)))
    entries = {g: (np.array([n for n, _ in rows], np.int64), _unit(np.frombuffer(b"".join(v for _, v in rows), np.int8).reshape(len(rows), -1))) for g, rows in ((g, sorted(rows)) for g, rows in held.items())}
    shared = nodes.sparkSession.sparkContext.broadcast(entries)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), object)
            for g in sorted(set(groups.tolist()) & shared.value.keys()):
                ids, x = shared.value[g]
                rows = np.flatnonzero(groups == g)
                for part in np.split(rows, range(1024, len(rows), 1024)):
                    take = pa.array(part)
                    near = np.argsort(-(_unit(np.frombuffer(b"".join(batch.column(2).take(take).to_pylist()), np.int8).reshape(len(part), -1)) @ x.T), axis=1, kind="stable")[:, :starts]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(part, near.shape[1]))), pa.array(ids[near.ravel()])], ["query", "node"])

    asked = cut_lineage(queries.select("query", "grp", F.col("small").alias("qv")))
    edges = graph.select(F.col("node").alias("u"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("u", F.col("e.nbrs").alias("v"), F.col("e.sims").alias("sim"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).distinct()
    nearest = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))  # limited before the shuffle, so a hub is no large group
    links = cut_lineage(both.withColumn("r", nearest).filter(F.col("r") <= DEGREE).groupBy("u").agg(F.collect_list("v").alias("links")))
    found = asked.mapInArrow(begin, f"query {asked.schema['query'].dataType.simpleString()}, node bigint")
    beams = None
    for _ in range(most_rounds):
        new = found if beams is None else found.join(beams.select("query", "node"), ["query", "node"], "left_anti")
        pairs = new.join(asked.select("query", "qv"), "query").join(graph.select("node", "small"), "node").select("query", "node", "qv", "small")
        scored = _cosines(pairs).withColumn("open", F.lit(True))
        pool = scored if beams is None else beams.unionByName(scored)
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "node"))
        beams = cut_lineage(pool.withColumn("rank", best).filter(F.col("rank") <= beam).drop("rank"))
        front = beams.filter("open")
        if front.isEmpty():
            break
        found = front.join(links, front.node == links.u).select("query", F.explode("links").alias("node")).distinct()
        beams = beams.withColumn("open", F.lit(False))
    # exact cosines of the best by one-byte ones
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "node"))
    best = cut_lineage(beams.withColumn("place", place).filter(F.col("place") <= 2 * k).select("query", "node"))
    met = nodes.select("node", "grp", "digest").join(best.select("node").distinct(), "node")
    vecs = usable.select("grp", "digest", "vec").join(met, ["grp", "digest"]).groupBy("node").agg(F.first("vec").alias("vec"))
    exact = _cosines(best.join(queries.select("query", "vec").withColumnRenamed("vec", "qv"), "query").join(vecs, "node").select("query", "node", "qv", "vec"), np.float32)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "node"))
    return exact.withColumn("rank", order).filter(F.col("rank") <= k).select("query", "node", "cosine", "rank")


def searched(usable: DataFrame, nodes: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """(query, vector_id, cosine, rank): of k + 1 nodes for each query the k best vectors, copies included, without the
    query's own id."""
    met = nodes.join(hits.select("node").distinct(), "node").select("node", "grp", "digest")
    ids = usable.select("grp", "digest", "vector_id").join(met, ["grp", "digest"]).select("node", "vector_id").distinct()
    place = F.row_number().over(Window.partitionBy("node").orderBy("vector_id"))  # limited before the shuffle, so many copies are no large group
    some = ids.withColumn("place", place).filter(F.col("place") <= k + 1).select("node", "vector_id")
    others = hits.select("query", "node", "cosine").join(some, "node").filter(F.col("vector_id") != F.col("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vector_id"))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "vector_id", "cosine", "rank")


def _cosines(pairs: DataFrame, kind=np.int8) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            q, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            width = np.fromiter(map(len, v), np.int64, len(v))
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                x, y = (_unit(np.frombuffer(b"".join(z[i] for i in rows), kind).reshape(len(rows), -1)) for z in (q, v))
                out[rows] = (x.astype(np.float64) * y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["query", "node", "cosine"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields[:2])
    return pairs.mapInArrow(run, head + ", cosine double")
