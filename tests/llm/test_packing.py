import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.packing import SquaresPacker, pack_sizes, pack_texts


def by_trying_all(sizes, capacity):
    """The rule from its definition: try each gap, compute the whole sum anew."""
    counts, out = {}, []
    for s in sizes:
        best = None
        for gap in sorted(counts) + [capacity]:
            if gap < s or (gap != capacity and not counts.get(gap)):
                continue
            now = dict(counts)
            if gap != capacity:
                now[gap] -= 1
            if 0 < gap - s < capacity:
                now[gap - s] = now.get(gap - s, 0) + 1
            cost = sum(v * v for v in now.values())
            if best is None or cost < best[0]:
                best = (cost, gap, now)
        counts = best[2]
        out.append(best[1])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_places_by_the_smallest_sum_of_squares(sizes):
    packer, fill, gaps = SquaresPacker(12), {}, []
    for s in sizes:
        c = packer.place(s)
        gaps.append(12 - fill.get(c, 0))
        fill[c] = fill.get(c, 0) + s
    assert gaps == by_trying_all(sizes, 12)
    assert all(v <= 12 for v in fill.values())


def test_little_room_is_lost():
    sizes = np.random.default_rng(1).integers(1, 900, 20000)
    packer, fill = SquaresPacker(2048), {}
    for s in sizes.tolist():
        c = packer.place(s)
        fill[c] = fill.get(c, 0) + s
    assert max(fill.values()) <= 2048 and sum(fill.values()) / (2048 * len(fill)) > 0.985


def test_splits_only_what_is_too_large(spark):
    df = spark.createDataFrame([(1, 2500), (2, 2048), (3, 0), (4, None), (5, 10), (5, 10)], "k long, n long")
    rows = pack_sizes(df, "k", "n").collect()
    assert sorted((r.k, r.piece_no, r.start, r.n_tokens) for r in rows) == [
        (1, 0, 0, 2048), (1, 1, 2048, 452), (2, 0, 0, 2048), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 10), (5, 0, 0, 10)]
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 2048 and len(fill) == 3
    assert pack_sizes(df.limit(0), "k", "n").count() == 0


def test_texts_and_several_groups(spark):
    df = spark.createDataFrame([(i, "word " * (i % 40), "x") for i in range(400)], "doc_id long, text string, n_tokens string")
    rows = pack_texts(df, "doc_id", "text", capacity=64, group_items=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 64
