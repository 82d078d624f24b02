import numpy as np
import pytest

from strataloom.llm import neighbours as N
from strataloom.llm.neighbours_queries import p3_search

SCHEMA = "vector_id string, collection_name string, dimension int, embedding array<float>, node string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def clustered(n=1500, d=24, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((12, d))
    x = c[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * 0.7
    x[: n // 10] = x[n // 2 : n // 2 + n // 10] + rng.standard_normal((n // 10, d)) * 0.02
    return x.astype(np.float32)


def all_cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


def parts(df, **kw):
    usable = N.usable_vectors(df)
    nodes = N.nodes_of(usable)
    return usable, nodes, N.neighbour_graph(nodes, **kw)


def test_recall_against_brute_force(spark):
    x = clustered()
    rows = [(f"v{i:05d}", "one" if i % 3 else "two", 24, v.tolist()) for i, v in enumerate(x)]
    got = {}
    result = N.ranked(*parts(frame(spark, rows)), k=10)
    for r in result.collect():
        got.setdefault(r.vector_id, {})[r.neighbour_id] = (r.cosine, r.rank)
    hit = total = 0
    for which in (0, 1):
        own = np.array([i for i in range(len(x)) if (i % 3 > 0) == bool(which)])
        s = all_cosines(x[own])
        for i in range(len(own)):
            best = np.argsort(-s[i])[:10]
            mine = got[f"v{own[i]:05d}"]
            assert len(mine) == 10 and sorted(r for _, r in mine.values()) == list(range(1, 11))
            hit += sum(f"v{own[j]:05d}" in mine for j in best)
            total += 10
            for j, (c, _) in mine.items():
                assert abs(c - s[i, np.searchsorted(own, int(j[1:]))]) < 1e-9
    assert hit / total >= 0.9


def test_descent_finds_what_the_first_lists_miss(spark):
    """With the shipped parameters."""
    n = 9000
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((30, 32))[rng.integers(0, 30, n)] + rng.standard_normal((n, 32))).astype(np.float32)
    usable = N.usable_vectors(frame(spark, [(f"v{i:05d}", "c", 32, v.tolist()) for i, v in enumerate(x)])).cache()
    nodes = N.nodes_of(usable)
    number = {r.rep: r.node for r in nodes.select("rep", "node").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, n, 30)
    best = {number[f"v{i:05d}"]: {number[f"v{j:05d}"] for j in np.argsort(-(u @ u[i]))[:11] if j != i} for i in asked}

    def recall(**kw):
        lists = {r.node: set(r.nbrs[:10]) for r in N.neighbour_graph(nodes, **kw).select("node", "nbrs").collect()}
        return np.mean([len(best[a] & lists[a]) / 10 for a in best])

    before, after = recall(rounds=0), recall()
    assert after >= 0.9 and after > before + 0.05


def test_bad_vectors_copies_and_single(spark):
    nan = float("nan")
    rows = [("a1", "c", 2, [1.0, 0.0]), ("a1", "c", 2, [1.0, 0.0]), ("a2", "c", 2, [1.0, 0.0]), ("a3", "c", 2, [2.0, 0.0]), ("b1", "c", 2, [1.0, 0.1]), ("z0", "c", 2, [0.0, 0.0]), ("z1", "c", 2, [nan, 1.0]),
            ("z2", "c", 2, None), ("z3", "c", 3, [1.0, 0.0]), ("z4", "c", 2, [None, 1.0]), (None, "c", 2, [1.0, 0.0]), ("z5", None, 2, [1.0, 0.0]), ("s1", "alone", 2, [1.0, 0.0]), ("t1", "c", 3, [1.0, 0.0, 0.0])]
    got = {(r.vector_id, r.neighbour_id): (round(r.cosine, 6), r.rank) for r in N.ranked(*parts(frame(spark, rows)), k=10).collect()}
    assert {v for v, _ in got} == {"a1", "a2", "a3", "b1"} and len(got) == 12
    assert got["a1", "a2"] == (1.0, 1) and got["b1", "a1"][1] == 1 and got["a1", "b1"] == (round(1 / np.sqrt(1.01), 6), 3)
    assert N.ranked(*parts(frame(spark, [])), k=10).count() == 0


def test_many_copies_stay_linear(spark):
    rows = [(f"a{i:04d}", "c", 2, [1.0, 0.0]) for i in range(400)] + [(f"b{i}", "c", 2, [1.0, 0.01 * i + 0.01]) for i in range(5)]
    got = N.ranked(*parts(frame(spark, rows)), k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.vector_id, []).append(r)
    assert len(by) == 405 and all(len(v) == 10 for v in by.values())
    assert all(r.cosine == 1.0 for v, rs in by.items() if v[0] == "a" for r in rs)
    first = [f"a{i:04d}" for i in range(11)]  # equal similarities rank by id
    assert all([r.neighbour_id for r in sorted(rs, key=lambda r: r.rank)] == [x for x in first if x != v][:10] for v, rs in by.items() if v[0] == "a")


def test_greedy_search(spark):
    x = clustered(1200)
    usable, nodes, graph = parts(frame(spark, [(f"v{i:05d}", "c", 24, v.tolist()) for i, v in enumerate(x)]))
    asked = usable.filter("vector_id < 'v00060'").selectExpr("vector_id as query", "grp", "small", "vec")
    hits = N.greedy_search(graph, nodes, usable, asked, 10).join(nodes.select("node", "rep"), "node").collect()
    near = {(r.query, r.rep) for r in hits}
    s = all_cosines(x)
    np.fill_diagonal(s, 2)
    best = np.argsort(-s[:60], axis=1)[:, :10]
    assert np.mean([(f"v{i:05d}", f"v{j:05d}") in near for i in range(60) for j in best[i]]) >= 0.9


def test_search_hands_out_ten_others_and_copies(spark, tmp_path):
    x = clustered(900)
    rows = [(f"v{i:05d}", "c", 24, v.tolist()) for i, v in enumerate(x)]
    rows += [(f"w{i:05d}", "c", 24, x[100].tolist()) for i in range(3)] + [(f"y{i:05d}", "c", 24, x[200].tolist()) for i in range(1, 31)] + [("v00300", "c", 24, x[300].tolist())]
    frame(spark, rows).write.parquet(f"{tmp_path}/vectors.parquet")
    got = p3_search(spark, str(tmp_path)).toPandas()
    asked = [f"v{i:05d}" for i in range(0, 900, 100)] + ["w00000"]
    assert sorted(got["query"].unique()) == asked and got.groupby("query")["rank"].apply(sorted).tolist() == [list(range(1, 11))] * len(asked)
    assert not (got["query"] == got.vector_id).any() and not got.duplicated(["query", "vector_id"]).any()
    lists = {q: g.sort_values("rank").vector_id.tolist() for q, g in got.groupby("query")}
    assert lists["v00100"][:3] == ["w00000", "w00001", "w00002"] and lists["w00000"][:3] == ["v00100", "w00001", "w00002"]
    assert lists["v00200"] == [f"y{i:05d}" for i in range(1, 11)]
    s = all_cosines(x)
    np.fill_diagonal(s, -2)
    plain = [i for i in range(0, 900, 100) if i not in (100, 200) and not {100, 200} & {*np.argsort(-s[i])[:10].tolist()}]
    assert np.mean([f"v{j:05d}" in lists[f"v{i:05d}"] for i in plain for j in np.argsort(-s[i])[:10]]) >= 0.9
