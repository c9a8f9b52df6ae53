import math
import random

import numpy as np
import pytest


def floor64(x):
    return math.floor(64.0 * x) if abs(x) < 2.0**900 else 64 * int(x)


def brute(rows, k, every, single=True):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [floor64(float(np.float32(x)) if single else x) for x in v]))
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)
            out += [(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def corpus(n, dims, seed, clusters):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in rng.sample(range(-200, 9000), n)]
    rows += [(20_000 + i, rows[0][1]) for i in range(60)]
    return rows + [(40_000, None), (40_020, [1.0, None] + [0.0] * (dims - 2)), (40_040, [float("nan")] * dims), (40_060, [float("inf")] * dims), (40_080, []), (None, rows[1][1])]


@pytest.mark.parametrize("n,dims,clusters,k", [(500, 8, 5, 20), (300, 3, 40, 7), (12, 4, 2, 20)])
def test_against_brute_force(spark, n, dims, clusters, k, monkeypatch):
    from rastrel.llm import cover_tree as c

    for name, value in (("BLOCK", 64), ("SMALL", 16), ("GROUP", 16), ("CHUNK", 2), ("CENTRES", 12), ("QUERY_CENTRES", 4), ("LEAF", 3), ("PIVOTS", 4)):
        monkeypatch.setattr(c, name, value)
    rows = corpus(n, dims, n, clusters)
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    assert sorted(map(tuple, c.top_k(frame, k).collect())) == brute(rows, k, 20)


def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (40, 16))
    return np.round(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 1, (8000, 16)))


def test_pruning_happens():
    from rastrel.llm import cover_tree as c

    points = clustered()
    near = np.argsort(((points - points[0]) ** 2).sum(1), kind="stable")[:64]
    queries, side = c.Side(near, points[near], 1.0, c.QUERY_CENTRES), c.Side(np.arange(8000), points, 1.0, c.CENTRES)
    best = c.Best(queries.ids, 20)
    made = c.search(queries, best, side, 1.0)
    scores = points[queries.ids] @ points.T
    for q, own in enumerate(queries.ids):
        scores[q, own] = -np.inf
        assert best.found[q].tolist() == np.lexsort((np.arange(8000), -scores[q]))[:20].tolist()
    leaves = [sum(not k for k in t.kids) for t in (queries.tree, side.tree)]
    assert leaves[1] > 20 and made < 0.5 * leaves[0] * leaves[1]


def test_levels_cover_and_separate():
    from rastrel.llm import cover_tree as c

    points = clustered()
    tree = c.CoverTree(points, c.CENTRES)
    centres = points[tree.centres]
    for level in sorted(set(tree.levels.tolist())):
        net = centres[tree.levels >= level]
        apart = np.sqrt(((net[:, None] - net[None]) ** 2).sum(-1))
        assert apart[~np.eye(len(net), dtype=bool)].min(initial=np.inf) > c.BASE**level - 1e-6  # separation; a level holds all centres above it
        assert max(np.sqrt(((net - p) ** 2).sum(1)).min() for p in points[::7]) <= c.BASE**level + 1e-6  # covering
    for node, kids in enumerate(tree.kids):
        rows = points[tree.order[tree.first[node] : tree.last[node]]]
        assert np.sqrt(((rows - tree.points[node]) ** 2).sum(1)).max() <= tree.radius[node]
        for k in kids:
            assert tree.level[k] < tree.level[node] and tree.first[node] <= tree.first[k] and tree.last[k] <= tree.last[node]
            assert np.sqrt(((tree.points[k] - tree.points[node]) ** 2).sum()) <= c.BASE ** tree.level[node] + 1e-6


def test_large_components():
    from rastrel.llm import cover_tree as c

    a = np.array([[2.0**28, -(2.0**40)], [3, 4], [1e300, 2.0]])
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in a] for u in a]
    assert c.products(a, a, 1.0).tolist() == want
    assert c.products(a[:2], a[:2], 1.0).tolist() == [r[:2] for r in want[:2]]


def test_large_and_empty_vectors_take_part(spark):
    from rastrel.llm import cover_tree as c

    rows = [(1, [5e6, 1.0]), (2, []), (0, [1.0, 2.0]), (20, [1e300, -1e300]), (3, [-1e307, 3.0]), (4, [1.7e308]), (5, [1e300, 1.0]), (6, [1e300, 2.0]), (40, []), (7, [-3.0, 0.5]), (60, [-1e150, 1e155]), (60, [2.0, 2.0]), (60, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    want = brute(rows, 20, 20, single=False)
    assert sorted((q, s) for q, _, _, s in map(tuple, c.top_k(frame, 20).collect()) if q != 60) == sorted((q, s) for q, _, _, s in want if q != 60)
    assert [tuple(r) for r in c.top_k(frame, 20).orderBy("query_id", "rank").collect() if r[0] not in (60,)] == [r for r in want if r[0] != 60]


def test_empty(spark):
    from rastrel.llm import cover_tree

    assert cover_tree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
