import random

import numpy as np

from siteselect.llm import search


def brute(points, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in points if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_equals_brute_force_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 60)
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    points = [(i, [rng.randint(-40, 40) for _ in range(6)]) for i in range(300)] + [(i, [9, -9, 9, -9, 9, 9]) for i in range(300, 500)] + [(i, [rng.randint(-2, 2)] * 6) for i in range(500, 560)]
    frame = spark.createDataFrame(points, "vec_id long, v array<long>")
    for k in (1, 5):
        got = sorted(tuple(r) for r in search.top_k(frame, frame.where("vec_id % 10 = 0"), k).collect())
        assert got == brute(points, [p for p in points if p[0] % 10 == 0], k)


def test_few_rows_null_rows_and_large_values(spark):
    rows = [(0, [2.0**20, 1.0]), (50, [-(2.0**20), 0.5]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [])]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", search.quantised(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in search.top_k(frame, frame.where("vec_id % 50 = 0")).collect())
    score = -(2**56) + 256 * 128
    assert got == [(0, 1, 50, score), (50, 1, 0, score)]
    assert search.top_k(frame.where("vec_id < 0"), frame.where("vec_id < 0")).count() == 0


def test_lengths_mix_and_rare_ones_share_spare_cells(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 40)
    monkeypatch.setattr(search, "BLOCK_ROWS", 9)
    rng = random.Random(8)
    points = [(i, [rng.randint(-9, 9) for _ in range(3 + i % 2)]) for i in range(300)] + [(i, [1] * (5 + i % 70)) for i in range(300, 440)]
    frame = spark.createDataFrame(points, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in search.top_k(frame, frame.where("vec_id % 5 = 0"), 3).collect())
    assert got == brute(points, [p for p in points if p[0] % 5 == 0], 3)


def _boxed(points, cells):
    made = search.Cells({points.shape[1]: points}, cells)
    cell = made.assign(points)
    low, high, first = (np.array([f(c) for c in range(made.count)]) for f in (lambda c: points[cell == c].min(axis=0), lambda c: points[cell == c].max(axis=0), lambda c: np.flatnonzero(cell == c)[0]))
    made.boxes = {points.shape[1]: (low, high, first)}
    return made, cell


def test_cells_halve_the_sample_and_equal_rows_share_one():
    rng = np.random.default_rng(1)
    made, cell = _boxed(rng.integers(-100, 100, (1600, 4)), 16)
    assert made.count == 16 and 50 <= np.bincount(cell).min() and np.bincount(cell).max() <= 150
    made, cell = _boxed(np.full((500, 4), 7), 16)
    assert made.count == 1 and not cell.any()


def test_queries_go_only_to_cells_that_can_better_them():
    """Families of near vectors: the share of cells that a query reaches is small and does not grow with the rows, and all that beats its k-th score is there."""
    reached = []
    for rows in (640, 3200):
        rng = np.random.default_rng(2)
        points = np.repeat(rng.normal(0, 300, (16, 16)).astype(np.int64), rows // 16, axis=0) + rng.integers(-20, 20, (rows, 16))
        made, cell = _boxed(points, 16)
        queries = points[::50]
        scores = queries @ points.T
        scores[np.arange(len(queries)), np.arange(0, rows, 50)] = -(10**9)
        worst = np.sort(scores, axis=1)[:, -5]
        sent = {c: set(some.tolist()) for c, some in made.reach(queries, np.full(len(queries), True), worst, np.zeros(len(queries), np.int64))}
        assert all(q in sent.get(c, ()) for q, x in zip(*np.nonzero(scores > worst[:, None]), strict=True) for c in [cell[x]])
        reached.append(sum(map(len, sent.values())) / len(queries))
    assert max(reached) < 8 and reached[1] < reached[0] * 1.3
    unknown = dict(made.reach(queries, np.full(len(queries), False), worst, worst))
    assert set(unknown) == set(range(16)) and all(len(some) == len(queries) for some in unknown.values())


def test_tree_of_many_leaves_equals_brute_force_with_and_without_limits(monkeypatch):
    monkeypatch.setattr(search, "LEAF_ROWS", 8)
    rng = np.random.default_rng(3)
    points, ids = rng.integers(-6, 7, (400, 5)), rng.permutation(400)
    tree = search.Tree.load(search.Tree(ids, points).dump())
    assert len(tree.nodes) > 60
    rows = {int(i): p for i, p in zip(ids, points, strict=True)}
    asks = list(range(0, 400, 20))
    for limit in (None, (20, 200)):
        found = tree.search(np.array([rows[q] for q in asks]), np.array(asks), 5, [limit] * len(asks))
        for q, got in zip(asks, found, strict=True):
            best = sorted(((int(rows[q] @ p), i) for i, p in rows.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
            assert got == [x for x in best if limit is None or (-x[0], x[1]) <= (-limit[0], limit[1])]
