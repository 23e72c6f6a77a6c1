import math

import numpy as np
import pytest

from siteselect.llm import queries, ranges


def brute(rows, threshold=0.93):
    """{vec_id: (links, component)} of rows (vec_id, vector, label), from all pairs."""
    near = {}
    for i, (a, x, la) in enumerate(rows):
        for j, (b, y, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and fine(x) and fine(y) and len(x) == len(y) and ranges.cosine(np.array(x, float), np.array(y, float)) >= threshold:
                near.setdefault(i, []).append(j)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near.get(i, []))], key=lambda k: rows[k][0]) for i in range(len(rows))]
    return sorted((rows[i][0], len(near.get(i, [])), rows[root[i]][0]) for i in range(len(rows)))


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, n long")
    return sorted((r["id"], r["n_links"], r["component"]) for r in ranges.near_duplicates(frame, **how).collect())


def clustered(rng, n=500, dims=8):
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        spread = (0.0, 0.05, 0.15, 0.4)[i % 4]
        v = centres[rng.integers(12)] + rng.normal(size=dims) * spread
        rows.append((i, (v * rng.choice([0.5, 1.0, 3.0])).tolist(), int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block", [2048, 40, 7])
def test_equals_brute_force_in_one_cell_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", block)
    rows = clustered(np.random.default_rng(7))
    assert found(spark, rows) == brute(rows)


def test_a_family_of_near_copies_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(16) + rng.normal(size=16) * 0.03).tolist(), 1) for i in range(150)]  # one ball: a core
    rows += [(200 + i, [math.cos(i * 0.3), math.sin(i * 0.3)], 1) for i in range(10)]  # 0.3 apart each: cosine 0.955
    rows += [(300 + i, [5.0] * 16, 1) for i in range(90)]  # copies
    assert found(spark, rows) == brute(rows)


def test_threshold_itself_links(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [3.0, 4.0], 0), (4, [0.6, 0.8000001], 0)]
    assert found(spark, rows[:3], threshold=0.6) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert found(spark, [rows[0], rows[3]], threshold=0.6) == brute([rows[0], rows[3]], 0.6)


def test_odd_rows(spark):
    one = [1.0, 2.0]
    rows = [(5, one, 1), (5, one, 1), (4, one, 1), (7, one, 2), (8, one, None), (9, None, 1), (10, [], 1), (11, [0.0, 0.0], 1), (12, [float("nan"), 1.0], 1), (13, [float("inf"), 1.0], 1), (14, [None, 1.0], 1), (15, [1.0, 2.0, 0.0], 1), (16, [-1.0, -2.0], 1), (17, [1e300, 2e300], 1), (18, [-0.0, 1.0], 3), (19, [0.0, 1.0], 3)]
    assert found(spark, rows) == brute(rows)
    frame = spark.createDataFrame([(None, one, 1), (3, one, 1), (None, [2.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["id"] or -1, r["n_links"], r["component"], r["kept"]) for r in ranges.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(3, 1, 3, True), (-1, 1, 3, False), (-1, 0, None, False)], key=str)
    assert ranges.near_duplicates(frame.where("vec_id < 0")).count() == 0
    with pytest.raises(ValueError):
        ranges.near_duplicates(frame, threshold=0)


def test_query_equals_sql(spark):
    import oracle

    sf = "/root/testdata/sf0.001"
    oracle.compare(queries.QUERIES["op11_embedding_near_dedup"](spark, sf), ranges.ORACLE, sf)
