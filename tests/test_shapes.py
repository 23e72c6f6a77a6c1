"""Polygons with holes, polylines and tiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteselect.functions import geo
from siteselect.operators import features, grid, joins

SHAPE = "array<struct<ring:array<struct<x:double,y:double>>,hole:boolean>>"
BENT = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)]  # a U


def shape(*rings):
    """The first ring is the outline, the others are holes."""
    return [([(float(x), float(y)) for x, y in r], i > 0) for i, r in enumerate(rings)]


def inside(px, py, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def edge_distance(px, py, rings):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            dx, dy = x2 - x1, y2 - y1
            t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(px - x1 - t * dx, py - y1 - t * dy))
    return best


def value(spark, column, *rings):
    return spark.createDataFrame([(shape(*rings),)], f"shape {SHAPE}").select(column.alias("v")).first()["v"]


def test_a_ring_cut_to_boxes_keeps_its_area(spark):
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    assert value(spark, geo.shape_area("shape"), BENT, hole) == 100 - 28 - 1
    assert value(spark, geo.shape_area(geo.clip_shape("shape", 2, 2, 8, 12)), BENT, hole) == 6 * 8 - 28  # two arms and a bar
    assert value(spark, geo.clip_shape("shape", 3, 3, 7, 10), BENT) is not None
    assert value(spark, geo.shape_area(geo.clip_shape("shape", 3, 3, 7, 10)), BENT) == 0
    assert value(spark, F.size(geo.clip_shape("shape", 20, 20, 30, 30)), BENT, hole) == 0
    assert value(spark, geo.shape_area(geo.clip_shape("shape", 1.2, 1.2, 1.8, 1.8)), BENT, hole) == pytest.approx(0, abs=1e-12)


def test_pieces_of_random_polygons_add_up(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        corners = rng.randint(3, 9)
        cx, cy = rng.uniform(-50, 50), rng.uniform(-50, 50)
        arms = [(rng.uniform(2, 30), (i + rng.uniform(0, 0.4)) * 2 * math.pi / corners) for i in range(corners)]
        ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for r, a in arms]
        rows.append((k, shape(ring if k % 2 else ring[::-1])))
    rows += [(90, None), (91, []), (92, shape([(0, 0), (5, 5), (2, 2)]))]
    frame = spark.createDataFrame(rows, f"k int, shape {SHAPE}")
    whole = {r["k"]: r["a"] for r in frame.select("k", geo.shape_area("shape").alias("a")).collect()}
    parts = joins.shape_pieces(frame, 7.0).groupBy("k").agg(F.sum(geo.shape_area("piece")).alias("a"), F.count("*").alias("n"), F.countDistinct("cx", "cy").alias("cells")).collect()
    assert {r["k"] for r in parts} == set(range(40)) and all(r["n"] == r["cells"] for r in parts)
    for r in parts:
        assert r["a"] == pytest.approx(whole[r["k"]], rel=1e-9)


def test_inside_a_shape(spark):
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    at = lambda x, y: value(spark, geo.in_shape(F.lit(x), F.lit(y), "shape"), BENT, hole)
    assert at(5.0, 2.0) and not at(5.0, 5.0) and not at(1.5, 1.5) and at(1.0, 1.5) and at(10.0, 4.0) and not at(11.0, 0.0)


def test_grown_area(spark):
    assert value(spark, geo.grown_area("shape", 2.0), [(0, 0), (4, 0), (4, 3), (0, 3)]) == pytest.approx(12 + 14 * 2 + math.pi * 4)
    for rings, by in (([[(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]], 1.5), ([BENT], 1.0), ([[(0, 0), (20, 2), (15, 18), (1, 15)], [(5, 5), (5, 10), (10, 7)]], 0.8)):
        cells = np.arange(-4, 26, 0.05) + 0.025
        brute = sum(inside(x, y, rings) or edge_distance(x, y, rings) <= by for x in cells[::2] for y in cells[::2]) * 0.01
        for turned in (rings, [r[::-1] for r in rings]):
            assert value(spark, geo.grown_area("shape", by), *turned) == pytest.approx(brute, rel=0.004)
    box, hole = [(0, 0), (9, 0), (9, 9), (0, 9)], [(4, 4), (5, 4), (5, 5), (4, 5)]
    assert value(spark, geo.grown_area("shape", 1.0), box, hole) == pytest.approx(81 + 36 + math.pi)  # the hole has closed


def test_core_chunks_cover_the_boundary(spark):
    frame = spark.createDataFrame([(shape([(3, 3), (27, 5), (25, 28), (2, 20)], [(8, 8), (14, 9), (10, 15)]),), (shape([(31, 31), (38, 31), (38, 38)]),)], f"shape {SHAPE}")
    chunks = grid.core_chunks(frame, 10.0).orderBy("chunk_order").collect()
    assert [r["chunk_id"] for r in chunks[:2]] == ["K_0001", "K_0002"] and [(r["cx"], r["cy"]) for r in chunks] == sorted((r["cx"], r["cy"]) for r in chunks)
    whole = frame.select(F.sum(geo.shape_area("shape")).alias("a")).first()["a"]
    assert sum(r["area_km2"] for r in chunks) * 1e6 == pytest.approx(whole)
    assert len({r["area_km2"] for r in chunks}) > 5


def test_union_area_of_slanted_holed_and_crowded_cells(spark, monkeypatch):
    rng = random.Random(3)
    rows, rings_of = [], []
    for k in range(60):
        x, y, s = rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(5, 25)
        rings = [[(x, y), (x + s, y + s / 3), (x + s / 2, y + s)]]
        if k % 3 == 0:
            rings.append([(x + s * 0.4, y + s * 0.3), (x + s * 0.6, y + s * 0.4), (x + s * 0.5, y + s * 0.6)])
        rows.append((k, shape(*rings)))
        rings_of.append(rings)
    rows += [(k + 100, r) for k, r in rows[:20]]  # repeated shapes
    frame = spark.createDataFrame(rows, f"k int, shape {SHAPE}")
    cells = spark.createDataFrame([(f"c{i}{j}", i, j, 2500.0) for i in range(2) for j in range(2)], "grid_id string, cx long, cy long, cell_area_m2 double")
    got = {r["grid_id"]: r["area_m2"] for r in features.union_area_in_cells(frame, cells, 50.0).collect()}
    for i in range(2):
        for j in range(2):
            at = [(50 * i + 0.25 + a / 2, 50 * j + 0.25 + b / 2) for a in range(100) for b in range(100)]
            brute = sum(any(inside(x, y, rings) for rings in rings_of) for x, y in at) * 0.25
            assert got[f"c{i}{j}"] == pytest.approx(brute, abs=25)
    monkeypatch.setattr(features, "CROWDED", 3)
    finer = {r["grid_id"]: r["area_m2"] for r in features.union_area_in_cells(frame, cells, 50.0).collect()}
    assert finer == pytest.approx(got)
    over = frame.limit(5).union(spark.createDataFrame([(7, shape([(-1, -1), (101, -1), (101, 101), (-1, 101)]))], f"k int, shape {SHAPE}"))
    assert {r["area_ratio"] for r in features.union_area_in_cells(over, cells, 50.0).collect()} == {1.0}
    assert {r["area_m2"] for r in features.union_area_in_cells(frame.limit(0), cells, 50.0).collect()} == {0.0}


def test_polylines_are_cut_into_pieces(spark):
    lines = [
        (1, [(1, 1), (5, 5), (9, 1)]),  # inside: one piece with its bend
        (2, [(5, 8), (5, 12), (7, 12), (7, 8)]),  # leaves and comes back: two pieces
        (3, [(12, 5), (8, 5), (8, 5), (6, 5)]),  # a point twice
        (4, [(-5, 15), (5, 25)]),  # touches a corner at most
        (5, [(0, 0), (10, 0)]),  # on the side
        (6, [(3, 3)]),
        (7, [(4, 4), (4, 4)]),
        (8, None),
        (9, [(2, 10), (2, 9), (2, 10), (3, 9)]),  # comes back at the side: goes on
    ]
    frame = spark.createDataFrame([(k, None if p is None else [(float(x), float(y)) for x, y in p], "x") for k, p in lines], "k int, points array<struct<x:double,y:double>>, tag string")
    tiles = spark.createDataFrame([("t", 0, 0)], "tile_id string, cx long, cy long")
    got = sorted((r["k"], r["piece"], [tuple(p) for p in r["points"]], r["length_m"]) for r in joins.polylines_in_tiles(frame, tiles, 10.0).collect())
    assert [(k, n, p) for k, n, p, _ in got] == [
        (1, 0, [(1, 1), (5, 5), (9, 1)]), (2, 0, [(5, 8), (5, 10)]), (2, 1, [(7, 10), (7, 8)]), (3, 0, [(10, 5), (8, 5), (6, 5)]),
        (5, 0, [(0, 0), (10, 0)]), (9, 0, [(2, 10), (2, 9), (2, 10), (3, 9)]),
    ]
    assert [m for *_, m in got] == pytest.approx([2 * math.sqrt(32), 2, 2, 4, 10, 2 + math.sqrt(2)])


def test_nearest_polygon_and_null_coordinates(spark):
    rng = random.Random(4)
    rings_of = {k: [[(x, y), (x + 30, y + 4), (x + 11, y + 25)]] for k, x, y in ((k, rng.uniform(0, 900), rng.uniform(0, 900)) for k in range(25))}
    rings_of[30] = [[(400, 400), (700, 400), (700, 700), (400, 700)], [(450, 450), (650, 450), (650, 650), (450, 650)]]
    shapes = spark.createDataFrame([(k, shape(*r)) for k, r in rings_of.items()], f"shape_id int, shape {SHAPE}")
    centres = [(i, rng.uniform(-200, 1200), rng.uniform(-200, 1200)) for i in range(150)] + [(200, 420.0, 500.0), (201, 550.0, 550.0), (202, 400.0, 500.0)]
    frame = spark.createDataFrame([*centres, (300, None, 1.0), (301, 2.0, None)], "centre_id int, x double, y double")
    got = {r["centre_id"]: (r["shape_id"], r["distance"]) for r in joins.nearest_shape(frame, shapes, 60.0).collect()}
    assert got.pop(300) == got.pop(301) == (None, None)
    for i, x, y in centres:
        d, k = min((0.0 if inside(x, y, r) else round(edge_distance(x, y, r), 6), k) for k, r in rings_of.items())
        assert got[i][0] == k and got[i][1] == pytest.approx(d, abs=2e-6)
    assert {r["shape_id"] for r in joins.nearest_shape(frame, shapes.limit(0), 60.0).collect()} == {None}
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 1.0)], "point_id int, x double, y double")
    assert {r["centre_id"]: r["point_id"] for r in joins.nearest(frame.where("centre_id in (0, 300, 301)"), points).collect()} == {0: 1, 300: None, 301: None}


def test_points_may_have_a_grid_id(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "grid_id string, cx long, cy long")
    points = spark.createDataFrame([(1, 5.0, 5.0, "old"), (2, 500.0, 1.0, "old"), (3, None, 1.0, "old")], "point_id int, x double, y double, grid_id string")
    assert {r["point_id"]: r["grid_id"] for r in joins.point_in_cell(points, cells).collect()} == {1: "a", 2: "a"}


def test_pixels_inside_a_boundary_and_their_mass_in_cells(spark):
    rings = [[(12, 8), (190, 30), (170, 160), (100, 60), (40, 180)], [(60, 40), (90, 45), (80, 50)]]
    frame = spark.createDataFrame([(shape(*rings),)], f"shape {SHAPE}")
    pixels = spark.createDataFrame([(r, c, float(r * 31 + c)) for r in range(-2, 25) for c in range(-2, 25)], "prow long, pcol long, value double")
    held = features.masked(pixels, frame, 9.0)
    want = {(r, c) for r in range(-2, 25) for c in range(-2, 25) if inside((c + 0.5) * 9, (r + 0.5) * 9, rings)}
    assert {(p["prow"], p["pcol"]) for p in held.collect()} == want and len(want) > 100
    cells = features.regrid(held, 9.0, 25.0)
    report = features.mass_report(held, cells, "value", "population").first()
    assert report["after"] == pytest.approx(report["before"])
    by_cell = {}
    for r, c in want:
        for i in range(9):
            for j in range(9):
                key = ((c * 9 + i) // 25, (r * 9 + j) // 25)
                by_cell[key] = by_cell.get(key, 0) + (r * 31 + c) / 81
    got = {(p["cx"], p["cy"]): (p["population"], p["density_per_km2"]) for p in cells.collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(by_cell)
    assert all(d == pytest.approx(v / (25 * 25 / 1e6)) for v, d in got.values())
    assert features.masked(pixels, frame.limit(0), 9.0).count() == 0


def test_crowded_ground_is_swept_by_few_polygons_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    rings, covered = [], np.zeros((100, 100), dtype=bool)
    for x, y in rng.integers(0, 60, (12, 2)):  # many boxes share a corner
        for w, h in rng.integers(2, 40, (25, 2)):
            rings.append(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float))
            covered[x : x + w, y : y + h] = True
    swept, most = features._swept, []
    monkeypatch.setattr(features, "_swept", lambda edges, owner, box: most.append(len(set(owner.tolist()))) or swept(edges, owner, box))
    assert features.polygon_union_area(rings) == covered.sum()
    assert max(most) <= features.SWEPT


def test_shapes_of_one_file_are_cut_in_many_tasks(spark, tmp_path):
    from siteselect.plans import catalog

    catalog.load()
    rows = [(k, shape([(k, k), (k + 30, k), (k + 30, k + 30)])) for k in range(64)]
    spark.createDataFrame(rows, f"k int, shape {SHAPE}").coalesce(1).write.parquet(str(tmp_path / "shapes"))
    pieces = joins.shape_pieces(spark.read.parquet(str(tmp_path / "shapes")), 20.0)
    assert pieces.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pieces.agg(F.sum("area_m2")).first()[0] == pytest.approx(64 * 450)
    assert catalog.QUERIES["g5_centroid"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_inner_point_is_worked_out_once(spark):
    one = spark.range(1).select(geo.ring_of(*BENT).alias("r")).select(geo.inner_point("r").alias("p"))
    plan = one._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 3
    assert not inside(*one.first()["p"], [[(3, 3), (7, 3), (7, 10), (3, 10)]])


def test_nearest_adds_pairs_up_without_sorting_them(spark, monkeypatch):
    rng = random.Random(8)
    lines = [(k, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(400)]
    lines = [(k, x, y, x + rng.uniform(-90, 90), y + rng.uniform(-90, 90)) for k, x, y in lines] + [(900, 5000.0, 5000.0, 5000.0, 5400.0)]
    spots = [(i, rng.uniform(-300, 1300), rng.uniform(-300, 1300)) for i in range(120)] + [(200, 4900.0, 5200.0)]
    centres = spark.createDataFrame(spots, "centre_id int, x double, y double")
    plans, written = [], joins.keep
    monkeypatch.setattr(joins, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    got = {r["centre_id"]: (r["line_id"], r["distance"]) for r in joins.nearest_line(centres, spark.createDataFrame(lines, "line_id int, x1 double, y1 double, x2 double, y2 double")).collect()}
    for i, x, y in spots:
        d, k = min((round(edge_distance(x, y, [[(a, b), (c, d)]]), 6), k) for k, a, b, c, d in lines)
        assert got[i][0] == k and got[i][1] == pytest.approx(d, abs=2e-6)
    points = spark.createDataFrame([(k, float(k % 7 * 100), float(k % 5 * 100)) for k in range(1, 200)], "point_id int, x double, y double")
    near = {r["centre_id"]: r["point_id"] for r in joins.nearest(centres, points).collect()}
    assert near == {i: min((math.hypot(x - k % 7 * 100, y - k % 5 * 100), k) for k in range(1, 200))[1] for i, x, y in spots}
    shortest = [p for p in plans if "min(round(" in p or "min(d2#" in p and "min(point_id" not in p]
    assert shortest and not any("SortAggregate" in p for p in shortest)
