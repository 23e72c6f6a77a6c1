import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteselect.functions import clean, geo
from siteselect.operators import checks, features, joins, ml, ranks, scoring, selection, stats
from siteselect.sources import readers


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize(("values", "kind", "want"), [([0, 1, 2], "positive", [0, 50, 100]), ([0, 0, 1, 2], "positive", [0, 0, 50, 100]), ([10, 100, 1000], "low", [100, 66.67, 33.33])])
def test_percentile_vectors(spark, values, kind, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = column(ranks.percentile_scores(df, {"s": ("v", kind)}).orderBy("i"), "s")
    assert np.allclose(got, want, atol=0.01)


def test_percentile_equals_pandas_with_ties_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 40) / 4, rng.choice("ab")) for i in range(500)] + [(500, None, "a")]
    df = spark.createDataFrame(rows, "i int, v double, g string")
    got = {r["i"]: r["s"] for r in ranks.percentile_score(df, "v", "s", by=["g"]).collect()}
    frame = pd.DataFrame(rows, columns=["i", "v", "g"])
    want = frame.groupby("g")["v"].rank(method="average", pct=True) * 100
    for i, w in zip(frame["i"], want, strict=True):
        assert (got[i] is None and math.isnan(w)) or abs(got[i] - w) < 1e-9


def test_gap_absence_bands_and_weights(spark):
    df = spark.createDataFrame([(0, 99.5), (1, 97.0), (4, 90.0), (4, 60.0), (4, 20.0)], "n int, p double")
    assert column(df.select(scoring.low_count_gap("n").alias("s")), "s")[:3] == [100, 50, 20]
    assert column(df.select(scoring.absence("n").alias("s")), "s")[:3] == [100, 0, 0]
    assert "".join(column(df.select(scoring.band("p").alias("s")), "s")) == "ABCDE"
    with pytest.raises(ValueError):
        scoring.weighted({"a": 0.5, "b": 0.4})


def test_union_area_counts_overlap_once(spark):
    grid = spark.createDataFrame([("G_1", 0, 0, 0.0, 0.0, 100.0, 100.0, 10000.0)], "grid_id string, cx long, cy long, x0 double, y0 double, x1 double, y1 double, cell_area_m2 double")
    box = lambda a, b: ([([(a, 0.0), (b, 0.0), (b, 100.0), (a, 100.0)], False)],)
    boxes = spark.createDataFrame([box(0.0, 60.0), box(40.0, 100.0)], "shape array<struct<ring:array<struct<x:double,y:double>>,hole:boolean>>")
    row = features.union_area_in_cells(boxes, grid, 100.0).first()
    assert row["area_m2"] == 10000 and row["area_ratio"] == 1
    assert features.polygon_union_area([np.array([(0, 0), (60, 0), (60, 100), (0, 100)], float), np.array([(40, 0), (100, 0), (100, 100), (40, 100)], float)]) == pytest.approx(10000)
    triangle = np.array([(0, 0), (10, 0), (0, 10)], float)
    assert features.polygon_union_area([triangle, triangle + 2]) == pytest.approx(50 + 50 - 18)


def test_kernels_have_13_and_49_cells():
    assert len(features.circular_offsets(1000, 500)) == 13 and len(features.circular_offsets(2000, 500)) == 49


def test_nearest_and_radius_equal_brute_force(spark):
    rng = random.Random(2)
    centres = [(i, rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(60)]
    points = [(i, rng.uniform(0, 50000), rng.uniform(0, 5000)) for i in range(40)] + [(100, 1e6, 1e6)]
    c, p = spark.createDataFrame(centres, "centre_id long, x double, y double"), spark.createDataFrame(points, "point_id long, x double, y double")
    got = {r["centre_id"]: (r["point_id"], r["distance"]) for r in joins.nearest(c, p, 300.0).collect()}
    for i, x, y in centres:
        d, k = min((math.hypot(x - a, y - b), j) for j, a, b in points)
        assert got[i][0] == k and abs(got[i][1] - d) < 1e-9
    counts = {r["centre_id"]: r["n"] for r in features.radius_counts(c, p, {"n": (1500.0, None)}).collect()}
    assert all(counts[i] == sum((x - a) ** 2 + (y - b) ** 2 <= 1500**2 for _, a, b in points) for i, x, y in centres)
    assert column(joins.nearest(c, p.where("point_id < 0")), "point_id") == [None] * 60


def test_diverse_selection_equals_greedy(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100), r) for i, r in enumerate(rng.sample(range(1, 301), 300))]
    df = spark.createDataFrame(points, "point_id long, x double, y double, rank long")
    taken = []
    for i, x, y, _ in sorted(points, key=lambda t: t[3]):
        if all((x - a) ** 2 + (y - b) ** 2 >= 144 for _, a, b in taken):
            taken.append((i, x, y))
    assert column(selection.diverse(df, 12.0, 15), "point_id") == [t[0] for t in taken[:15]]


def test_folds_balance_positives_first(spark):
    blocks = spark.createDataFrame([(f"B{i}", 10 + i, 1 if i < 5 else 0, 9 + i) for i in range(10)], "spatial_block_id string, row_count long, positive_count long, negative_count long")
    got = {r["spatial_block_id"]: r["cv_fold"] for r in ml.assign_folds(blocks).collect()}
    assert sorted(got[f"B{i}"] for i in range(5)) == [0, 1, 2, 3, 4] and len(got) == 10


def test_average_precision_and_auc_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 20) / 20, int(rng.random() < 0.2)) for _ in range(400)]
    got = ml.average_precision(spark.createDataFrame(rows, "score double, y int"), []).first()
    positives = sum(y for _, y in rows)
    ap, seen, hits = 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        same = [y for t, y in rows if t == s]
        seen, hits = seen + len(same), hits + sum(same)
        ap += sum(same) / positives * hits / seen
    wins = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z)
    assert abs(got["ap"] - ap) < 1e-12 and abs(got["auc"] - wins / positives / (len(rows) - positives)) < 1e-12


def test_line_key_ignores_direction_and_ring_functions(spark):
    p = lambda *xy: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])
    one = spark.range(1)
    assert one.select((geo.line_key(p((0, 0), (3, 4))) == geo.line_key(p((3, 4), (0, 0)))).alias("s")).first()["s"]
    u_shape = p((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))
    inner = one.select(geo.inner_point(u_shape).alias("i"), geo.area(u_shape).alias("a")).first()
    assert inner["a"] == 52 and one.select(geo.in_ring(inner["i"]["x"], inner["i"]["y"], u_shape).alias("s")).first()["s"]
    assert one.select(geo.to_ring(5, 5, u_shape).alias("d"), geo.in_ring(10, 5, u_shape).alias("e")).first() == (3.0, True)


def test_projection_on_the_central_meridian_and_back(spark):
    e, n = geo.to_utm(F.lit(33.0), F.lit(40.0))
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(row["e"] - 500000) < 1e-6 and abs(row["n"] - 4427757.219) < 1e-3


def test_polylines_layers_and_keys(spark, tmp_path):
    p = lambda *xy: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])
    got = spark.range(1).select(geo.to_polyline(F.lit(0.0), F.lit(5.0), p((3, 0), (3, 9), (9, 9))).alias("d"), geo.to_polyline(F.lit(0.0), F.lit(4.0), p((3, 0))).alias("e")).first()
    assert tuple(got) == (3.0, 5.0)
    cells = [("a", 0.0, 0.0, 5.0, 5.0), ("b", 5.0, 0.0, 10.0, 5.0)]
    for n, (bad, size) in enumerate(((("a", 0.0, 0.0, 5.0, 5.0), None), (("c", 1.0, 0.0, 0.0, 5.0), None), ((None, 0.0, 5.0, 5.0, 10.0), None), (("c", 0.0, 5.0, 6.0, 10.0), 5.0))):
        spark.createDataFrame([*cells, bad], "grid_id string, x0 double, y0 double, x1 double, y1 double").write.parquet(f"{tmp_path}/{n}")
        with pytest.raises(ValueError):
            readers.spatial_table(spark, f"{tmp_path}/{n}", cell_size=size)
    one, two = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    assert joins.many_to_one(two, one, "k").count() == 2
    with pytest.raises(Exception, match="repeated k"):
        joins.many_to_one(one, two, "k").collect()
    with pytest.raises(Exception, match="repeated s"):
        clean.stations(spark.createDataFrame([(" 1", "5", "1"), ("1 ", "-5", "0")], "s string, c string, f string"), "s", "c", ["f"]).collect()
    assert checks.partition(one, one.where("k = 1"), one.where("k = 2"), "k").first().asDict() == {"first": 1, "second": 1, "in_both": 0, "lost": 0, "foreign": 0}


def test_one_to_one_and_strict_booleans_raise(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeated k"):
        joins.one_to_one(a, a.select("k", F.lit(1).alias("w")), "k").collect()
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(clean.boolean("t", strict=True)).collect()
    with pytest.raises(ValueError):
        checks.enforce(checks.report(a, {"v is above 2": F.col("v") > 2}))


def test_equal_points_stay_and_edges_go_to_the_lowest_cell(spark):
    grid = spark.createDataFrame([("G_1", 0, 0), ("G_2", 0, 1), ("G_3", 1, 0), ("G_4", 1, 1)], "grid_id string, cx long, cy long")
    points = spark.createDataFrame([(1, 10.0, 10.0), (1, 10.0, 10.0), (2, 500.0, 500.0), (2, 500.0, 500.0), (3, 500.0, 20.0), (4, 2000.0, 0.0)], "point_id int, x double, y double")
    got = sorted((r["point_id"], r["grid_id"]) for r in joins.point_in_cell(points, grid).collect())
    assert got == [(1, "G_1"), (1, "G_1"), (2, "G_1"), (2, "G_1"), (3, "G_1")]


def test_shuffle_moves_values_over_the_whole_fold(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i)) for i in range(80)], "grid_id long, cv_fold int, v double")
    got = {r["grid_id"]: r["v"] for r in ml.shuffled(rows, "v", 7).collect()}
    assert sorted(got.values()) == [float(i) for i in range(80)] and all(got[i] % 2 == i % 2 for i in got)
    assert sum(got[i] != i for i in got) > 60 and got == {r["grid_id"]: r["v"] for r in ml.shuffled(rows.repartition(3), "v", 7).collect()}


def test_ties_are_numbered_by_id_and_many_columns_make_a_short_plan(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 3 else float(i), None if i == 5 else 1.0) for i in range(60)], "i int, v double, w double")
    got = {r["i"]: r["p"] for r in ranks.row_numbers(df, "v", "i", "p").collect()}
    order = sorted(range(60), key=lambda i: (-(0.0 if i % 3 else float(i)), i))
    assert [got[i] for i in order] == list(range(1, 61))
    assert {r["i"]: r["p"] for r in ranks.row_numbers(df, "w", "i", "p").collect()}[5] is None
    wide = df.select("i", *[(F.col("v") * k).alias(f"c{k}") for k in range(1, 16)])
    lines = lambda k: len(stats.with_average_ranks(wide, [f"c{j}" for j in range(1, k + 1)])._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert lines(12) < 2.5 * lines(6)


def test_what_cannot_be_finished_raises(spark):
    chain = spark.createDataFrame([(i, float(i), 0.0, i) for i in range(12)], "point_id long, x double, y double, rank long")
    assert selection.diverse(chain, 2.0).count() == 6
    with pytest.raises(RuntimeError):
        selection.diverse(chain, 2.0, rounds=2)
    with pytest.raises(ValueError):
        selection.diverse(chain, 2.0, 7, strict=True)
    assert column(selection.diverse(chain, 2.0, 5, first=2), "point_id") == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        ml.balanced_weights(spark.createDataFrame([(0,), (1,), (2,)], "y int"), "y")


def test_nothing_outside_imports_the_text_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "siteselect"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "siteselect.llm" not in path.read_text(), path


def test_radius_counts_by_points_and_by_squares(spark, monkeypatch):
    rng = random.Random(12)
    centres = [(i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(60)] + [(99, 100.0, 100.0)]
    points = [(i, float(round(rng.gauss(400, 150))), float(round(rng.gauss(400, 150))), rng.random() < 0.4) for i in range(700)]
    points += [(5000, 300.0, 300.0, True)] * 3 + [(6000, 300.0, 300.0, False), (6000, 500.0, 500.0, True), (7000, 150.0, 100.0, None)]  # repeated rows; one id in two places
    points += [(8000 + i, 450.0, 450.0, True) for i in range(200)]  # one place
    frame = spark.createDataFrame([*points, (None, 1.0, 1.0, True), (9999, None, 1.0, True)], "point_id int, x double, y double, flag boolean")
    around = spark.createDataFrame(centres, "centre_id int, x double, y double")
    counts = {"near": (50.0, None), "far": (200.0, None), "flagged": (100.0, F.col("flag"))}

    def inside(dx, dy, r, quarter):
        if quarter is None:
            return dx * dx + dy * dy <= r * r
        ring = [(r * math.cos(2 * math.pi * k / (4 * quarter)), r * math.sin(2 * math.pi * k / (4 * quarter))) for k in range(4 * quarter)]
        return all((bx - ax) * (dy - ay) - (by - ay) * (dx - ax) >= -1e-9 for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True))

    for quarter in (None, 2, 16):
        want = {c: tuple(len({p for p, px, py, f in points if inside(x - px, y - py, r, quarter) and (k != "flagged" or f)}) for k, (r, _) in counts.items()) for c, x, y in centres}
        for dense in (10**9, 0):
            monkeypatch.setattr(features, "DENSE", dense)
            got = {r["centre_id"]: (r["near"], r["far"], r["flagged"]) for r in features.radius_counts(around, frame, counts, ["flag"], quarter).collect()}
            assert got == want
        assert set(r["far"] for r in features.radius_counts(around, frame.limit(0), counts).collect()) == {0}


def test_places_and_metrics_of_many_distinct_values_use_every_task(spark):
    """Groups of distinct values are dealt to stretches evenly, one group as well as several, and metrics see ties that a limit cuts through."""
    from siteselect.operators import ranks

    frame = spark.range(20000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 20000).cast("double").alias("v"))
    counts = ranks.prefix_counts(frame, "v", ["g"], parts=8)
    assert "array_distinct" not in counts._jdf.queryExecution().optimizedPlan().toString()  # values were compared with all cuts, one after another
    rows = counts.collect()
    assert len(rows) == 20000 and all(r["below"] == int(r["v"]) and r["n"] == 20000 and r["same"] == 1 for r in rows)
    sizes = [r["count"] for r in counts.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert max(sizes) < 20000


def test_score_metrics_equal_plain_ones(spark):
    from siteselect.operators import stats

    rng = random.Random(9)
    rows = [(f"g{i:04d}", float(rng.randrange(6)), None if i % 50 == 3 else float(rng.randrange(40)), float(rng.random())) for i in range(500)]
    frame = spark.createDataFrame(rows, "grid_id string, base double, s double, o double")
    got = stats.score_metrics(frame, ["s"], "base", ["o"], limit=30.0).first()
    place = lambda at: {r[0]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[at] is not None), key=lambda r: (-r[at], r[0])))}
    base, own = place(1), place(2)
    best = sorted(r[2] for r in rows if base[r[0]] <= 20 and r[2] is not None)
    known = sorted(r[2] for r in rows if r[2] is not None)
    middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert got["median"] == middle(known) and got["top_median"] == middle(best) and got["top_min"] == best[0] and got["top_at_limit"] == sum(v >= 30 for v in best)
    assert got["overlap_5"] == sum(base[k] <= 25 and p <= 25 for k, p in own.items()) and got["overlap_1"] == sum(base[k] <= 5 and p <= 5 for k, p in own.items())
    flat = stats.score_metrics(frame.withColumn("base", F.lit(2.0)), ["base"], "base").first()
    assert flat["spearman_base"] is None and flat["overlap_1"] == 5 and flat["top_median"] == 2.0
