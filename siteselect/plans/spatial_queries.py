"""Grids, spatial joins, geometry and per-cell features."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteselect.functions import clean, geo
from siteselect.operators import features, grid, joins
from siteselect.operators.ranks import percentile_scores
from siteselect.operators.scratch import dealt, keep
from siteselect.plans.catalog import Tables, query

CENTRES = "centre AS (SELECT grid_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM $grid)"
IN_CELL = "local AS (SELECT p.*, min(g.grid_id) AS grid_id FROM {p} p JOIN $grid g ON p.x BETWEEN g.x0 AND g.x1 AND p.y BETWEEN g.y0 AND g.y1 GROUP BY ALL)"


def centres(t: Tables):
    return t("grid").select(F.col("grid_id").alias("centre_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))


def parking_points(t: Tables):
    return t("parking").select("point_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "capacity")


def ring():
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))


OUTLINE = [(2000, 1000), (38000, 3000), (39000, 36000), (20000, 39500), (1000, 30000)]
PPOINT = "pp AS (SELECT point_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, capacity FROM $parking)"


@query("j1_point_in_cell", f"WITH {IN_CELL.format(p='(SELECT point_id, x, y FROM $poi)')} SELECT point_id, x, y, grid_id FROM local")
def _(t):
    return joins.point_in_cell(t("poi").select("point_id", "x", "y"), t("grid"))


LINES = """keyed AS (SELECT r.*, g.grid_id, g.x0, g.y0, g.x1 AS gx1, g.y1 AS gy1 FROM $road r JOIN $grid g ON least(r.x1, r.x2) <= g.x1 AND greatest(r.x1, r.x2) >= g.x0 AND least(r.y1, r.y2) <= g.y1 AND greatest(r.y1, r.y2) >= g.y0),
slab AS (SELECT *, CASE WHEN x1 = x2 THEN 0.0 ELSE least((x0 - x1) / (x2 - x1), (gx1 - x1) / (x2 - x1)) END AS ax, CASE WHEN x1 = x2 THEN 1.0 ELSE greatest((x0 - x1) / (x2 - x1), (gx1 - x1) / (x2 - x1)) END AS bx,
  CASE WHEN y1 = y2 THEN 0.0 ELSE least((y0 - y1) / (y2 - y1), (gy1 - y1) / (y2 - y1)) END AS ay, CASE WHEN y1 = y2 THEN 1.0 ELSE greatest((y0 - y1) / (y2 - y1), (gy1 - y1) / (y2 - y1)) END AS by_ FROM keyed),
met AS (SELECT road_id, grid_id, is_main, greatest(0.0, least(1.0, bx, by_) - greatest(0.0, ax, ay)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length_m FROM slab)"""


@query("j2_line_cell_intersection", f"WITH {LINES} SELECT grid_id, count(*) AS pieces, round(sum(length_m), 3) AS length_m FROM met WHERE length_m > 0 GROUP BY grid_id")
def _(t):
    return joins.lines_in_cells(t("road"), t("grid")).groupBy("grid_id").agg(F.count("*").alias("pieces"), F.round(F.sum("length_m"), 3).alias("length_m"))


@query("j4_nearest_line", f"""WITH {CENTRES}, st AS (SELECT point_id, x, y FROM $station),
d AS (SELECT s.point_id, r.road_id, greatest(0.0, least(1.0, ((s.x - r.x1) * (r.x2 - r.x1) + (s.y - r.y1) * (r.y2 - r.y1)) / ((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1)))) AS t, s.x, s.y, r.x1, r.y1, r.x2, r.y2 FROM st s CROSS JOIN (SELECT * FROM $road WHERE is_main) r),
e AS (SELECT point_id, road_id, round(sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))), 6) AS distance FROM d)
SELECT point_id AS centre_id, min(distance) AS distance, arg_min(road_id, (distance, road_id)) AS road_id FROM e GROUP BY point_id""")
def _(t):
    stations = t("station").select(F.col("point_id").alias("centre_id"), "x", "y")
    near = joins.nearest_line(stations, t("road").where("is_main").withColumnRenamed("road_id", "line_id"))
    return near.select("centre_id", "distance", F.col("line_id").alias("road_id"))


@query("j5_nearest_point", f"WITH {CENTRES}, d AS (SELECT c.grid_id, s.point_id, round(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), 4) AS d, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM centre c CROSS JOIN $station s) SELECT grid_id AS centre_id, arg_min(point_id, (d2, point_id)) AS point_id, min(d) AS distance FROM d GROUP BY grid_id")
def _(t):
    return joins.nearest(centres(t), t("station")).select("centre_id", "point_id", F.round("distance", 4).alias("distance"))


@query("j6_radius_join", f"WITH {CENTRES} SELECT c.grid_id AS centre_id, count(DISTINCT s.point_id) AS n FROM centre c LEFT JOIN $station s ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 1000000 GROUP BY c.grid_id")
def _(t):
    return features.radius_counts(centres(t), t("station"), {"n": (1000.0, None)})


POLYGON = "sqrt(dx * dx + dy * dy) * cos(atan2(dy, dx) - floor(atan2(dy, dx) / (pi() / 32)) * pi() / 32 - pi() / 64) <= 1000 * cos(pi() / 64)"


@query("j6_radius_join_polygon", f"WITH {CENTRES}, d AS (SELECT c.grid_id, p.point_id, c.x - p.x AS dx, c.y - p.y AS dy FROM centre c LEFT JOIN $poi p ON abs(c.x - p.x) <= 1000 AND abs(c.y - p.y) <= 1000) SELECT grid_id AS centre_id, count(DISTINCT point_id) FILTER (WHERE {POLYGON}) AS n FROM d GROUP BY grid_id")
def _(t):
    """The circle as a polygon of 16 segments a quarter."""
    return features.radius_counts(centres(t), t("poi").select("point_id", "x", "y"), {"n": (1000.0, None)}, quarter=16)


@query("j7_radius_count", f"WITH {CENTRES} SELECT c.grid_id AS centre_id, count(p.point_id) AS within_1000m FROM centre c LEFT JOIN $poi p ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 1000000 GROUP BY c.grid_id")
def _(t):
    return features.radius_counts(centres(t), t("poi").select("point_id", "x", "y"), {"within_1000m": (1000.0, None)})


def other_stations(t: Tables):
    return t("customer").select(F.col("c_custkey").alias("point_id"), ((F.col("c_custkey") * 104729 + 67) % 40000).cast("double").alias("x"), ((F.col("c_custkey") * 1299709 + 59) % 40000).cast("double").alias("y"))


MATCHED = """WITH b AS (SELECT c_custkey AS point_id, CAST((c_custkey * 104729 + 67) % 40000 AS DOUBLE) AS x, CAST((c_custkey * 1299709 + 59) % 40000 AS DOUBLE) AS y FROM customer),
d AS (SELECT b.point_id, b.x, b.y, a.point_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM b CROSS JOIN $station a),
m AS (SELECT point_id, any_value(x) AS x, any_value(y) AS y, arg_min(other, (d2, other)) AS matched_id, sqrt(min(d2)) AS d FROM d GROUP BY point_id)"""


@query("j8_distance_dedup", f"{MATCHED} SELECT point_id, x, y, matched_id, round(d, 4) AS distance, d <= 100 AS duplicate FROM m")
def _(t):
    return joins.compared(other_stations(t), t("station"), 100.0).withColumn("distance", F.round("distance", 4))


@query("j8_unmatched_points", f"{MATCHED} SELECT point_id, x, y FROM m WHERE d > 100")
def _(t):
    return joins.unmatched(other_stations(t), t("station"), 100.0)


@query("j9_one_to_one_join", "SELECT s_suppkey, s_name, n FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey)")
def _(t):
    return joins.one_to_one(t("supplier").select("s_suppkey", "s_name"), t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n")), "s_suppkey")


@query("j10_many_to_one_join", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return joins.many_to_one(t("orders").select("o_orderkey", "o_custkey"), t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "inner").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("j11_key_normalised_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def _(t):
    left = t("supplier").select(F.concat(F.lit("SRJ/"), F.col("s_suppkey").cast("string")).alias("station_no"), F.when(F.col("s_suppkey") % 3 == 0, "accepted_exact").otherwise("rejected").alias("decision"))
    right = t("station").select(F.col("point_id").alias("s_suppkey"), "s_name", "x", "y", F.col("point_id").cast("string").alias("key"))
    return joins.accepted_matches(left, right, clean.digits("station_no"), "key", bounds={"x": (0, 40000), "y": (0, 40000)}).select("s_suppkey", "s_name")


@query("j12_id_membership", "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k")
def _(t):
    return joins.id_sets(t("lineitem").select(F.col("l_orderkey").alias("k")), t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), "k")


@query("j13_align_score_tables", "SELECT grid_id, cv_fold, target, m1, m2, m3 FROM $candidate")
def _(t):
    c = t("candidate")
    return joins.align({m: c.select("grid_id", "cv_fold", "target", m) for m in ("m1", "m2", "m3")}, "grid_id", ["cv_fold", "target"]).select("grid_id", "cv_fold", "target", "m1", "m2", "m3")


@query("j14_union_with_provenance", "SELECT point_id, x, y, 'registry' AS source, capacity FROM $station UNION ALL SELECT point_id, x, y, 'map', NULL FROM $poi")
def _(t):
    return joins.with_provenance({"registry": t("station").select("point_id", "x", "y", "capacity"), "map": t("poi").select("point_id", "x", "y")}).select("point_id", "x", "y", "source", "capacity")


@query("j16_recovery_check", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS found, b.k IS NOT NULL AS expected FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) a FULL JOIN (SELECT p_partkey AS k FROM part) b ON a.k = b.k")
def _(t):
    return joins.recovery(t("lineitem").select(F.col("l_partkey").alias("k")), t("part").select(F.col("p_partkey").alias("k")), "k")


J17 = """WITH n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT grid_id, x, y, coalesce(lines, 0) AS lines, c_acctbal AS demand FROM $candidate JOIN orders ON o_orderkey = CAST(substr(grid_id, 3) AS BIGINT) JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON l_orderkey = o_orderkey"""


@query("j17_attach_context", J17)
def _(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    demand = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("demand"))
    context = t("orders").select("o_orderkey", "o_custkey").join(demand, "o_custkey").join(lines, "o_orderkey", "left").fillna(0, ["lines"])
    context = context.select(F.concat(F.lit("C_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("grid_id"), "lines", "demand")
    return joins.attached(t("candidate").select("grid_id", "x", "y"), context, "grid_id", ["lines", "demand"])


A1 = f"""WITH {LINES}, each AS (SELECT grid_id, round(sum(length_m), 4) AS a, count(DISTINCT road_id) AS n, round(coalesce(sum(length_m) FILTER (WHERE is_main), 0), 4) AS b, count(DISTINCT road_id) FILTER (WHERE is_main) AS k FROM met WHERE length_m > 0 GROUP BY grid_id)
SELECT grid_id, coalesce(a, 0) AS road_length_m, coalesce(n, 0) AS road_segment_count, coalesce(b, 0) AS main_road_length_m, coalesce(k, 0) AS main_road_segment_count FROM $grid LEFT JOIN each USING (grid_id)"""


@query("a1_road_features", A1)
def _(t):
    return features.road_features(t("road"), t("grid")).drop("road_density_km_per_km2")


@query("a2_parking_local", f"WITH {PPOINT}, {IN_CELL.format(p='pp')} SELECT g.grid_id, count(DISTINCT point_id) AS parking_count, CAST(coalesce(sum(capacity), 0) AS BIGINT) AS capacity_sum, count(capacity) AS capacity_records FROM $grid g LEFT JOIN local l ON g.grid_id = l.grid_id GROUP BY g.grid_id")
def _(t):
    return features.parking_local(parking_points(t), t("grid"))


@query("a4_charging_features", f"""WITH {CENTRES}, {IN_CELL.format(p='(SELECT point_id, x, y FROM $station)')}, n AS (SELECT grid_id, count(DISTINCT point_id) AS n FROM local GROUP BY grid_id),
d AS (SELECT c.grid_id, s.point_id, s.has_ac, s.has_dc, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM centre c CROSS JOIN $station s),
e AS (SELECT grid_id, count(*) FILTER (WHERE d2 <= 1000000) AS within_1000m, count(*) FILTER (WHERE d2 <= 4000000) AS within_2000m, count(*) FILTER (WHERE d2 <= 1000000 AND has_ac) AS ac_within_1000m, count(*) FILTER (WHERE d2 <= 1000000 AND has_dc) AS dc_within_1000m, arg_min(point_id, (d2, point_id)) AS nearest_id, round(sqrt(min(d2)), 4) AS nearest_m FROM d GROUP BY grid_id)
SELECT e.*, coalesce(n.n, 0) AS station_count, CASE WHEN n.n > 0 THEN 1 ELSE 0 END AS has_station FROM e LEFT JOIN n USING (grid_id)""")
def _(t):
    return features.charging_features(t("grid"), t("station").select("point_id", "x", "y", "has_ac", "has_dc"))


FLAGS = ["is_retail", "is_education", "is_health", "is_transport"]


@query("a5_activity_features", f"""WITH {IN_CELL.format(p='(SELECT point_id, x, y, is_retail, is_education, is_health, is_transport FROM $poi)')}, {CENTRES},
a AS (SELECT g.grid_id, count(point_id) AS poi_count, {", ".join(f"count(*) FILTER (WHERE {f}) AS {f}_count" for f in FLAGS)} FROM $grid g LEFT JOIN local l ON g.grid_id = l.grid_id GROUP BY g.grid_id),
b AS (SELECT c.grid_id, count(p.point_id) FILTER (WHERE d2 <= 1000000) AS poi_1000m, count(p.point_id) AS poi_2000m, count(*) FILTER (WHERE d2 <= 1000000 AND is_retail) AS retail_1000m FROM centre c LEFT JOIN LATERAL (SELECT *, (c.x - q.x) * (c.x - q.x) + (c.y - q.y) * (c.y - q.y) AS d2 FROM $poi q WHERE (c.x - q.x) * (c.x - q.x) + (c.y - q.y) * (c.y - q.y) <= 4000000) p ON true GROUP BY c.grid_id)
SELECT a.*, poi_1000m, poi_2000m, retail_1000m FROM a JOIN b USING (grid_id)""")
def _(t):
    local = features.local_categories(t("poi"), t("grid"), FLAGS)
    around = features.radius_counts(centres(t), t("poi").select("point_id", "x", "y", "is_retail"), {"poi_1000m": (1000.0, None), "poi_2000m": (2000.0, None), "retail_1000m": (1000.0, F.col("is_retail"))}, ["is_retail"])
    return local.join(around.withColumnRenamed("centre_id", "grid_id"), "grid_id")


def outlined(table: str, key: str, x: str, y: str, outline: list = OUTLINE) -> str:
    """SQL of points that are inside an outline (or on its edge) and their distance to its edges."""
    edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(outline, [*outline[1:], outline[0]], strict=True))
    u = "greatest(0.0, least(1.0, ((px - ex1) * (ex2 - ex1) + (py - ey1) * (ey2 - ey1)) / ((ex2 - ex1) * (ex2 - ex1) + (ey2 - ey1) * (ey2 - ey1))))"
    return f"""edge(ex1, ey1, ex2, ey2) AS (VALUES {edges}), tried AS (SELECT *, (ey1 > py) <> (ey2 > py) AND px < (ex2 - ex1) * (py - ey1) / nullif(ey2 - ey1, 0) + ex1 AS crosses, {u} AS u FROM (SELECT {key} AS k, {x} AS px, {y} AS py FROM {table}), edge),
outlined AS (SELECT k, min(sqrt((px - ex1 - u * (ex2 - ex1)) * (px - ex1 - u * (ex2 - ex1)) + (py - ey1 - u * (ey2 - ey1)) * (py - ey1 - u * (ey2 - ey1)))) AS d, count(*) FILTER (WHERE crosses) % 2 = 1 AS odd FROM tried GROUP BY k)"""


#: Pixels of 300 m in cells of 500 m, so that most lie in two or four; the boundary spans the same columns and rows as the raster.
PIXEL = 300.0
WIDE = [(3 * x, 3 * y) for x, y in OUTLINE]
CELLS = f"""known AS (SELECT prow, pcol, prow * 1000 + pcol AS k, value FROM $pixel WHERE value IS NOT NULL), {outlined("(SELECT DISTINCT prow, pcol, k FROM known)", "k", "pcol * 300 + 150.0", "prow * 300 + 150.0", WIDE)},
held AS (SELECT prow, pcol, value FROM known JOIN outlined USING (k) WHERE odd OR d < 1e-9),
met AS (SELECT *, unnest(range(CAST(floor(pcol * 300 / 500.0) AS BIGINT), CAST(ceil((pcol + 1) * 300 / 500.0) AS BIGINT))) AS cx FROM held),
both_ AS (SELECT *, unnest(range(CAST(floor(prow * 300 / 500.0) AS BIGINT), CAST(ceil((prow + 1) * 300 / 500.0) AS BIGINT))) AS cy FROM met),
cell AS (SELECT cx, cy, sum(value * (least((pcol + 1) * 300, (cx + 1) * 500) - greatest(pcol * 300, cx * 500)) * (least((prow + 1) * 300, (cy + 1) * 500) - greatest(prow * 300, cy * 500)) / 90000.0) AS population FROM both_ GROUP BY cx, cy)"""


def inhabited(t: Tables):
    """Usable pixels inside the boundary."""
    from siteselect.sources.readers import pixels

    outline = t.spark.range(1).select(geo.shape_of(geo.ring_of(*WIDE)).alias("shape"))
    return features.masked(pixels(t("pixel")), outline, PIXEL)


def population(t: Tables):
    return features.regrid(inhabited(t), PIXEL, 500.0)


@query("a6_population_regrid", f"WITH {CELLS} SELECT cx, cy, round(population, 3) AS population, round(population * 4, 3) AS density_per_km2 FROM cell")
def _(t):
    return population(t).select("cx", "cy", F.round("population", 3).alias("population"), F.round("density_per_km2", 3).alias("density_per_km2"))


@query("a7_focal_sum", f"WITH {CELLS} SELECT a.cx, a.cy, round(sum(b.population), 3) AS population_1000m FROM cell a JOIN cell b ON (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 4 GROUP BY a.cx, a.cy")
def _(t):
    return features.focal_sum(population(t), "population", 1000.0, 500.0, "population_1000m").select("cx", "cy", F.round("population_1000m", 3).alias("population_1000m"))


@query("a8_mass_report", f"WITH {CELLS}, a AS (SELECT sum(value) AS b FROM held), c AS (SELECT sum(population) AS d FROM cell), u AS (SELECT sum(value) AS w FROM known) SELECT round(b, 2) AS before, round(d, 2) AS after, abs(d - b) / b < 1e-8 AS conserved, round(w - b, 2) AS outside FROM a, c, u")
def _(t):
    from siteselect.sources.readers import pixels

    r = features.mass_report(inhabited(t), population(t), "value", "population")
    every = pixels(t("pixel")).agg(F.sum("value").alias("every"))
    return r.join(every, F.lit(True)).select(F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), (F.abs("relative_percent") < 1e-6).alias("conserved"), F.round(F.col("every") - F.col("before"), 2).alias("outside"))


CELLS = "b AS (SELECT CAST(floor(min(x) / 500) AS BIGINT) AS cx0, CAST(floor(min(y) / 500) AS BIGINT) AS cy0, CAST(ceil(max(x) / 500) AS BIGINT) AS cx1, CAST(ceil(max(y) / 500) AS BIGINT) AS cy1 FROM $poi), cells AS (SELECT cx, cy, cx * 1000000 + cy AS k FROM (SELECT unnest(range(cx0, cx1)) AS cx FROM b), (SELECT unnest(range(cy0, cy1)) AS cy FROM b))"


# the inverse of the series under UTM_SQL, to the fourth order, written out
_N3 = "(1 / 298.257223563 / (2 - 1 / 298.257223563))"
_BETA = ("n / 2 - 2.0 * n * n / 3 + 37.0 * n * n * n / 96 - power(n, 4) / 360", "n * n / 48 + n * n * n / 15 - 437.0 * power(n, 4) / 1440", "17.0 * n * n * n / 480 - 37.0 * power(n, 4) / 840", "4397.0 * power(n, 4) / 161280")
_DELTA = ("2 * n - 2.0 * n * n / 3 - 2 * n * n * n + 116.0 * power(n, 4) / 45", "7.0 * n * n / 3 - 8.0 * n * n * n / 5 - 227.0 * power(n, 4) / 45", "56.0 * n * n * n / 15 - 136.0 * power(n, 4) / 35", "4279.0 * power(n, 4) / 630")


def lon_lat_sql(source: str) -> str:
    """SQL of a table `placed`: source's columns with lon and lat of its px, py in UTM zone 36."""
    xi = "xi" + "".join(f" - ({b}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(_BETA, 1))
    eta = "eta" + "".join(f" - ({b}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(_BETA, 1))
    lat = "chi" + "".join(f" + ({d}) * sin({2 * j} * chi)" for j, d in enumerate(_DELTA, 1))
    return f"""third AS (SELECT {_N3} AS n), scaled AS (SELECT *, 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + power(n, 4) / 64) AS r FROM third),
flat AS (SELECT s.*, n, py / r AS xi, (px - 500000) / r AS eta FROM {source} s, scaled), turned AS (SELECT *, {xi} AS xj, {eta} AS ej FROM flat),
sphere AS (SELECT *, asin(sin(xj) / cosh(ej)) AS chi FROM turned),
placed AS (SELECT * EXCLUDE (n, xi, eta, xj, ej, chi), round(degrees(atan2(sinh(ej), cos(xj))) + 33, 7) AS lon, round(degrees({lat}), 7) AS lat FROM sphere)"""


R1 = f"""WITH {CELLS}, {outlined("cells", "k", "cx * 500 + 250.0", "cy * 500 + 250.0")},
held AS (SELECT cx, cy, cx * 500.0::DOUBLE + 250 AS px, cy * 500.0::DOUBLE + 250 AS py FROM cells JOIN outlined USING (k) WHERE odd OR d < 1e-9), {lon_lat_sql("held")}
SELECT concat('G_', lpad(CAST(row_number() OVER (ORDER BY cx, cy) AS VARCHAR), 6, '0')) AS grid_id, cx, cy, px - 250 AS x0, py - 250 AS y0, px + 250 AS x1, py + 250 AS y1, 250000.0::DOUBLE AS cell_area_m2,
  lon AS center_lon, lat AS center_lat FROM placed"""


@query("r1_square_grid", R1)
def _(t):
    b = grid.bounds(t("poi")).first()
    return grid.square_grid(t.spark, b["min_x"], b["min_y"], b["max_x"], b["max_y"], 500.0, OUTLINE, zone=36)


@query("g4_point_in_polygon", f"WITH {outlined('$poi', 'point_id', 'x', 'y')} SELECT k AS point_id, odd OR d < 1e-9 AS inside FROM outlined")
def _(t):
    outline = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in OUTLINE])
    return t("poi").select("point_id", geo.in_ring("x", "y", outline).alias("inside"))


@query("g6_buffer_filter", f"WITH {outlined('$poi', 'point_id', 'x', 'y')} SELECT k AS point_id, round(CASE WHEN odd THEN 0 ELSE d END, 3) AS distance FROM outlined WHERE odd OR d <= 500")
def _(t):
    outline = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in OUTLINE])
    return t("poi").select("point_id", F.round(geo.to_ring("x", "y", outline), 3).alias("distance")).where("distance <= 500")


@query("r3_chunk_assignment", "SELECT greatest(CAST(ceil((x0 + x1) / 2 / 8000) AS BIGINT) - 1, 0) AS chunk_x, greatest(CAST(ceil((y0 + y1) / 2 / 8000) AS BIGINT) - 1, 0) AS chunk_y, count(*) AS grid_count, sum(p) AS poi_count FROM (SELECT g.*, count(l.point_id) AS p FROM $grid g LEFT JOIN $poi l ON l.x >= g.x0 AND l.x < g.x1 AND l.y >= g.y0 AND l.y < g.y1 GROUP BY ALL) GROUP BY 1, 2")
def _(t):
    cx, cy = geo.cell_index("x", "y", 500.0)
    n = t("poi").groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("p"))
    return grid.assign_chunks(t("grid").join(n, ["cx", "cy"], "left"), 8000.0).groupBy("chunk_x", "chunk_y").agg(F.count("*").alias("grid_count"), F.coalesce(F.sum("p"), F.lit(0)).alias("poi_count"))


CHUNK = "chunk AS (SELECT CAST(floor(x / 8000) * 5 + floor(y / 8000) AS BIGINT) AS chunk_order, count(*) AS grid_count FROM $poi GROUP BY 1)"


def chunk_table(t: Tables):
    return t("poi").groupBy((F.floor(F.col("x") / 8000) * 5 + F.floor(F.col("y") / 8000)).alias("chunk_order")).agg(F.count("*").alias("grid_count")).withColumn("chunk_id", clean.padded_id("chunk_order", "K_", 3))


@query("r5_chunk_selection", f"WITH {CHUNK} SELECT chunk_order, grid_count FROM chunk WHERE chunk_order >= 5 ORDER BY chunk_order LIMIT 10")
def _(t):
    return grid.select_chunks(chunk_table(t), from_order=5, limit=10).select("chunk_order", "grid_count")


@query("r6_spatial_blocks", "SELECT concat('B', CAST(floor(x / 5000) AS BIGINT), '_', CAST(floor(y / 5000) AS BIGINT)) AS spatial_block_id, count(*) AS n FROM $poi GROUP BY 1")
def _(t):
    return t("poi").groupBy(grid.block_id("x", "y").alias("spatial_block_id")).agg(F.count("*").alias("n"))


@query("g1_point_distance", "SELECT a.point_id, round(sqrt((a.x - 20000) * (a.x - 20000) + (a.y - 20000) * (a.y - 20000)), 6) AS d FROM $poi a")
def _(t):
    return t("poi").select("point_id", F.round(geo.distance("x", "y", 20000, 20000), 6).alias("d"))


@query("g2_segment_distance", "SELECT road_id, round(sqrt((20000 - x1 - t * (x2 - x1)) * (20000 - x1 - t * (x2 - x1)) + (20000 - y1 - t * (y2 - y1)) * (20000 - y1 - t * (y2 - y1))), 6) AS d FROM (SELECT *, greatest(0.0, least(1.0, ((20000 - x1) * (x2 - x1) + (20000 - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM $road)")
def _(t):
    return t("road").select("road_id", F.round(geo.to_segment(20000, 20000, "x1", "y1", "x2", "y2"), 6).alias("d"))


@query("g2_polyline_distance", "WITH s AS (SELECT * FROM $road), t AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 + 100 AS my FROM s), e AS (SELECT road_id, x1 AS ax, y1 AS ay, mx AS bx, my AS by_ FROM t UNION ALL SELECT road_id, mx, my, x2, y2 FROM t), f AS (SELECT *, CASE WHEN ax = bx AND ay = by_ THEN 0.0 ELSE greatest(0.0, least(1.0, ((20000 - ax) * (bx - ax) + (20000 - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS u FROM e) SELECT road_id, round(min(sqrt((20000 - ax - u * (bx - ax)) * (20000 - ax - u * (bx - ax)) + (20000 - ay - u * (by_ - ay)) * (20000 - ay - u * (by_ - ay)))), 6) AS d FROM f GROUP BY road_id")
def _(t):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    bent = F.array(p(c("x1"), c("y1")), p((c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2 + 100), p(c("x2"), c("y2")))
    return t("road").select("road_id", F.round(geo.to_polyline(F.lit(20000.0), F.lit(20000.0), bent), 6).alias("d"))


@query("g3_clip_segment", """SELECT road_id, round(greatest(0.0, least(1.0, bx, by_) - greatest(0.0, ax, ay)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS inside_m FROM (SELECT *,
  CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN 10000 AND 30000 THEN 0.0 ELSE 2.0 END ELSE least((10000 - x1) / (x2 - x1), (30000 - x1) / (x2 - x1)) END AS ax, CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN 10000 AND 30000 THEN 1.0 ELSE -1.0 END ELSE greatest((10000 - x1) / (x2 - x1), (30000 - x1) / (x2 - x1)) END AS bx,
  CASE WHEN y1 = y2 THEN CASE WHEN y1 BETWEEN 10000 AND 30000 THEN 0.0 ELSE 2.0 END ELSE least((10000 - y1) / (y2 - y1), (30000 - y1) / (y2 - y1)) END AS ay, CASE WHEN y1 = y2 THEN CASE WHEN y1 BETWEEN 10000 AND 30000 THEN 1.0 ELSE -1.0 END ELSE greatest((10000 - y1) / (y2 - y1), (30000 - y1) / (y2 - y1)) END AS by_ FROM $road)""")
def _(t):
    return t("road").select("road_id", F.round(geo.clipped_length("x1", "y1", "x2", "y2", 10000, 10000, 30000, 30000), 6).alias("inside_m"))


@query("g5_centroid", "SELECT point_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM $parking".replace("(x0 + x1) / 2", "round((x0 + x1) / 2, 4)").replace("(y0 + y1) / 2", "round((y0 + y1) / 2, 4)"))
def _(t):
    c, p = geo.centroid(ring()), geo.inner_point(ring())
    return dealt(t("parking")).select("point_id", *[F.round(v, 4).alias(k) for k, v in (("cx", c["x"]), ("cy", c["y"]), ("px", p["x"]), ("py", p["y"]))])


@query("g7_bounds_and_quadrants", "WITH b AS (SELECT min(x) AS ax, min(y) AS ay, max(x) AS bx, max(y) AS by_ FROM $poi), m AS (SELECT *, (ax + bx) / 2 AS mx, (ay + by_) / 2 AS my FROM b) SELECT 0 AS quadrant, ax AS min_x, ay AS min_y, mx AS max_x, my AS max_y FROM m UNION ALL SELECT 1, mx, ay, bx, my FROM m UNION ALL SELECT 2, ax, my, mx, by_ FROM m UNION ALL SELECT 3, mx, my, bx, by_ FROM m")
def _(t):
    return grid.quadrants(grid.bounds(t("poi")))


@query("g8_polygon_area", "SELECT point_id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter FROM $parking")
def _(t):
    return t("parking").select("point_id", geo.area(ring()).alias("area"), geo.perimeter(ring()).alias("perimeter"))


@query("g9_line_key", "SELECT road_id, CASE WHEN a < b THEN concat(a, ',', b) ELSE concat(b, ',', a) END AS line_key FROM (SELECT road_id, concat(CAST(x1 * 100 AS BIGINT), ' ', CAST(y1 * 100 AS BIGINT)) AS a, concat(CAST(x2 * 100 AS BIGINT), ' ', CAST(y2 * 100 AS BIGINT)) AS b FROM $road)")
def _(t):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return t("road").select("road_id", geo.line_key(F.array(p("x1", "y1"), p("x2", "y2"))).alias("line_key"))


@query("g12_row_col", "SELECT point_id, CAST(floor((40000 - y) / 100) AS BIGINT) AS r, CAST(floor(x / 100) AS BIGINT) AS c FROM $poi")
def _(t):
    r, c = geo.row_col("x", "y", 100.0, 0.0, 40000.0)
    return t("poi").select("point_id", r.alias("r"), c.alias("c"))


# the transverse Mercator series of the ellipsoid by third flattening, to the fourth order, written out
N3 = "(1 / 298.257223563 / (2 - 1 / 298.257223563))"
UTM_SQL = f"""WITH k AS (SELECT {N3} AS n), g AS (SELECT point_id, radians(39 + y / 40000) AS phi, radians(32 + x / 40000 - 33) AS lam, k.*, 6378137.0 / (1 + n) * (1 + n * n / 4 + power(n, 4) / 64) AS r FROM $poi, k),
t AS (SELECT *, sinh(atanh(sin(phi)) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(phi))) AS tau FROM g), u AS (SELECT *, atan2(tau, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tau * tau)) AS eta FROM t),
s AS (SELECT *, n / 2 - 2.0 * n * n / 3 + 5.0 * n * n * n / 16 + 41.0 * power(n, 4) / 180 AS a1, 13.0 * n * n / 48 - 3.0 * n * n * n / 5 + 557.0 * power(n, 4) / 1440 AS a2, 61.0 * n * n * n / 240 - 103.0 * power(n, 4) / 140 AS a3, 49561.0 * power(n, 4) / 161280 AS a4 FROM u)
SELECT point_id, round(500000 + 0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 4) AS easting,
  round(0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 4) AS northing FROM s"""


@query("c1_to_utm", UTM_SQL)
def _(t):
    e, n = geo.to_utm(32 + F.col("x") / 40000, 39 + F.col("y") / 40000)
    return t("poi").select("point_id", F.round(e, 4).alias("easting"), F.round(n, 4).alias("northing"))


@query("c2_from_utm", "SELECT point_id, round(32 + x / 40000, 6) AS lon, round(39 + y / 40000, 6) AS lat FROM $poi")
def _(t):
    e, n = geo.to_utm(32 + F.col("x") / 40000, 39 + F.col("y") / 40000)
    lon, lat = geo.from_utm("e", "n")
    return t("poi").select("point_id", e.alias("e"), n.alias("n")).select("point_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def flagship(t: Tables):
    """Activity points joined to the grid, counted in the cell and in 1 km, scored by percentiles; the twenty best cells."""
    local = features.local_categories(t("poi"), t("grid"), [])
    around = features.radius_counts(centres(t), t("poi").select("point_id", "x", "y"), {"poi_1000m": (1000.0, None)})
    both = keep(local.join(around.withColumnRenamed("centre_id", "grid_id"), "grid_id"))
    scored = percentile_scores(both, {"local_score": ("poi_count", "positive"), "around_score": ("poi_1000m", "high")})
    total = F.round(F.col("local_score") * 0.4 + F.col("around_score") * 0.6, 6)
    return scored.select("grid_id", "poi_count", "poi_1000m", F.round("local_score", 6).alias("local_score"), F.round("around_score", 6).alias("around_score"), total.alias("score")).orderBy(F.desc("score"), "grid_id").limit(20)


query("flagship_activity_score", f"""WITH {IN_CELL.format(p='(SELECT point_id, x, y FROM $poi)')}, {CENTRES},
a AS (SELECT g.grid_id, count(point_id) AS poi_count FROM $grid g LEFT JOIN local l ON g.grid_id = l.grid_id GROUP BY g.grid_id),
b AS (SELECT c.grid_id, count(p.point_id) AS poi_1000m FROM centre c LEFT JOIN $poi p ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 1000000 GROUP BY c.grid_id),
j AS (SELECT *, rank() OVER (PARTITION BY poi_count > 0 ORDER BY poi_count) + (count(*) OVER (PARTITION BY poi_count) - 1) / 2.0 AS r1, count(*) OVER (PARTITION BY poi_count > 0) AS n1, rank() OVER (ORDER BY poi_1000m) + (count(*) OVER (PARTITION BY poi_1000m) - 1) / 2.0 AS r2, count(*) OVER () AS n2 FROM a JOIN b USING (grid_id)),
s AS (SELECT grid_id, poi_count, poi_1000m, CASE WHEN poi_count > 0 THEN 100.0 * r1 / n1 ELSE 0 END AS l, 100.0 * r2 / n2 AS m FROM j)
SELECT grid_id, poi_count, poi_1000m, round(l, 6) AS local_score, round(m, 6) AS around_score, round(l * 0.4 + m * 0.6, 6) AS score FROM s ORDER BY 6 DESC, 1 LIMIT 20""")(flagship)
