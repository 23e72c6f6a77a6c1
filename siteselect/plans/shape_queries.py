"""Polygons with holes, polylines and tiles cut by a boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteselect.functions import geo
from siteselect.operators import features, grid, joins
from siteselect.plans.catalog import Tables, query
from siteselect.plans.spatial_queries import CENTRES, OUTLINE, centres

#: Against the clock, as holes may run.
HOLE = [(15000, 12000), (17000, 22000), (26000, 15000)]


def lots(t: Tables):
    """(shape_id, shape): L-shapes, and boxes with a hole."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = x1 - x0, y1 - y0
    bent = geo.shape_of(geo.ring_of((x0, y0), (x1, y0), (x1, y0 + h / 2), (x0 + w / 2, y0 + h / 2), (x0 + w / 2, y1), (x0, y1)))
    box = geo.ring_of((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    hole = geo.ring_of((x0 + w / 4, y0 + h / 4), (x1 - w / 4, y0 + h / 4), (x1 - w / 4, y1 - h / 4), (x0 + w / 4, y1 - h / 4))
    return t("lot").select(F.col("lot_id").alias("shape_id"), F.when(F.col("holed"), geo.shape_of(box, hole)).otherwise(bent).alias("shape"))


#: The boxes that a lot consists of: (condition, corners).
LOT_BOXES = [
    ("NOT holed", "x0, y0, x1, y0 + (y1 - y0) / 2"),
    ("NOT holed", "x0, y0 + (y1 - y0) / 2, x0 + (x1 - x0) / 2, y1"),
    ("holed", "x0, y0, x0 + (x1 - x0) / 4, y1"),
    ("holed", "x1 - (x1 - x0) / 4, y0, x1, y1"),
    ("holed", "x0 + (x1 - x0) / 4, y0, x1 - (x1 - x0) / 4, y0 + (y1 - y0) / 4"),
    ("holed", "x0 + (x1 - x0) / 4, y1 - (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1"),
]
BOXES = "box(lot_id, x0, y0, x1, y1) AS (" + " UNION ALL ".join(f"SELECT lot_id, {c} FROM $lot WHERE {k}" for k, c in LOT_BOXES) + ")"
#: The union of boxes in a cell from the rectangles between all their sides there.
COVERED = f"""{BOXES},
part AS (SELECT grid_id, greatest(b.x0, g.x0) AS ax, greatest(b.y0, g.y0) AS ay, least(b.x1, g.x1) AS bx, least(b.y1, g.y1) AS by_
  FROM box b JOIN $grid g ON b.x0 < g.x1 AND b.x1 > g.x0 AND b.y0 < g.y1 AND b.y1 > g.y0),
xs AS (SELECT grid_id, v AS low, lead(v) OVER (PARTITION BY grid_id ORDER BY v) AS high FROM (SELECT DISTINCT grid_id, unnest([ax, bx]) AS v FROM part)),
ys AS (SELECT grid_id, v AS low, lead(v) OVER (PARTITION BY grid_id ORDER BY v) AS high FROM (SELECT DISTINCT grid_id, unnest([ay, by_]) AS v FROM part)),
met AS (
  SELECT DISTINCT p.grid_id, xs.low AS ax, xs.high AS bx, ys.low AS ay, ys.high AS by_
  FROM part p JOIN xs ON p.grid_id = xs.grid_id AND xs.low >= p.ax AND xs.high <= p.bx JOIN ys ON p.grid_id = ys.grid_id AND ys.low >= p.ay AND ys.high <= p.by_),
covered AS (SELECT grid_id, sum((bx - ax) * (by_ - ay)) AS area_m2 FROM met GROUP BY grid_id)"""


@query("a3_parking_area_ratio", f"WITH {COVERED} SELECT grid_id, round(coalesce(area_m2, 0), 3) AS area_m2, round(coalesce(area_m2, 0) / cell_area_m2, 6) AS area_ratio FROM $grid LEFT JOIN covered USING (grid_id)")
def _(t):
    return features.union_area_in_cells(lots(t), t("grid")).withColumn("area_m2", F.round("area_m2", 3))


@query("g10_union_area", f"WITH {COVERED}, sums AS (SELECT sum((x1 - x0) * (y1 - y0)) AS each_m2 FROM box) SELECT round(sum(area_m2), 2) AS area_m2, count(*) AS cells, round(min(each_m2), 2) AS each_m2 FROM covered, sums")
def _(t):
    """Ground that all lots cover, in how many cells, and the sum of their own areas."""
    union = features.union_area_in_cells(lots(t), t("grid")).agg(F.round(F.sum("area_m2"), 2).alias("area_m2"), F.count_if(F.col("area_m2") > 0).alias("cells"))
    own = lots(t).agg(F.round(F.sum(geo.shape_area("shape")), 2).alias("each_m2"))
    return union.join(own, F.lit(True))


def corners(t: Tables) -> Column:
    x0, y0, w, h = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    outer = [(0, 0), (7, 2), (5, 7), (1, 6)]
    inner = [(3, 3), (3, 4), (4, 3)]
    at = lambda c: (x0 + w * c[0] / 7, y0 + h * c[1] / 7)
    return geo.shape_of(geo.ring_of(*map(at, outer)), geo.ring_of(*map(at, inner)))


#: A field's edges: four anticlockwise, and three of a hole clockwise, in sevenths of its box.
FIELD_EDGES = [((0, 0), (7, 2)), ((7, 2), (5, 7)), ((5, 7), (1, 6)), ((1, 6), (0, 0)), ((3, 3), (3, 4)), ((3, 4), (4, 3)), ((4, 3), (3, 3))]


def cell_area_sql(edges: str, boxes: str, keys: str) -> str:
    """SQL of the area of polygons in boxes by Green's theorem: below each edge (xa, ya, xb, yb; the inside to its left), cut to the box's x, the integral
    of the height above its floor, no more than its side. `edges` is joined with `boxes` (bx0, by0, side) already."""
    rise = "CASE WHEN {0} <= by0 THEN 0 WHEN {0} >= by0 + side THEN side * side / 2 + side * ({0} - by0 - side) ELSE ({0} - by0) * ({0} - by0) / 2 END"
    return f"""span AS (SELECT *, greatest(least(xa, xb), bx0) AS lo, least(greatest(xa, xb), bx0 + side) AS hi FROM {edges} JOIN {boxes}),
ends AS (SELECT *, ya + (lo - xa) * (yb - ya) / (xb - xa) AS yl, ya + (hi - xa) * (yb - ya) / (xb - xa) AS yh FROM span WHERE hi > lo),
below AS (SELECT {keys}, CASE WHEN xb > xa THEN -1 ELSE 1 END * CASE WHEN ya = yb THEN least(greatest(ya - by0, 0), side) * (hi - lo)
  ELSE ({rise.format("yh")} - {rise.format("yl")}) * (xb - xa) / (yb - ya) END AS part FROM ends)"""


FIELD_SQL = " UNION ALL ".join(f"SELECT lot_id, x0, y0, x1, y1, x0 + (x1 - x0) * {a[0]} / 7 AS xa, y0 + (y1 - y0) * {a[1]} / 7 AS ya, x0 + (x1 - x0) * {b[0]} / 7 AS xb, y0 + (y1 - y0) * {b[1]} / 7 AS yb FROM $lot" for a, b in FIELD_EDGES)
J3 = f"""WITH edge AS ({FIELD_SQL}), cell AS (SELECT grid_id, x0 AS bx0, y0 AS by0, 500.0::DOUBLE AS side FROM $grid),
{cell_area_sql("edge", "cell ON x0 < bx0 + 500 AND x1 > bx0 AND y0 < by0 + 500 AND y1 > by0", "lot_id, grid_id")},
area AS (SELECT lot_id, grid_id, sum(part) AS a FROM below GROUP BY ALL)
SELECT grid_id, count(*) AS pieces, round(sqrt(sum(a)), 5) AS side_m FROM area WHERE a > 1e-4 GROUP BY grid_id"""


@query("j3_polygon_cell_intersection", J3)
def _(t):
    """Fields in each cell, and the side of a square as large as all of them there (roots, unlike the areas themselves, do not end in a 5)."""
    fields = t("lot").select("lot_id", corners(t).alias("shape"))
    met = joins.shapes_in_cells(fields, t("grid")).where("area_m2 > 1e-4")
    return met.groupBy("grid_id").agg(F.count("*").alias("pieces"), F.round(F.sqrt(F.sum("area_m2")), 5).alias("side_m"))


J5 = f"""WITH {CENTRES}, {BOXES},
d AS (SELECT c.grid_id, b.lot_id, greatest(b.x0 - c.x, c.x - b.x1, 0) AS dx, greatest(b.y0 - c.y, c.y - b.y1, 0) AS dy FROM centre c CROSS JOIN box b),
e AS (SELECT grid_id, lot_id, round(sqrt(dx * dx + dy * dy), 6) AS d FROM d)
SELECT grid_id AS centre_id, arg_min(lot_id, (d, lot_id)) AS shape_id, min(d) AS distance FROM e GROUP BY grid_id"""


@query("j5_nearest_polygon", J5)
def _(t):
    return joins.nearest_shape(centres(t), lots(t))


def boundary(t: Tables, holed: bool):
    rings = [geo.ring_of(*r) for r in ([OUTLINE, HOLE] if holed else [OUTLINE])]
    return t.spark.range(1).select(geo.shape_of(*rings).alias("shape"))


def in_tiles(t: Tables):
    """(cx, cy, poi_count) of tiles of 8 km."""
    cx, cy = geo.cell_index("x", "y", 8000.0)
    return t("poi").groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("poi_count"))


def _edges(rings: list) -> str:
    sides = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return "edge(xa, ya, xb, yb) AS (VALUES " + ", ".join(f"({a[0]}.0::DOUBLE, {a[1]}.0::DOUBLE, {b[0]}.0::DOUBLE, {b[1]}.0::DOUBLE)" for a, b in sides) + ")"


TILES = "tile AS (SELECT CAST(i AS BIGINT) AS cx, CAST(j AS BIGINT) AS cy, i * 8000.0::DOUBLE AS bx0, j * 8000.0::DOUBLE AS by0, 8000.0::DOUBLE AS side FROM range(0, 5) a(i), range(0, 5) b(j))"
TILE_POI = "poi_of AS (SELECT CAST(floor(x / 8000) AS BIGINT) AS cx, CAST(floor(y / 8000) AS BIGINT) AS cy, count(*) AS poi_count FROM $poi GROUP BY ALL)"
TILE_AREA = "area AS (SELECT cx, cy, sum(part) AS a FROM below GROUP BY ALL), chunk AS (SELECT *, row_number() OVER (ORDER BY cx, cy) AS chunk_order FROM area WHERE a > 1e-6)"

R2 = f"""WITH {_edges([OUTLINE, HOLE])}, {TILES}, {TILE_POI}, {cell_area_sql("edge", "tile ON true", "cx, cy")}, {TILE_AREA}
SELECT concat('K_', lpad(CAST(chunk_order AS VARCHAR), 4, '0')) AS chunk_id, chunk_order, coalesce(poi_count, 0) AS poi_count, round(a / 1e6, 6) AS area_km2
FROM chunk LEFT JOIN poi_of USING (cx, cy)"""


@query("r2_core_chunks", R2)
def _(t):
    chunks = grid.core_chunks(boundary(t, True), 8000.0).join(in_tiles(t), ["cx", "cy"], "left")
    return chunks.select("chunk_id", "chunk_order", F.coalesce("poi_count", F.lit(0)).alias("poi_count"), F.round("area_km2", 6).alias("area_km2"))


# the perimeter of a convex outline in a tile: its edges cut to the tile, and the tile's sides cut to the left of all edges
R4 = f"""WITH {_edges([OUTLINE])}, {TILES}, {TILE_POI}, {cell_area_sql("edge", "tile ON true", "cx, cy")}, {TILE_AREA},
cut AS (SELECT cx, cy, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS d,
    greatest(0, least((bx0 - xa) / (xb - xa), (bx0 + side - xa) / (xb - xa)), least((by0 - ya) / (yb - ya), (by0 + side - ya) / (yb - ya))) AS lo,
    least(1, greatest((bx0 - xa) / (xb - xa), (bx0 + side - xa) / (xb - xa)), greatest((by0 - ya) / (yb - ya), (by0 + side - ya) / (yb - ya))) AS hi FROM edge, tile),
side_ AS (SELECT cx, cy, k, bx0 + side * [0, 1, 1, 0][k] AS px, by0 + side * [0, 0, 1, 1][k] AS py, side * [1, 0, -1, 0][k] AS dx, side * [0, 1, 0, -1][k] AS dy FROM tile, range(1, 5) r(k)),
half AS (SELECT cx, cy, k, (xb - xa) * (py - ya) - (yb - ya) * (px - xa) AS gap, (xb - xa) * dy - (yb - ya) * dx AS by_ FROM side_, edge),
within AS (SELECT cx, cy, k, greatest(0, max(CASE WHEN by_ > 0 THEN -gap / by_ WHEN by_ = 0 AND gap < 0 THEN 2 END)) AS lo, least(1, min(CASE WHEN by_ < 0 THEN -gap / by_ END)) AS hi FROM half GROUP BY ALL),
around AS (SELECT cx, cy, sum(p) AS p FROM (SELECT cx, cy, greatest(hi - lo, 0) * d AS p FROM cut UNION ALL SELECT cx, cy, greatest(hi - lo, 0) * 8000 FROM within) GROUP BY ALL)
SELECT chunk_order, coalesce(poi_count, 0) AS poi_count, round((a + p * 1000 + pi() * 1e6) / 1e6, 6) AS area_km2 FROM chunk JOIN around USING (cx, cy) LEFT JOIN poi_of USING (cx, cy)"""


@query("r4_buffered_area", R4)
def _(t):
    chunks = grid.core_chunks(boundary(t, False), 8000.0).join(in_tiles(t), ["cx", "cy"], "left")
    return chunks.select("chunk_order", F.coalesce("poi_count", F.lit(0)).alias("poi_count"), F.round(geo.grown_area("shape", 1000.0) / 1e6, 6).alias("area_km2"))


#: Both legs of a bent road cut to each tile; they make one piece if the bend is inside.
G11 = """WITH bent AS (SELECT road_id, x1 AS ax, y1 AS ay, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 + (road_id % 5 - 2) * 900 AS my, x2 AS bx, y2 AS by_ FROM $road),
leg AS (SELECT road_id, 1 AS leg, ax AS x1, ay AS y1, mx AS x2, my AS y2 FROM bent UNION ALL SELECT road_id, 2, mx, my, bx, by_ FROM bent),
tile AS (SELECT i * 5 + j AS tile_id, i * 8000.0::DOUBLE AS x0, j * 8000.0::DOUBLE AS y0 FROM range(0, 5) a(i), range(0, 5) b(j)),
slab AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM leg, tile WHERE x1 <> x2 OR y1 <> y2),
cut AS (SELECT road_id, leg, tile_id, x1, y1, dx, dy,
    greatest(0, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN x0 AND x0 + 8000 THEN 0 ELSE 2 END ELSE least((x0 - x1) / dx, (x0 + 8000 - x1) / dx) END,
      CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN y0 AND y0 + 8000 THEN 0 ELSE 2 END ELSE least((y0 - y1) / dy, (y0 + 8000 - y1) / dy) END) AS lo,
    least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((x0 - x1) / dx, (x0 + 8000 - x1) / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest((y0 - y1) / dy, (y0 + 8000 - y1) / dy) END) AS hi FROM slab),
held AS (SELECT *, (hi - lo) * sqrt(dx * dx + dy * dy) AS m FROM cut WHERE hi > lo),
joined AS (SELECT coalesce(a.road_id, b.road_id) AS road_id, coalesce(a.tile_id, b.tile_id) AS tile_id, a.m AS m1, b.m AS m2, coalesce(a.hi = 1 AND b.lo = 0, false) AS one,
    a.x1 + a.lo * a.dx AS ax, a.x1 + a.hi * a.dx AS ax2, b.x1 + b.lo * b.dx AS bx, b.x1 + b.hi * b.dx AS bx2
  FROM (SELECT * FROM held WHERE leg = 1) a FULL JOIN (SELECT * FROM held WHERE leg = 2) b ON a.road_id = b.road_id AND a.tile_id = b.tile_id),
piece AS (
  SELECT road_id, tile_id, 0 AS piece, 3 AS corners, ax AS from_x, bx2 AS to_x, m1 + m2 AS m FROM joined WHERE one
  UNION ALL SELECT road_id, tile_id, 0, 2, ax, ax2, m1 FROM joined WHERE NOT one AND m1 IS NOT NULL
  UNION ALL SELECT road_id, tile_id, CASE WHEN m1 IS NULL THEN 0 ELSE 1 END, 2, bx, bx2, m2 FROM joined WHERE NOT one AND m2 IS NOT NULL)
SELECT road_id, tile_id, piece, corners, round(from_x, 3) AS from_x, round(to_x, 3) AS to_x, round(m, 3) AS length_m FROM piece"""


@query("g11_clip_to_tiles", G11)
def _(t):
    tiles = t.spark.range(25).select(F.col("id").alias("tile_id"), F.floor(F.col("id") / 5).alias("cx"), (F.col("id") % 5).alias("cy"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    bend = ((x1 + x2) / 2, (y1 + y2) / 2 + (F.col("road_id") % 5 - 2) * 900)
    roads = t("road").select("road_id", geo.ring_of((x1, y1), bend, (x2, y2)).alias("points"))
    cut = joins.polylines_in_tiles(roads, tiles, 8000.0)
    ends = {k: F.round(F.element_at("points", at)["x"], 3).alias(k) for k, at in (("from_x", 1), ("to_x", -1))}
    return cut.select("road_id", "tile_id", "piece", F.size("points").alias("corners"), *ends.values(), F.round("length_m", 3).alias("length_m"))
