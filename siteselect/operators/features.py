"""Per-cell features from roads, parking, stations, population pixels and activity points; cleaning of object tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.functions import clean, geo
from siteselect.operators import joins, ranks
from siteselect.operators.scratch import dealt, keep


def road_features(segments: DataFrame, grid: DataFrame, size: float = 500.0) -> DataFrame:
    """One row for each cell: road length and distinct segments, the same for main roads, and km of road by km2; 0 where there is none."""
    met = joins.lines_in_cells(segments, grid, size)
    main = F.col("is_main")
    each = met.groupBy("grid_id", "road_id").agg(F.sum("length_m").alias("all_m"), F.sum(F.when(main, F.col("length_m"))).alias("main_m"), F.max(F.coalesce(main, F.lit(False)).cast("int")).alias("main"))
    sums = each.groupBy("grid_id").agg(F.sum("all_m").alias("road_length_m"), F.count("road_id").alias("road_segment_count"), F.sum("main_m").alias("main_road_length_m"), F.sum(F.when(F.col("road_id").isNotNull(), F.col("main"))).alias("main_road_segment_count"))
    out = grid.select("grid_id", "cell_area_m2").join(sums, "grid_id", "left")
    out = out.select("grid_id", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("road_length_m", "main_road_length_m")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("road_segment_count", "main_road_segment_count")], "cell_area_m2")
    return out.withColumn("road_density_km_per_km2", F.round(F.col("road_length_m") / 1000 / (F.col("cell_area_m2") / 1e6), 4)).drop("cell_area_m2")


def parking_local(parking: DataFrame, grid: DataFrame, size: float = 500.0) -> DataFrame:
    """Distinct objects, known capacity and records with a capacity for each cell; points are (point_id, x, y, capacity)."""
    met = joins.point_in_cell(parking, grid, size)
    sums = met.groupBy("grid_id").agg(F.countDistinct("point_id").alias("parking_count"), F.sum("capacity").alias("capacity_sum"), F.count("capacity").alias("capacity_records"))
    return grid.select("grid_id").join(sums, "grid_id", "left").select("grid_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("parking_count", "capacity_sum", "capacity_records")])


def _swept(edges: np.ndarray, owner: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Area in a box of the union of polygons, each given by all its edges: slabs between all corners, crossings and places where an edge leaves the box; within one,
    spans end on straight lines, so the middle length times the height is exact."""
    x0, y0, x1, y1 = box
    near = (np.minimum(edges[:, 1], edges[:, 3]) < y1) & (np.maximum(edges[:, 1], edges[:, 3]) > y0)
    edges, owner = edges[near], owner[near]
    d = edges[:, 2:] - edges[:, :2]
    ys = [np.array([y0, y1]), edges[:, 1], edges[:, 3]]
    slanted = d[:, 0] != 0
    for side in (x0, x1):
        ys.append(edges[slanted, 1] + (side - edges[slanted, 0]) * d[slanted, 1] / d[slanted, 0])
    for n in range(0, len(edges), 256):
        a, da = edges[n : n + 256, None, :2], d[n : n + 256, None]
        cross = da[..., 0] * d[None, :, 1] - da[..., 1] * d[None, :, 0]
        gap = edges[None, :, :2] - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / cross
            u = (gap[..., 0] * da[..., 1] - gap[..., 1] * da[..., 0]) / cross
        i, j = np.nonzero((cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
        ys.append(edges[n + i, 1] + t[i, j] * d[n + i, 1])
    levels = np.unique(np.concatenate(ys))
    levels = levels[(levels >= y0) & (levels <= y1)]
    steep = d[:, 1] != 0
    edges, owner, d = edges[steep], owner[steep], d[steep]
    if not len(edges):
        return 0.0
    same = owner[:, None] == owner[None, :]
    first = np.arange(len(edges))[:, None] > np.arange(len(edges))[None, :]
    total, at_once = 0.0, max(1, 2_000_000 // len(edges) ** 2)
    for n in range(0, len(levels) - 1, at_once):
        low, high = levels[n : n + at_once + 1][:-1], levels[n : n + at_once + 1][1:]
        mid = ((low + high) / 2)[:, None]
        on = (edges[:, 1] > mid) != (edges[:, 3] > mid)
        x = edges[:, 0] + (mid - edges[:, 1]) * d[:, 0] / d[:, 1]
        before = (x[:, None, :] < x[:, :, None]) | ((x[:, None, :] == x[:, :, None]) & first)
        opens = ((before & same & on[:, None, :]).sum(axis=2) % 2) == 0
        step = np.where(on, np.where(opens, 1, -1), 0)
        x = np.where(on, np.clip(x, x0, x1), x1)
        # where spans touch, those that begin come first, so that none is open twice or closed early
        order = np.lexsort((-step, x), axis=1)
        x, depth = np.take_along_axis(x, order, axis=1), np.cumsum(np.take_along_axis(step, order, axis=1), axis=1)
        total += float((((x[:, 1:] - x[:, :-1]) * (depth[:, :-1] > 0)).sum(axis=1) * (high - low)).sum())
    return total


#: Polygons whose edges meet a box before it is swept, and how often a box is cut in two at most for having more.
SWEPT, HALVINGS = 8, 24


def _union_in_box(edges: np.ndarray, owner: np.ndarray, box: tuple[float, float, float, float], halvings: int) -> float:
    """Area in a box of the union of polygons. One that has no edge in the box covers it or is not there; what has is swept if it is little, else
    the box is cut in two at the middle one of the corners in it, so that sides which many polygons share fall on a box's side."""
    x0, y0, x1, y1 = box
    meets = (np.minimum(edges[:, 0], edges[:, 2]) < x1) & (np.maximum(edges[:, 0], edges[:, 2]) > x0) & (np.minimum(edges[:, 1], edges[:, 3]) < y1) & (np.maximum(edges[:, 1], edges[:, 3]) > y0)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    dx, dy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    meets &= np.abs(dx * (cy - edges[:, 1]) - dy * (cx - edges[:, 0])) <= (np.abs(dx) * (y1 - y0) + np.abs(dy) * (x1 - x0)) * (0.5 + 1e-9)
    size = int(owner.max()) + 1 if len(owner) else 0
    inside_box = np.bincount(owner[meets], minlength=size) > 0
    up = np.flatnonzero((edges[:, 1] > cy) != (edges[:, 3] > cy))
    e = edges[up]
    right = cx < e[:, 0] + (cy - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    odd = np.bincount(owner[up[right]], minlength=size) % 2 == 1
    if (odd & ~inside_box).any():
        return (x1 - x0) * (y1 - y0)
    count = int(inside_box.sum())
    if not count:
        return 0.0
    held = inside_box[owner]
    edges, owner = edges[held], (np.cumsum(inside_box) - 1)[owner[held]]
    if count <= SWEPT or not halvings:
        return _swept(edges, owner, box)
    near = edges[meets[held]]
    xs, ys = near[:, [0, 2]].ravel(), near[:, [1, 3]].ravel()
    xs, ys = xs[(xs > x0) & (xs < x1)], ys[(ys > y0) & (ys < y1)]
    across = len(xs) > len(ys) if len(xs) != len(ys) else x1 - x0 >= y1 - y0
    corners = xs if across else ys
    cut = float(np.partition(corners, len(corners) // 2)[len(corners) // 2]) if len(corners) else cx if across else cy
    halves = ((x0, y0, cut, y1), (cut, y0, x1, y1)) if across else ((x0, y0, x1, cut), (x0, cut, x1, y1))
    return sum(_union_in_box(edges, owner, part, halvings - 1) for part in halves)


def polygon_union_area(rings: Sequence[np.ndarray], owners: Sequence[int] | None = None) -> float:
    """Area of a union of polygons. Rings of one owner are one polygon, a ring inside another a hole; without owners each ring is one."""
    edges = np.concatenate([np.concatenate((r, np.roll(r, -1, axis=0)), axis=1) for r in rings]).astype(float)
    each = np.arange(len(rings)) if owners is None else np.unique(np.asarray(owners), return_inverse=True)[1]
    owner = np.repeat(each, [len(r) for r in rings])
    low, high = edges[:, :2].min(axis=0), edges[:, :2].max(axis=0)
    return _union_in_box(edges, owner, (float(low[0]), float(low[1]), float(high[0]), float(high[1])), HALVINGS)


#: A cell with more pieces than this is cut finer, into as many parts as leave each about that many.
CROWDED = 2048


def union_area_in_cells(shapes: DataFrame, grid: DataFrame, size: float = 500.0, shape: str = "shape") -> DataFrame:
    """(grid_id, area_m2, area_ratio): ground of a cell that polygons cover, overlaps once and holes not at all; the ratio to 6 digits.

    Each cell's pieces are one group, cut in two again and again until a part is covered by one of them or few have edges there. Equal pieces count once, a piece that
    covers its cell stands for all of them, and a cell with more than CROWDED pieces is cut into finer ones first, so that groups stay small where objects lie close
    together; only what lies on one spot stays together.
    """
    met = joins.shapes_in_cells(shapes.select(shape), grid, size, shape).select("grid_id", "cx", "cy", "piece", "area_m2").distinct()
    met = keep(met)
    cells = met.groupBy("grid_id").agg(F.count("*").alias("n"), F.max("area_m2").alias("most"))
    full = F.col("most") >= size * size * (1 - 1e-12)
    whole = cells.where(full).select("grid_id", F.lit(float(size * size)).alias("area_m2"))
    halved = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CROWDED) / 2))
    open_ = met.drop("area_m2").join(cells.where(~full).select("grid_id", F.pow(F.lit(2.0), halved).cast("long").alias("parts")), "grid_id")
    side, parts = F.lit(float(size)) / F.col("parts"), F.col("parts")
    spans = [F.explode(F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(geo.cells_along("piece", along, side, F.col(c) * size, F.lit(0).cast("long"), parts - 1))) for along, c in (("x", "cx"), ("y", "cy"))]
    finer = open_.withColumn("i", spans[0]).withColumn("j", spans[1])
    x, y = F.col("cx") * size + F.col("i") * side, F.col("cy") * size + F.col("j") * side
    part = F.when(parts == 1, F.col("piece")).otherwise(geo.clip_shape("piece", x, y, x + side, y + side))
    groups = dealt(finer.select("grid_id", "i", "j", part.alias("piece")).distinct().where(F.size("piece") > 0), "grid_id", "i", "j")

    def run(table: pa.Table) -> pa.Table:
        pieces = table.column("piece").combine_chunks()
        ring = pieces.flatten().field("ring")
        places = np.stack([ring.flatten().field(c).to_numpy() for c in ("x", "y")], axis=1)
        rings = np.split(places, np.cumsum(pc.list_value_length(ring).to_numpy())[:-1])
        owners = np.repeat(np.arange(len(pieces)), pc.list_value_length(pieces).to_numpy())
        return pa.table({"grid_id": table.column("grid_id")[:1], "area_m2": [polygon_union_area(rings, owners)]})

    swept = groups.groupBy("grid_id", "i", "j").applyInArrow(run, "grid_id string, area_m2 double").groupBy("grid_id").agg(F.sum("area_m2").alias("area_m2"))
    out = grid.select("grid_id", "cell_area_m2").join(whole.unionByName(swept), "grid_id", "left").withColumn("area_m2", F.coalesce("area_m2", F.lit(0.0)))
    return out.select("grid_id", "area_m2", F.round(F.col("area_m2") / F.col("cell_area_m2"), 6).alias("area_ratio"))


#: Points a square of a quarter of the smallest radius holds on average before squares are counted instead of points.
DENSE = 8


def _hits(counts: Mapping[str, tuple[float, Column | None]]) -> list[Column]:
    """1 for a point that a count takes, wherever it is; 0 otherwise."""
    return [(F.lit(1) if c is None else F.coalesce(c, F.lit(False)).cast("int")).alias(f"_is_{k}") for k, (_, c) in counts.items()]


def _counted_squares(centres: DataFrame, points: DataFrame, counts: Mapping[str, float], side: float, quarter: int | None) -> DataFrame:
    """(centre_id, counts...), rows repeat: points are counted in squares, with the box they fill there. A box inside a circle adds its counts, and
    only points of boxes that the circle's rim crosses are met one by one."""
    widest = max(counts.values())
    sx, sy = geo.cell_index("x", "y", side)
    points = points.withColumns({"sx": sx, "sy": sy})
    boxes = points.groupBy("sx", "sy").agg(*[f(c).alias(f"{k}{c}") for c in ("x", "y") for k, f in (("a", F.min), ("b", F.max))], *[F.sum(f"_is_{k}").alias(f"_n_{k}") for k in counts])
    span = lambda c: F.sequence(F.floor((F.col(f"a{c}") - widest) / widest), F.floor((F.col(f"b{c}") + widest) / widest))
    around = boxes.withColumn("kx", F.explode(span("x"))).withColumn("ky", F.explode(span("y")))
    kx, ky = geo.cell_index("x", "y", widest)
    met = centres.withColumns({"kx": kx, "ky": ky}).join(around, ["kx", "ky"])
    near = [F.greatest(F.col(f"a{c}") - F.col(c), F.col(c) - F.col(f"b{c}"), F.lit(0.0)) for c in ("x", "y")]
    far = [F.greatest(F.abs(F.col(f"a{c}") - F.col(c)), F.abs(F.col(f"b{c}") - F.col(c))) for c in ("x", "y")]
    met = met.withColumns({"_near": near[0] * near[0] + near[1] * near[1], "_far": far[0] * far[0] + far[1] * far[1]}).where(F.col("_near") <= widest * widest)
    inner = lambda r: r * r * (1 if quarter is None else math.cos(math.pi / (4 * quarter)) ** 2 * (1 - 1e-12))
    whole = met.groupBy("centre_id").agg(*[F.coalesce(F.sum(F.when(F.col("_far") <= inner(r), F.col(f"_n_{k}"))), F.lit(0)).alias(k) for k, r in counts.items()])
    rim = {k: (F.col("_near") <= r * r) & (F.col("_far") > inner(r)) for k, r in counts.items()}
    some = met.select("centre_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "sx", "sy", *[c.alias(f"_rim_{k}") for k, c in rim.items()]).where(" or ".join(f"_rim_{k}" for k in counts))
    pairs = some.join(points, ["sx", "sy"])
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    taken = {k: F.col(f"_rim_{k}") & joins.inside_circle(dx, dy, r, quarter) for k, r in counts.items()}
    each = pairs.groupBy("centre_id").agg(*[F.sum(F.when(c, F.col(f"_is_{k}")).otherwise(0)).alias(k) for k, c in taken.items()])
    return whole.unionByName(each)


def radius_counts(centres: DataFrame, points: DataFrame, counts: Mapping[str, tuple[float, Column | None]], cols: Sequence[str] = (), quarter: int | None = None) -> DataFrame:
    """One pass for all radii and flags: counts are {name: (radius, condition on the point or None)}; distinct points within the radius.

    With `quarter`, circles are polygons of so many segments in each quarter. Points without id or coordinates are not counted; a point that stands in several
    places counts once for each centre. Ids of one place, as a rule all, are added up without their pairs leaving the join: where they are few, point by point at each centre,
    where they lie close (DENSE), by squares. Only ids of several places are grouped by centre and id.
    """
    radii = {k: r for k, (r, _) in counts.items()}
    flags = [f"_is_{k}" for k in counts]
    rows = keep(points.where("point_id is not null and x is not null and y is not null").select("point_id", "x", "y", *_hits(counts)).distinct())
    several = keep(rows.groupBy("point_id").agg((F.count("*") > 1).alias("several")).where("several").select("point_id"))
    lone, again = rows.join(several, "point_id", "left_anti"), rows.join(several, "point_id", "left_semi")
    hit = lambda k: F.when(joins.inside_circle(F.col("x") - F.col("px"), F.col("y") - F.col("py"), radii[k], quarter), F.col(f"_is_{k}")).otherwise(0)
    met = lambda of: joins.within_radius(centres.select("centre_id", "x", "y"), of, max(radii.values()), flags, place=True)
    side = min(radii.values()) / 4
    sx, sy = geo.cell_index("x", "y", side)
    sizes = rows.groupBy(sx.alias("sx"), sy.alias("sy")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("squares")).first()
    if sizes["n"] and sizes["n"] >= DENSE * sizes["squares"]:
        once = _counted_squares(centres.select("centre_id", "x", "y"), lone, radii, side, quarter)
    else:
        once = met(lone).groupBy("centre_id").agg(*[F.sum(hit(k)).alias(k) for k in counts])
    each = met(again).groupBy("centre_id", "point_id").agg(*[F.max(hit(k)).alias(k) for k in counts])
    sums = once.unionByName(each.drop("point_id")).groupBy("centre_id").agg(*[F.sum(k).alias(k) for k in counts])
    return centres.select("centre_id").join(sums, "centre_id", "left").select("centre_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in counts])


def charging_features(grid: DataFrame, stations: DataFrame, size: float = 500.0) -> DataFrame:
    """Local station count and flag, nearest station, counts in 1 and 2 km and of AC and DC ones in 1 km, from the cells' centres."""
    centres = grid.select(F.col("grid_id").alias("centre_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    local = joins.point_in_cell(stations.select("point_id", "x", "y"), grid, size).groupBy("grid_id").agg(F.countDistinct("point_id").alias("station_count"))
    around = radius_counts(centres, stations, {"within_1000m": (1000.0, None), "within_2000m": (2000.0, None), "ac_within_1000m": (1000.0, F.col("has_ac")), "dc_within_1000m": (1000.0, F.col("has_dc"))}, ["has_ac", "has_dc"])
    near = joins.nearest(centres, stations).select("centre_id", F.col("point_id").alias("nearest_id"), F.round("distance", 4).alias("nearest_m"))
    out = around.join(near, "centre_id").withColumnRenamed("centre_id", "grid_id").join(local, "grid_id", "left")
    return out.withColumn("station_count", F.coalesce("station_count", F.lit(0))).withColumn("has_station", (F.col("station_count") > 0).cast("int"))


def local_categories(points: DataFrame, grid: DataFrame, flags: Sequence[str], size: float = 500.0) -> DataFrame:
    met = joins.point_in_cell(points.select("point_id", "x", "y", *flags), grid, size)
    each = met.where("point_id is not null").groupBy("grid_id", "point_id").agg(F.count("*").alias("_times"), *[F.max(F.coalesce(F.col(f), F.lit(False)).cast("int")).alias(f"{f}_count") for f in flags])
    sums = each.groupBy("grid_id").agg(F.count("point_id").alias("poi_count"), *[F.sum(f"{f}_count").alias(f"{f}_count") for f in flags])
    names = ["poi_count", *[f"{f}_count" for f in flags]]
    return grid.select("grid_id").join(sums, "grid_id", "left").select("grid_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def row_spans(boundary: DataFrame, pixel: float, shape: str = "shape") -> DataFrame:
    """(prow, first, last): for each row of pixels the columns whose centres are inside polygons, from where the row's middle line crosses their edges; edges count as inside."""
    low, high = geo.extent(shape, "y")
    rows = boundary.select(shape).withColumn("prow", F.explode(F.when(high > low, F.sequence(F.ceil(low / pixel - 0.5), F.floor(high / pixel - 0.5)))))
    y = (F.col("prow") + 0.5) * pixel
    crossing = F.filter(geo.shape_edges(shape), lambda e: (e["y1"] > y) != (e["y2"] > y))
    cuts = F.array_sort(F.transform(crossing, lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("cuts") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("cuts", 2 * i) / pixel - 0.5).alias("first"), F.floor(F.get("cuts", 2 * i + 1) / pixel - 0.5).alias("last")))
    spans = rows.select("prow", cuts.alias("cuts")).where(F.size("cuts") > 0)
    return spans.select("prow", F.explode(pairs).alias("s")).select("prow", "s.*").where("first <= last")


def masked(pixels: DataFrame, boundary: DataFrame, pixel: float, shape: str = "shape") -> DataFrame:
    """The pixels (prow, pcol, ...) whose centre is inside the boundary's polygons. Pixels meet the spans of their row, not the polygon."""
    spans = row_spans(boundary, pixel, shape).withColumnRenamed("prow", "_prow")
    return pixels.join(spans, (F.col("prow") == F.col("_prow")) & F.col("pcol").between(F.col("first"), F.col("last")), "left_semi")


def regrid(pixels: DataFrame, pixel: float, cell: float) -> DataFrame:
    """(cx, cy, population, density_per_km2): pixel values (prow, pcol, value) dealt to the cells they overlap by the share of their area; the sum stays."""
    x0, y0 = F.col("pcol") * pixel, F.col("prow") * pixel
    span = lambda a: F.sequence(F.floor(a / cell), F.ceil((a + pixel) / cell) - 1)
    keyed = pixels.withColumn("cx", F.explode(span(x0))).withColumn("cy", F.explode(span(y0)))
    share = lambda a, k: (F.least(a + pixel, (F.col(k) + 1) * cell) - F.greatest(a, F.col(k) * cell)) / pixel
    return keyed.groupBy("cx", "cy").agg(F.sum(F.col("value") * share(x0, "cx") * share(y0, "cy")).alias("population")).withColumn("density_per_km2", F.col("population") / (cell * cell / 1e6))


def circular_offsets(radius: float, cell: float) -> list[tuple[int, int]]:
    """Cells whose centre is within the radius of the middle one's centre."""
    k = int(radius // cell)
    return [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if (dx * dx + dy * dy) * cell * cell <= radius * radius]


def focal_sum(cells: DataFrame, value: str, radius: float, cell: float, out: str) -> DataFrame:
    """(cx, cy, out) for the cells given: the sum over the circular kernel; what is not in the table counts 0. Sums meet in a map-side combine."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in circular_offsets(radius, cell)]))
    moved = cells.select("cx", "cy", value, offsets.alias("o")).groupBy((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).agg(F.sum(value).alias(out))
    return cells.select("cx", "cy").join(moved, ["cx", "cy"])


def mass_report(before: DataFrame, after: DataFrame, a: str, b: str) -> DataFrame:
    one, two = before.agg(F.sum(a).alias("before")), after.agg(F.sum(b).alias("after"))
    return one.join(two, F.lit(True)).select("before", "after", (F.col("after") - F.col("before")).alias("difference"), ((F.col("after") - F.col("before")) / F.col("before") * 100).alias("relative_percent"))


def sockets_by_station(sockets: DataFrame) -> DataFrame:
    """Distinct sockets, AC and DC ones, known powers, their sum and maximum, and the current types in the order of the socket numbers."""
    kind = lambda k: F.sum((F.col("current") == k).cast("long"))
    return sockets.groupBy("station_id").agg(
        F.countDistinct("socket_id").alias("socket_count"), kind("AC").alias("ac_count"), kind("DC").alias("dc_count"), F.count("power").alias("known_power_count"),
        F.sum("power").alias("total_power_kw"), F.max("power").alias("max_power_kw"), clean.unique_text("socket_id", "current").alias("current_types"),
    ).withColumns({"has_ac": F.col("ac_count") > 0, "has_dc": F.col("dc_count") > 0})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first by order (make it total)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def forward_fill(df: DataFrame, by: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Nulls take the last value above them in the report `by`, whose rows `order` numbers."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def largest_objects(pieces: DataFrame) -> DataFrame:
    """Of an object's pieces the one with the largest measure, then the lowest chunk; with the number of pieces and of distinct measures."""
    stats = pieces.groupBy("object_id").agg(F.count("*").alias("occurrences"), F.countDistinct("measure").alias("variants"))
    return first_rows(pieces, ["object_id"], [F.desc("measure"), "chunk_order", "piece_id"]).join(stats, "object_id")


def distribution(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each column: rows, zeros, nonzeros and their share, mean, percentiles 50, 90, 95 and 99 (linear between ranks), maximum."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "feature", "v")
    v, keys = F.col("v"), [*by, "feature"]
    own = long.groupBy(*keys).agg(F.count(v).alias("n"), F.sum((v == 0).cast("long")).alias("zeros"), F.sum((v != 0).cast("long")).alias("nonzeros"), F.avg((v != 0).cast("double")).alias("nonzero_fraction"), F.avg(v).alias("mean"))
    found = ranks.quantiles(long, "v", {**{f"p{p}": p / 100 for p in (50, 90, 95, 99)}, "max": 1.0}, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [own[k].eqNullSafe(found[f"_{k}"]) for k in keys]
    return own.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def station_dataset(stations: DataFrame, sockets: DataFrame, columns: Sequence[str] = ("socket_count", "total_power_kw")) -> DataFrame:
    """Stations (station_id, ...) with sums of their sockets, 0 for those without; counts are whole numbers."""
    joined = stations.join(sockets_by_station(sockets).select("station_id", *columns), "station_id", "left").fillna(0, list(columns))
    return joined.withColumns({c: F.col(c).cast("int") for c in columns if c.endswith("_count")})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n): how many rows have each value, null included."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
