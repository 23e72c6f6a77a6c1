"""Spatial joins by cell keys, and keyed joins that check their cardinality."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.functions import geo
from siteselect.operators.scratch import dealt, keep


def point_in_cell(points: DataFrame, grid: DataFrame, size: float = 500.0) -> DataFrame:
    """points with the grid_id of their place; a point on a shared edge belongs to the lowest grid_id, if that cell exists. Equal rows stay as many as they are. A column grid_id
    that the points have gives way; points without coordinates are in no cell.

    Points ask for their own cell by an equi-join on the cell's index. Only those on an edge ask for the lower neighbours too and are grouped, with their number.
    """
    cx, cy = geo.cell_index("x", "y", size)
    columns = [c for c in points.columns if c != "grid_id"]
    points = points.select(*columns)
    cells = grid.select("grid_id", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
    on_edge = (F.col("x") == cx * size) | (F.col("y") == cy * size)
    at = (F.col("_kx") == F.col("_cx")) & (F.col("_ky") == F.col("_cy"))
    keys = ("_kx", "_ky", "_cx", "_cy")
    inside = points.where(~on_edge).withColumns({"_kx": cx, "_ky": cy}).join(cells, at).drop(*keys)
    near = lambda v, c: F.when(v == c * size, F.array(c - 1, c)).otherwise(F.array(c))
    edge = points.where(on_edge).groupBy(*columns).agg(F.count("*").alias("_times"))
    asks = edge.withColumn("_kx", F.explode(near(F.col("x"), cx))).withColumn("_ky", F.explode(near(F.col("y"), cy)))
    lowest = asks.join(cells, at).groupBy(*columns, "_times").agg(F.min("grid_id").alias("grid_id"))
    again = lowest.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_times")
    return inside.select(*columns, "grid_id").unionByName(again.select(*columns, "grid_id"))


#: A cut of a segment with the side of a cell may be rounded by so much, in the plane's unit; far more than doubles err by at plane coordinates.
_CUT = 1e-6


def _crossed(segments: DataFrame, size: float) -> DataFrame:
    """segments with each cell (cx, cy) that they may cross; of each column of cells those that the segment's part in it spans, give or take what its cut is rounded by."""
    span = lambda a, b: F.sequence(F.ceil(F.least(a, b) / size) - 1, F.floor(F.greatest(a, b) / size))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cut = lambda x: y1 + (F.greatest(F.least(x, F.greatest(x1, x2)), F.least(x1, x2)) - x1) * F.when(x2 == x1, 0.0).otherwise((y2 - y1) / (x2 - x1))
    low, high = cut(F.col("cx") * size), cut((F.col("cx") + 1) * size)
    part = lambda a, b: F.sequence(F.greatest(F.ceil(F.least(y1, y2) / size), F.ceil((F.least(a, b) - _CUT) / size)) - 1, F.least(F.floor(F.greatest(y1, y2) / size), F.floor((F.greatest(a, b) + _CUT) / size)))
    ys = F.when(x1 == x2, span("y1", "y2")).otherwise(part(low, high))
    return segments.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(ys))


def lines_in_cells(segments: DataFrame, grid: DataFrame, size: float = 500.0) -> DataFrame:
    """segments (x1, y1, x2, y2) with each cell that they cross and the length inside (above 0). Cells are closed: a segment on a shared edge counts in both."""
    met = _crossed(segments, size).join(grid.select("grid_id", "cx", "cy"), ["cx", "cy"])
    length = geo.clipped_length("x1", "y1", "x2", "y2", F.col("cx") * size, F.col("cy") * size, (F.col("cx") + 1) * size, (F.col("cy") + 1) * size)
    return met.withColumn("length_m", length).where("length_m > 0")


def shape_pieces(shapes: DataFrame, size: float, shape: str = "shape") -> DataFrame:
    """shapes with each cell (cx, cy) that they overlap by an area, their part in it as `piece`, and its area_m2.

    A shape is cut into the columns of cells that it spans, each part's own height then names its cells, so that a long slanting shape does not visit
    all cells of its box. What lies in one column or cell is not cut. Null and empty shapes and those without an area have no pieces.
    """
    strip = lambda of, cx: F.struct(cx.alias("cx"), geo.clip_shape(of, x0=cx * size, x1=(cx + 1) * size).alias("piece"))
    piece = lambda of, cy: F.struct(cy.alias("cy"), of.alias("piece"), geo.shape_area(of).alias("area_m2"))
    cut = lambda of, cy: geo.let(geo.clip_shape(of, y0=cy * size, y1=(cy + 1) * size), lambda q: piece(q, cy))
    columns = lambda of: geo.let(geo.cells_along(of, "x", size), lambda n: F.when(F.size(n) == 1, F.array(F.struct(n[0].alias("cx"), of.alias("piece")))).otherwise(F.transform(n, lambda cx: strip(of, cx))))
    rows = lambda of: geo.let(geo.cells_along(of, "y", size), lambda n: F.when(F.size(n) == 1, F.array(piece(of, n[0]))).otherwise(F.transform(n, lambda cy: cut(of, cy))))
    strips = dealt(shapes).withColumn("_strip", F.explode(geo.let(F.col(shape), columns)))
    pieces = strips.withColumn("_piece", F.explode(geo.let(F.col("_strip.piece"), rows))).where("_piece.area_m2 > 0")
    own = [c for c in shapes.columns if c not in ("cx", "cy", "piece", "area_m2")]
    return pieces.select(*own, "_strip.cx", "_piece.cy", "_piece.piece", "_piece.area_m2")


def shapes_in_cells(shapes: DataFrame, grid: DataFrame, size: float = 500.0, shape: str = "shape") -> DataFrame:
    """shapes with the grid_id of each cell that they overlap, their `piece` in it and its area_m2."""
    return shape_pieces(shapes, size, shape).join(grid.select("grid_id", "cx", "cy"), ["cx", "cy"])


def polylines_in_tiles(lines: DataFrame, tiles: DataFrame, size: float, points: str = "points") -> DataFrame:
    """lines with tile_id, piece (from 0 along the line), the piece's points and length_m: what each tile (tile_id, cx, cy) cuts out of each line.

    Tiles are closed, so that a piece on a shared side counts in both. Lines need not have a key: each row asks for the tiles that its segments may cross, once.
    """
    span = lambda a, b: F.sequence(F.ceil(F.least(a, b) / size) - 1, F.floor(F.greatest(a, b) / size))
    pairs = lambda s: F.flatten(F.transform(span(s["x1"], s["x2"]), lambda cx: F.transform(span(s["y1"], s["y2"]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    asked = lines.withColumn("_at", F.explode(F.array_distinct(F.flatten(F.transform(geo.segments_of(points), pairs)))))
    met = asked.withColumns({"cx": F.col("_at.cx"), "cy": F.col("_at.cy")}).drop("_at").join(tiles.select("tile_id", "cx", "cy"), ["cx", "cy"])
    cut = geo.clip_polyline(points, F.col("cx") * size, F.col("cy") * size, (F.col("cx") + 1) * size, (F.col("cy") + 1) * size)
    columns = [c for c in lines.columns if c != points]
    out = met.select(*columns, "tile_id", F.posexplode(cut).alias("piece", points))
    return out.withColumn("length_m", geo.polyline_length(points))


def inside_circle(dx: Column, dy: Column, radius: float, quarter: int | None = None) -> Column:
    """Whether an offset is within a radius; with `quarter`, within the regular polygon that has so many segments in each quarter and its corners on the circle, the first to the right."""
    if quarter is None:
        return dx * dx + dy * dy <= radius * radius
    half = math.pi / (4 * quarter)
    return F.sqrt(dx * dx + dy * dy) * F.cos(F.pmod(F.atan2(dy, dx), F.lit(2 * half)) - half) <= radius * math.cos(half)


def within_radius(centres: DataFrame, points: DataFrame, radius: float, cols: Sequence[str] = (), place: bool = False) -> DataFrame:
    """(centre columns, point_id, cols, d2): pairs at a distance up to the radius, the exact circle; with `place` also px and py.

    Centres are (centre_id, x, y), points (point_id, x, y). Points go to the nine squares of side `radius` round them, so that each pair meets once.
    """
    cx, cy = geo.cell_index("x", "y", radius)
    left = centres.withColumns({"kx": cx, "ky": cy})
    around = points.select("point_id", *cols, F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(cx - 1, cx + 1)).alias("kx"), cy.alias("_cy"))
    around = around.withColumn("ky", F.explode(F.sequence(F.col("_cy") - 1, F.col("_cy") + 1))).drop("_cy")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return left.join(around, ["kx", "ky"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).drop("kx", "ky", *(() if place else ("px", "py")))


def _nearest_places(centres: DataFrame, points: DataFrame, start: float | None = None, rounds: int = 40, max_distance: float | None = None) -> DataFrame:
    """(x, y, point_id, distance): the nearest point of each place of the centres; no row for a place without one.

    Centres and points of one place are taken together. A round asks twice: for the shortest distance, a number that pairs are added up to without being sorted, and for
    the points at it.
    """
    places = keep(dealt(points.where("x is not null and y is not null").select("point_id", "x", "y"), "x", "y").groupBy("x", "y").agg(F.min("point_id").alias("point_id")))
    box = places.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in ("x", "y") for k, f in (("a", F.min), ("b", F.max))]).first()
    if not box["n"]:
        return places.withColumn("distance", F.lit(None).cast("double"))
    spacing = math.sqrt((box["bx"] - box["ax"]) * (box["by"] - box["ay"]) / box["n"])
    size = max(spacing, start or 0.0) or 1.0
    found, open_ = None, keep(dealt(centres.where("x is not null and y is not null").select("x", "y"), "x", "y").distinct())
    for _ in range(rounds):
        bounds = keep(within_radius(open_, places, size).groupBy("x", "y").agg(F.min("d2").alias("bound")))
        met = within_radius(bounds, places, size).where("d2 <= bound")
        done = keep(met.groupBy("x", "y").agg(F.min("point_id").alias("point_id"), F.sqrt(F.min("d2")).alias("distance")))
        found = done if found is None else found.unionByName(done)
        open_ = keep(open_.join(done.select("x", "y"), ["x", "y"], "left_anti"))
        size *= 2
        if open_.isEmpty() or (max_distance and size > 2 * max_distance):
            return found
    raise RuntimeError(f"centres without a nearest point after {rounds} rounds")


def nearest(centres: DataFrame, points: DataFrame, start: float | None = None, rounds: int = 40, max_distance: float | None = None) -> DataFrame:
    """(centre_id, point_id, distance): the nearest point of each centre, ties to the smallest point_id; null if there are no points or the centre has no
    coordinates. Points without coordinates are passed over.

    Searches squares that double from round to round, from the mean spacing of the points on (or `start`, if that is larger); a centre is done when it has a point
    within the side of the squares. Only those that are not done go on, so that the large squares are asked by few; each round ends in a written table.
    """
    found = _nearest_places(centres, points, start, rounds, max_distance)
    return centres.select("centre_id", "x", "y").join(found, ["x", "y"], "left").select("centre_id", "point_id", "distance")


#: Segments in a cell, and cells of a segment, between which the first cells of a search for lines are chosen.
FULL, CUTS = 64, 8


def nearest_line(centres: DataFrame, segments: DataFrame, start: float = 500.0, rounds: int = 40, digits: int = 6) -> DataFrame:
    """(centre_id, line_id, distance): the nearest segment (line_id, x1, y1, x2, y2) of each centre, ties at so many digits to the smallest line_id; null without segments
    or for a centre without coordinates. Segments without coordinates are passed over.

    A segment stands under the cells that it crosses. A centre asks its own cell how near the nearest there is, a number that pairs are added up to without being sorted, and then
    the cells that a circle so wide touches for the segments that are no farther. Centres whose cell has none go on with cells of four times the side, and ask the eight round theirs, too. Where segments lie close, the first
    cells are smaller than `start`, until they hold FULL segments or cut one of the mean length into about CUTS parts.
    """
    segments = segments.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select("line_id", "x1", "y1", "x2", "y2")
    segments = keep(dealt(segments))
    low, high = (lambda c: F.min(F.least(f"{c}1", f"{c}2"))), (lambda c: F.max(F.greatest(f"{c}1", f"{c}2")))
    extent = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    box = segments.agg(F.count("*").alias("n"), F.avg(extent).alias("extent"), *[(high(c) - low(c)).alias(c) for c in ("x", "y")]).first()
    if not box["n"]:
        return centres.select("centre_id", F.lit(None).cast(segments.schema["line_id"].dataType).alias("line_id"), F.lit(None).cast("double").alias("distance"))
    found, open_, size = None, keep(centres.where("x is not null and y is not null").select("centre_id", "x", "y")), start
    while size > box["extent"] / CUTS and box["n"] * (size + box["extent"]) * size > FULL * box["x"] * box["y"] > 0:
        size /= 2
    distance, reach = F.round(geo.to_segment("x", "y", "x1", "y1", "x2", "y2"), digits), F.col("bound") + 10.0**-digits
    for n in range(rounds):
        lines, (cx, cy), round_ = _crossed(segments, size), geo.cell_index("x", "y", size), min(n, 1)
        first = open_.withColumn("cx", F.explode(F.sequence(cx - round_, cx + round_))).withColumn("cy", F.explode(F.sequence(cy - round_, cy + round_)))
        bounds = keep(first.join(lines, ["cx", "cy"]).groupBy("centre_id").agg(F.min(distance).alias("bound")))
        span = lambda c, size=size: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
        asks = open_.join(bounds, "centre_id").withColumn("cx", span("x")).withColumn("cy", span("y"))
        met = asks.join(lines, ["cx", "cy"]).withColumn("d", distance).where("d <= bound")
        best = met.groupBy("centre_id").agg(F.min(F.struct("d", "line_id")).alias("b"))
        done = keep(best.select("centre_id", F.col("b.line_id").alias("line_id"), F.col("b.d").alias("distance")))
        found = done if found is None else found.unionByName(done)
        open_ = keep(open_.join(done.select("centre_id"), "centre_id", "left_anti"))
        if open_.isEmpty():
            return centres.select("centre_id").join(found, "centre_id", "left")
        size *= 4
    raise RuntimeError(f"centres without a nearest line after {rounds} rounds")


def nearest_shape(centres: DataFrame, shapes: DataFrame, start: float = 500.0, digits: int = 6) -> DataFrame:
    """(centre_id, shape_id, distance): the nearest polygon (shape_id, shape) of each centre, 0 inside or on its edge, ties at so many digits to the smallest shape_id.

    Centres ask the pieces of polygons in their own cell whether they are inside; the others look for the nearest edge. Null without polygons or coordinates.
    """
    cx, cy = geo.cell_index("x", "y", start)
    asks = centres.select("centre_id", "x", "y", cx.alias("cx"), cy.alias("cy"))
    pieces = shape_pieces(shapes.select("shape_id", "shape"), start).select("cx", "cy", "shape_id", "piece")
    within = asks.join(pieces, ["cx", "cy"]).where(geo.in_shape("x", "y", "piece")).groupBy("centre_id").agg(F.min("shape_id").alias("shape_id"))
    within = keep(within.withColumn("distance", F.lit(0.0)))
    edges = shapes.select(F.col("shape_id").alias("line_id"), F.explode(geo.shape_edges("shape")).alias("e")).select("line_id", "e.*")
    near = nearest_line(centres.join(within, "centre_id", "left_anti"), edges, start, digits=digits).withColumnRenamed("line_id", "shape_id")
    return within.unionByName(near)


def compared(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """points (point_id, x, y, ...) with the nearest point of a reference, its distance and whether it is a duplicate: matched_id, distance, duplicate. Nearest at any distance,
    so that near misses can be looked at; null without coordinates or reference, which is no duplicate."""
    near = _nearest_places(points, reference).withColumnRenamed("point_id", "matched_id")
    met = points.join(near, ["x", "y"], "left").select(*points.columns, "matched_id", "distance")
    return met.withColumn("duplicate", F.coalesce(F.col("distance") <= radius, F.lit(False)))


def unmatched(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """The points that no point of the reference is within the radius of."""
    return compared(points, reference, radius).where("not duplicate").select(*points.columns)


def attached(base: DataFrame, context: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """base with context columns for each of its rows: keys are unique on both sides, and a row that would have a null raises when the result is read."""
    out = one_to_one(base, context.select(on, *columns), on, "left")
    for c in columns:
        why = F.concat(F.lit(f"no {c} for "), F.col(on).cast("string"))
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(why).cast(out.schema[c].dataType)))
    return out


def one_to_one(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join whose key must be unique on both sides; a repeated key raises when the result is read."""
    checked = lambda d: d.groupBy(on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in d.columns if c != on]).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {on}: "), F.col(on).cast("string"))).cast("long")).otherwise(1)).where("_n = 1").drop("_n")
    return checked(left).join(checked(right), on, how)


def many_to_one(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """left with right's columns; a key that right repeats raises when the result is read."""
    checked = right.groupBy(on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != on])
    checked = checked.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {on}: "), F.col(on).cast("string"))).cast("long")).otherwise(1)).where("_n = 1").drop("_n")
    return left.join(checked, on, how)


def accepted_matches(decisions: DataFrame, right: DataFrame, key: Column, on: str, decision: str = "decision", prefix: str = "accepted_", bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows whose decision has the prefix, joined to right by a normalised key; rows with coordinates outside the bounds, or without, raise when read."""
    met = decisions.where(F.col(decision).startswith(prefix)).withColumn("_key", key).join(right, F.col("_key") == F.col(on)).drop("_key")
    for c, (low, high) in (bounds or {}).items():
        fine = F.coalesce(F.col(c).between(low, high), F.lit(False))
        met = met.withColumn(c, F.when(fine, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} outside {low:g} to {high:g}")).cast(met.schema[c].dataType)))
    return met


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of the tables, columns by name; those that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_provenance(tables: Mapping[str, DataFrame], column: str = "source") -> DataFrame:
    """The tables concatenated, with the name of each in a column."""
    return concatenated(*[t.withColumn(column, F.lit(name)) for name, t in tables.items()])


def recovery(found: DataFrame, expected: DataFrame, on: str) -> DataFrame:
    """(id, found, expected) for each id of either table."""
    a, b = found.select(on).distinct().withColumn("found", F.lit(True)), expected.select(on).distinct().withColumn("expected", F.lit(True))
    return a.join(b, on, "full_outer").select(on, F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("expected", F.lit(False)).alias("expected"))


def align(tables: dict[str, DataFrame], on: str, same: Sequence[str]) -> DataFrame:
    """Score tables joined on an id; a row where one of `same` differs raises when the result is read."""
    names = list(tables)
    out = tables[names[0]]
    for name in names[1:]:
        other = tables[name].withColumnsRenamed({c: f"_{c}" for c in same})
        out = out.join(other, on)
        for c in same:
            equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
            out = out.withColumn(c, F.when(equal, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs in {name}")).cast(out.schema[c].dataType))).drop(f"_{c}")
    return out


def id_sets(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: common, only_left, only_right counts of two id sets."""
    a, b = left.select(on).distinct().withColumn("_l", F.lit(1)), right.select(on).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, on, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(count(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common"), count(F.col("_r").isNull()).alias("only_left"), count(F.col("_l").isNull()).alias("only_right"))
