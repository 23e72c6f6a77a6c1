"""Plane geometry on numbers: points (x, y), segments (x1, y1, x2, y2), rings array<struct<x, y>>, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def to_segment(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment; a segment of no length is a point."""
    px, py, x1, y1, x2, y2 = map(_c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def clip(x1, y1, x2, y2, bx0, by0, bx1, by1) -> tuple[Column, Column]:
    """(from, to): the part of a segment in a closed box, as fractions of its length; from > to if there is none."""
    x1, y1, x2, y2, bx0, by0, bx1, by1 = map(_c, (x1, y1, x2, y2, bx0, by0, bx1, by1))

    def slab(p: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (low - p) / F.nullif(d, F.lit(0.0)), (high - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= low) & (p <= high)
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    ax, bx = slab(x1, x2 - x1, bx0, bx1)
    ay, by = slab(y1, y2 - y1, by0, by1)
    return F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)


def clipped_length(x1, y1, x2, y2, bx0, by0, bx1, by1) -> Column:
    t0, t1 = clip(x1, y1, x2, y2, bx0, by0, bx1, by1)
    return F.when(t1 > t0, (t1 - t0) * distance(x1, y1, x2, y2)).otherwise(0.0)


def _edges(ring: Column) -> Column:
    """A ring's edges as structs; the last point joins the first."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _crossings(px: Column, py: Column, ring: Column) -> Column:
    """How many edges of a ring a ray from the point to the right crosses."""

    def crosses(e: Column) -> Column:
        up = (e["y1"] > py) != (e["y2"] > py)
        at = (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.when(up & (px < at), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + crosses(e))


def _on(px: Column, py: Column, ring: Column) -> Column:
    def touches(e: Column) -> Column:
        level = (e["x2"] - e["x1"]) * (py - e["y1"]) == (e["y2"] - e["y1"]) * (px - e["x1"])
        return level & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(_edges(ring), touches)


def in_ring(px, py, ring: Column | str) -> Column:
    """Whether a point is inside a ring or on its edge."""
    px, py, ring = _c(px), _c(py), _c(ring)
    return (_crossings(px, py, ring) % 2 == 1) | _on(px, py, ring)


def to_ring(px, py, ring: Column | str) -> Column:
    """Distance from a point to a polygon, 0 inside."""
    px, py, ring = _c(px), _c(py), _c(ring)
    nearest = F.array_min(F.transform(_edges(ring), lambda e: to_segment(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))
    return F.when(in_ring(px, py, ring), 0.0).otherwise(nearest)


def to_polyline(px, py, points: Column | str) -> Column:
    """Distance from a point to a polyline; one of a single point is that point."""
    px, py, points = _c(px), _c(py), _c(points)
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.coalesce(F.get(points, i), F.get(points, i - 1)).alias("b")))
    return F.array_min(F.transform(spans, lambda s: to_segment(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def let(value: Column, fn) -> Column:
    """fn(value) with the value worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def ring_of(*corners) -> Column:
    """A ring from (x, y) pairs of columns or numbers."""
    return F.array(*[point(x, y) for x, y in corners])


def shape_of(outer: Column | Sequence[Column], *holes: Column) -> Column:
    """A polygon with holes, or several: array<struct<ring, hole>>, whichever way the rings run."""
    outers = [outer] if isinstance(outer, Column) else list(outer)
    return F.array(*[F.struct(r.alias("ring"), F.lit(hole).alias("hole")) for rings, hole in ((outers, False), (holes, True)) for r in rings])


def _half(ring: Column, along: str, limit: Column, upper: bool) -> Column:
    """The part of a ring on one side of a line of constant x or y (`along`), as a ring; parts of it may be joined by edges on that line."""
    other = "y" if along == "x" else "x"
    held = lambda v: v >= limit if upper else v <= limit

    def of(e: Column) -> Column:
        a, b, c, d = (e[f"{k}{n}"] for n in (1, 2) for k in (along, other))  # from (a, b) to (c, d)
        mark = lambda v, w: F.struct(*[x.alias(k) for k, x in sorted({along: v, other: w}.items())])
        cut, end = mark(limit, b + (limit - a) / (c - a) * (d - b)), mark(c, d)
        inside = F.when(held(a), F.array(end)).otherwise(F.array(cut, end))
        return F.when(held(c), inside).when(held(a), F.array(cut)).otherwise(F.slice(F.array(end), 1, 0))

    return let(ring, lambda r: F.flatten(F.transform(_edges(r), of)))


def clip_ring(ring: Column | str, x0=None, y0=None, x1=None, y1=None) -> Column:
    """A ring cut to a box, sides that are None left open: a ring again, empty if nothing is left. What the box cuts into parts stays one ring; the edges
    that join them lie on the box and add nothing to the area."""
    out = _c(ring)
    for along, limit, upper in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        if limit is not None:
            out = _half(out, along, _c(limit).cast("double"), upper)
    return out


def clip_shape(shape: Column | str, x0=None, y0=None, x1=None, y1=None) -> Column:
    """A shape cut to a box; rings that nothing is left of go."""
    cut = F.transform(_c(shape), lambda s: F.struct(clip_ring(s["ring"], x0, y0, x1, y1).alias("ring"), s["hole"].alias("hole")))
    return F.filter(cut, lambda s: F.size(s["ring"]) > 2)


def shape_area(shape: Column | str) -> Column:
    return F.aggregate(_c(shape), F.lit(0.0), lambda t, s: t + F.when(s["hole"], -1.0).otherwise(1.0) * area(s["ring"]))


def extent(shape: Column | str, along: str) -> tuple[Column, Column]:
    """The smallest and largest x or y of a shape."""
    values = F.flatten(F.transform(_c(shape), lambda s: F.transform(s["ring"], lambda p: p[along])))
    both = let(values, lambda v: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")))
    return both["low"], both["high"]


def cells_along(shape: Column | str, along: str, size: Column | float, start: Column | float = 0.0, least: Column | None = None, most: Column | None = None) -> Column:
    """The numbers of the cells from `start` on that a shape spans in x or y, no less than `least` and no more than `most`; null if it has no extent."""
    values = F.flatten(F.transform(_c(shape), lambda s: F.transform(s["ring"], lambda p: p[along])))

    def span(e: Column) -> Column:
        first, last = F.floor((e["low"] - start) / size), F.ceil((e["high"] - start) / size) - 1
        first, last = F.greatest(first, least) if least is not None else first, F.least(last, most) if most is not None else last
        return F.when((e["high"] > e["low"]) & (last >= first), F.sequence(first, last))

    return let(let(values, lambda v: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))), span)


def in_shape(px, py, shape: Column | str) -> Column:
    """Whether a point is inside a shape or on its edge; the inside of a hole is outside."""
    px, py, shape = _c(px), _c(py), _c(shape)
    odd = F.aggregate(shape, F.lit(0), lambda n, s: n + _crossings(px, py, s["ring"])) % 2 == 1
    return odd | F.exists(shape, lambda s: _on(px, py, s["ring"]))


def shape_edges(shape: Column | str) -> Column:
    """All edges of a shape as structs x1, y1, x2, y2."""
    return F.flatten(F.transform(_c(shape), lambda s: _edges(s["ring"])))


def _twice_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda t, e: t + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))


def _grown_ring(ring: Column, hole: Column, by: float) -> Column:
    """What a ring of a shape contributes to the area of the shape grown by a distance."""
    long = F.filter(_edges(ring), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    step = lambda e: F.struct((e["x2"] - e["x1"]).alias("x"), (e["y2"] - e["y1"]).alias("y"))

    def corners(edges: Column, way: Column) -> Column:
        following = F.concat(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), F.slice(edges, 1, 1))
        turns = F.zip_with(edges, following, lambda a, b: way * F.atan2(a["x"] * b["y"] - a["y"] * b["x"], a["x"] * b["x"] + a["y"] * b["y"]))
        return F.aggregate(turns, F.lit(0.0), lambda t, v: t + F.when(v >= 0, v / 2).otherwise(F.tan(v / 2)))

    def whole(edges: Column) -> Column:
        twice = _twice_area(ring)
        way = F.signum(twice) * F.when(hole, -1.0).otherwise(1.0)
        around = perimeter(ring)
        return let(corners(F.transform(edges, step), way), lambda c: of(F.abs(twice) / 2, around, c))

    def of(own: Column, around: Column, corner: Column) -> Column:
        grown = around * by + by * by * corner
        left = F.when((corner < 0) & (-2 * by * corner >= around), 0.0).otherwise(F.greatest(own - grown, F.lit(0.0)))
        return F.when(hole, -left).otherwise(own + grown)

    return let(long, whole)


def grown_area(shape: Column | str, by: float) -> Column:
    """Area of a shape grown by a distance: a strip along each edge, a sector at each corner that points outwards, and at each that points inwards what two strips
    share taken off once. Right as long as the grown edges meet their neighbours only; a hole shrinks and may close."""
    return F.aggregate(_c(shape), F.lit(0.0), lambda t, s: t + let(s, lambda v: _grown_ring(v["ring"], v["hole"], by)))


def clip_polyline(points: Column | str, x0, y0, x1, y1) -> Column:
    """The parts of a polyline in a closed box, as an array of polylines: a part ends where the line leaves the box, and points alone are no part."""
    box = [_c(v).cast("double") for v in (x0, y0, x1, y1)]
    kind = "array<struct<x:double,y:double>>"
    none = F.lit(None).cast(kind)

    def step(state: Column, e: Column) -> Column:
        lo, hi = clip(e["x1"], e["y1"], e["x2"], e["y2"], *box)
        at = lambda f, whole: F.when(f == (1.0 if whole else 0.0), point(e["x2" if whole else "x1"], e["y2" if whole else "y1"])).otherwise(point(e["x1"] + f * (e["x2"] - e["x1"]), e["y1"] + f * (e["y2"] - e["y1"])))
        return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda c: _next(state, e, c, at))

    def _next(state: Column, e: Column, c: Column, at) -> Column:
        inside, still = c["hi"] > c["lo"], (e["x1"] == e["x2"]) & (e["y1"] == e["y2"])
        goes_on = state["open"].isNotNull() & (c["lo"] == 0)
        end = at(c["hi"], True)
        opened = F.when(goes_on, F.concat(state["open"], F.array(end))).otherwise(F.array(at(c["lo"], False), end))
        closes = state["open"].isNotNull() & ~goes_on
        before = F.when(closes, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        left = F.when(state["open"].isNotNull(), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        stays = F.struct(before.alias("done"), opened.alias("open"))
        leaves = F.struct(F.concat(before, F.array(opened)).alias("done"), none.alias("open"))
        return F.when(still, state).when(inside & (c["hi"] == 1), stays).when(inside, leaves).otherwise(F.struct(left.alias("done"), none.alias("open")))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), none.alias("open"))
    finish = lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    return F.aggregate(segments_of(points), start, step, finish)


def segments_of(points: Column | str) -> Column:
    """A polyline's segments as structs x1, y1, x2, y2."""
    points = _c(points)
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    behind = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(behind, ahead, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def polyline_length(points: Column | str) -> Column:
    return F.aggregate(segments_of(points), F.lit(0.0), lambda t, e: t + distance(e["x1"], e["y1"], e["x2"], e["y2"]))


def area(ring: Column | str) -> Column:
    """Area of a simple ring by the shoelace formula."""
    return F.abs(F.aggregate(_edges(_c(ring)), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2


def perimeter(ring: Column | str) -> Column:
    return F.aggregate(_edges(_c(ring)), F.lit(0.0), lambda s, e: s + distance(e["x1"], e["y1"], e["x2"], e["y2"]))


def centroid(ring: Column | str) -> Column:
    """struct<x, y> of a simple ring with an area."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]

    def sums(edges: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("t", "x", "y")])
        add = lambda s, e: F.struct((s["t"] + cross(e)).alias("t"), (s["x"] + (e["x1"] + e["x2"]) * cross(e)).alias("x"), (s["y"] + (e["y1"] + e["y2"]) * cross(e)).alias("y"))
        return F.aggregate(edges, start, add, lambda s: F.struct((s["x"] / (3 * s["t"])).alias("x"), (s["y"] / (3 * s["t"])).alias("y")))

    return sums(_edges(_c(ring)))


def inner_point(ring: Column | str) -> Column:
    """A point inside a ring: its centroid if that is inside, else the middle of the widest inner span at half height."""

    def middle(r: Column, y: Column) -> Column:
        cuts = F.array_sort(F.transform(F.filter(_edges(r), lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
        spans = lambda c: F.transform(F.sequence(F.lit(0), F.greatest((F.size(c) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((F.get(c, 2 * i + 1) - F.get(c, 2 * i)).alias("w"), ((F.get(c, 2 * i + 1) + F.get(c, 2 * i)) / 2).alias("x")))
        return F.struct(F.array_max(let(cuts, spans))["x"].alias("x"), y.alias("y"))

    def of(r: Column, c: Column) -> Column:
        level = (F.array_min(F.transform(r, lambda p: p["y"])) + F.array_max(F.transform(r, lambda p: p["y"]))) / 2
        return F.when(in_ring(c["x"], c["y"], r), c).otherwise(let(level, lambda y: middle(r, y)))

    return let(_c(ring), lambda r: let(centroid(r), lambda c: of(r, c)))


def line_key(points: Column | str) -> Column:
    """A key of a polyline at 1 cm that does not depend on its direction."""
    text = lambda a: F.array_join(F.transform(a, lambda p: F.concat_ws(" ", F.round(p["x"] * 100).cast("long").cast("string"), F.round(p["y"] * 100).cast("long").cast("string"))), ",")
    forward, backward = text(_c(points)), text(F.reverse(_c(points)))
    return F.least(forward, backward)


def cell_index(x, y, size: float, left: float = 0.0, bottom: float = 0.0) -> tuple[Column, Column]:
    return F.floor((_c(x) - left) / size), F.floor((_c(y) - bottom) / size)


def row_col(x, y, size: float, left: float, top: float) -> tuple[Column, Column]:
    """Row from the top and column from the left of a north-up raster."""
    return F.floor((top - _c(y)) / size), F.floor((_c(x) - left) / size)


# The WGS84 ellipsoid and the transverse Mercator scale.
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = math.sqrt(_FLAT * (2 - _FLAT))


def to_utm(lon, lat, zone: int = 36) -> tuple[Column, Column]:
    """Easting and northing (north half) by the Krüger series, to less than a millimetre within the zone."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _R * x, _K0 * _R * y


def from_utm(easting, northing, zone: int = 36) -> tuple[Column, Column]:
    """Longitude and latitude of a point in the north half."""
    xi, eta = _c(northing) / (_K0 * _R), (_c(easting) - 500000) / (_K0 * _R)
    x, y = eta, xi
    for j, b in enumerate(_BACK, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (zone * 6 - 183), F.degrees(phi)
