"""Square grids, tiles and blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.functions import clean, geo
from siteselect.operators import joins


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: min_x, min_y, max_x, max_y."""
    return points.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def quadrants(box: DataFrame) -> DataFrame:
    """Each box cut into four, numbered from the lower left by rows."""
    mx, my = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    part = lambda k, a, b, c, d: F.struct(F.lit(k).alias("quadrant"), a.alias("min_x"), b.alias("min_y"), c.alias("max_x"), d.alias("max_y"))
    q = F.explode(F.array(part(0, F.col("min_x"), F.col("min_y"), mx, my), part(1, mx, F.col("min_y"), F.col("max_x"), my), part(2, F.col("min_x"), my, mx, F.col("max_y")), part(3, mx, my, F.col("max_x"), F.col("max_y"))))
    return box.select(q.alias("q")).select("q.*")


def square_grid(spark: SparkSession, left: float, bottom: float, right: float, top: float, size: float, ring: list[tuple[float, float]] | None = None, prefix: str = "G", zone: int | None = None) -> DataFrame:
    """(grid_id, cx, cy, x0, y0, x1, y1, cell_area_m2): square cells from multiples of the size, numbered along y first.

    With a UTM zone, in whose metres the plane is, also the centre's longitude and latitude to 7 digits. With a ring, cells whose centre is inside or on it stay and are numbered. Numbers come from a sort by range and each partition's count.
    """
    cx0, cy0 = math.floor(left / size), math.floor(bottom / size)
    nx, ny = math.ceil(right / size) - cx0, math.ceil(top / size) - cy0
    cells = spark.range(nx * ny).select((F.floor(F.col("id") / ny) + cx0).alias("cx"), (F.col("id") % ny + cy0).alias("cy"), F.col("id").alias("place"))
    cells = cells.withColumns({"x0": F.col("cx") * size, "y0": F.col("cy") * size})
    cells = cells.withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size, "cell_area_m2": F.lit(float(size * size))})
    if ring:
        outline = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
        cells = cells.where(geo.in_ring(F.col("x0") + size / 2, F.col("y0") + size / 2, outline))
    # cells of one column cx are numbered in it; columns add up those before
    columns = cells.groupBy("cx").agg(F.count("*").alias("n"))
    starts = columns.select("cx", (F.coalesce(F.sum("n").over(W.orderBy("cx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    numbered = cells.join(starts, "cx").withColumn("number", F.row_number().over(W.partitionBy("cx").orderBy("cy")) + F.col("start"))
    centre = []
    if zone is not None:
        places = geo.from_utm(F.col("x0") + size / 2, F.col("y0") + size / 2, zone)
        centre = [F.round(v, 7).alias(k) for k, v in zip(("center_lon", "center_lat"), places, strict=True)]
    name = F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("number").cast("string"), max(6, len(str(nx * ny))), "0"))
    return numbered.select(name.alias("grid_id"), "cx", "cy", "x0", "y0", "x1", "y1", "cell_area_m2", *centre)


def block_id(x: Column | str, y: Column | str, size: float = 5000.0) -> Column:
    bx, by = geo.cell_index(x, y, size)
    return F.concat(F.lit("B"), bx.cast("string"), F.lit("_"), by.cast("string"))


def assign_chunks(cells: DataFrame, tile: float) -> DataFrame:
    """Each cell to the tile that holds its centre (an edge belongs to the lower one by order): adds chunk_x, chunk_y."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    low = lambda v: F.greatest(F.ceil(v / tile) - 1, F.lit(0))
    return cells.withColumns({"chunk_x": low(cx), "chunk_y": low(cy)})


def core_chunks(boundary: DataFrame, tile: float, prefix: str = "K_", width: int = 4, shape: str = "shape") -> DataFrame:
    """(chunk_id, chunk_order, cx, cy, shape, area_km2): the tiles, from multiples of the size, cut to the boundary (polygons that do not overlap);
    those with an area are numbered from 1 by x, then y. Tiles are few: they are numbered in one window."""
    pieces = joins.shape_pieces(boundary.select(shape), tile, shape)
    met = pieces.groupBy("cx", "cy").agg(F.flatten(F.collect_list("piece")).alias("shape")).withColumn("area_km2", geo.shape_area("shape") / 1e6)
    ordered = met.withColumn("chunk_order", F.row_number().over(W.orderBy("cx", "cy")).cast("long"))
    return ordered.select(clean.padded_id("chunk_order", prefix, width).alias("chunk_id"), "chunk_order", "cx", "cy", "shape", "area_km2")


def select_chunks(chunks: DataFrame, ids: DataFrame | None = None, from_order: int | None = None, limit: int | None = None, skip_empty: bool = True) -> DataFrame:
    """By a table of ids or from an order on; without empty chunks; the first `limit` by order."""
    out = chunks.join(ids, "chunk_id", "left_semi") if ids is not None else chunks
    out = out.where(F.col("chunk_order") >= from_order) if from_order is not None else out
    out = out.where("grid_count > 0") if skip_empty else out
    return out.orderBy("chunk_order").limit(limit) if limit is not None else out
