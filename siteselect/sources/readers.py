"""Readers: schemas are declared and checks follow the read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteselect.functions import clean
from siteselect.operators.checks import enforce, repeated, report, require
from siteselect.operators.features import first_rows, forward_fill

OVERPASS = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
BOUNDARY = "features array<struct<geometry: struct<type: string, coordinates: string>>>"


def attribute_table(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ("grid_id",)) -> DataFrame:
    """CSV with a header, or Parquet by its suffix."""
    df = spark.read.schema(schema).parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).csv(path, header=True)
    return require(df, required)


def spatial_table(spark: SparkSession, path: str, required: Sequence[str] = ("grid_id", "x0", "y0", "x1", "y1"), crs: str | None = None, crs_col: str = "crs", id_col: str = "grid_id", cell_size: float | None = None) -> DataFrame:
    """A Parquet layer of boxes. Raises for rows of another reference system, null or repeated ids, boxes that are not finite or have no area, and, with
    cell_size, cells of another size."""
    df = require(spark.read.parquet(path), [*required, *([crs_col] if crs else [])])
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rules = {"invalid box": ~F.coalesce((width > 0) & (height > 0) & (F.abs(width) + F.abs(height) < float("inf")), F.lit(False)), f"{id_col} is missing": F.col(id_col).isNull()}
    if crs:
        rules[f"not in {crs}"] = ~F.col(crs_col).eqNullSafe(crs)
    if cell_size is not None:
        rules[f"cell is not of {cell_size:g}"] = (F.abs(width - cell_size) > 1e-6) | (F.abs(height - cell_size) > 1e-6)
    enforce(report(df, rules))
    if not repeated(df, id_col).isEmpty():
        raise ValueError(f"repeated {id_col}")
    return df


def boundary(spark: SparkSession, path: str) -> DataFrame:
    """(part, ring_no, hole, ring array<struct<x, y>>): the rings of a GeoJSON file's polygons and multipolygons, without closing points; ring 0 of a part is its outline,
    the others are holes."""
    read = spark.read.schema(BOUNDARY).option("multiLine", True).json(path).select(F.explode("features.geometry").alias("g"))
    rings = "array<array<array<double>>>"
    parts = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", rings))).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{rings}>"))
    each = read.select(parts.alias("parts")).select(F.posexplode("parts").alias("part", "rings")).select("part", F.posexplode("rings").alias("ring_no", "r"))
    ring = F.transform(F.slice("r", F.lit(1), F.size("r") - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return each.select("part", "ring_no", (F.col("ring_no") > 0).alias("hole"), ring.alias("ring"))


def elements(payloads: DataFrame) -> DataFrame:
    """Payload rows (elements as OVERPASS) to (payload columns, pos, type, id, lon, lat, tags): a node's own place, else its centre; rows without a place go."""
    others = [c for c in payloads.columns if c != "elements"]
    each = payloads.select(*others, F.posexplode("elements").alias("pos", "e"))
    place = lambda k: F.when(F.col("e.type") == "node", F.col(f"e.{k}")).otherwise(F.col(f"e.center.{k}"))
    return each.select(*others, "pos", "e.type", "e.id", place("lon").alias("lon"), place("lat").alias("lat"), "e.tags").dropna(subset=["lon", "lat"])


def merged_elements(each: DataFrame) -> DataFrame:
    """One row for each (type, id): that of the first payload."""
    return first_rows(each, ["type", "id"], ["payload_no", "pos"])


def consolidated(each: DataFrame) -> DataFrame:
    """One row for each (type, id): the first non-empty value of each tag by payload, the query groups sorted and joined by a bar, and the categories; rows
    without a category go."""
    tags = each.select("type", "id", "payload_no", F.explode(F.map_entries("tags")).alias("t")).select("type", "id", F.col("t.key").alias("k"), F.col("t.value").alias("v"), "payload_no")
    chosen = tags.groupBy("type", "id", "k").agg(F.min_by("v", F.struct(F.coalesce(F.col("v") == "", F.lit(True)), "payload_no")).alias("v"))
    maps = chosen.groupBy("type", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))
    groups = each.groupBy("type", "id").agg(F.array_join(F.array_sort(F.collect_set("query_group")), "|").alias("query_groups"))
    out = maps.join(groups, ["type", "id"]).withColumns(clean.categories("tags"))
    return out.where("is_retail_commercial or is_education or is_healthcare or is_transport_activity").withColumn("tags_json", F.to_json("tags"))


def registry_report(raw: DataFrame, renames: dict[str, str], by: str, order: str, filled: Sequence[str], header: Column) -> DataFrame:
    """A report with merged cells: renamed, texts cleaned, station data filled down, header rows taken out."""
    df = raw.withColumnsRenamed(renames)
    df = df.withColumns({c: F.when(clean.clean_text(c) != "", clean.clean_text(c)) for c in filled})
    return forward_fill(df, by, order, filled).where(~F.coalesce(header, F.lit(False)))


def pixels(df: DataFrame, nodata: float | None = None) -> DataFrame:
    """Raster values as rows without NoData, missing, non-finite and negative ones."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") >= 0)
    return df.where(fine & (F.col("value") != nodata) if nodata is not None else fine)


def chunks(spark: SparkSession, paths: Sequence[str], manifest: DataFrame) -> DataFrame:
    """Chunk files as one table with `source_file`; a row count that differs from the manifest's sum raises."""
    df = spark.read.parquet(*paths)
    expected, got = manifest.agg(F.sum("row_count")).first()[0] or 0, df.count()
    if expected != got:
        raise ValueError(f"{got} rows, the manifest has {expected}")
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def incomplete(manifest: DataFrame, data: DataFrame) -> DataFrame:
    """Chunks without success, and non-empty ones that the data lacks."""
    there = data.select("chunk_id").distinct()
    lacking = manifest.where("status = 'success' and row_count > 0").join(there, "chunk_id", "left_anti")
    return manifest.where("status <> 'success'").select("chunk_id").union(lacking.select("chunk_id")).distinct()
