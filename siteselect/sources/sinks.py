"""Writers, and the documents that they write."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteselect.functions import geo

# The columns of the exported list, in the order and by the names that its readers expect.
CANDIDATE = (
    "selection_rank", "grid_id", "longitude", "latitude", "priority_band", "suitability_score", "suitability_rank", "feasibility", "need", "accessibility", "parking", "infrastructure_gap", "technology_gap",
    "ml_consensus_percentile", "ml_logistic_percentile", "ml_random_forest_percentile", "ml_hgb_percentile", "ml_model_spread", "models_top_20pct_count", "model_disagreement", "nearest_selected_grid_id",
    "nearest_selected_candidate_m",
)
BOM = "\ufeff"


def feature_csv(df: DataFrame, path: str, id_col: str = "grid_id") -> None:
    df.orderBy(id_col).write.csv(path, header=True, mode="overwrite")


def geojson_rows(df: DataFrame, geometry: Column, properties: Sequence[str]) -> DataFrame:
    """(value): one GeoJSON feature in each row; write.text gives a file of lines."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def cell_polygon(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    p = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))).alias("coordinates"))


def geographic_polygon(corners: Sequence[tuple[Column, Column]], zone: int = 36, digits: int = 7) -> Column:
    """A GeoJSON polygon from corners in UTM metres: longitude and latitude of WGS84, closed."""
    places = [geo.from_utm(x, y, zone) for x, y in corners]
    ring = [F.array(F.round(lon, digits), F.round(lat, digits)) for lon, lat in [*places, places[0]]]
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*ring)).alias("coordinates"))


def _enclosed(head: str, tail: str):
    """Between head and tail the lines of a partition, parted by commas; a partition without lines has a document, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = head
        for batch in batches:
            lines = batch.column(0).to_pylist()
            out = [mark + line if i == 0 else "," + line for i, line in enumerate(lines)]
            if out:
                mark = ","
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([tail if mark == "," else head + tail], pa.string())], ["value"])

    return run


def geojson(features: DataFrame, path: str) -> None:
    """A spatial layer in WGS84: features (value) as lines of geojson_rows; each part file is a FeatureCollection of its own, so that files are written and read apart."""
    lines = features.mapInArrow(_enclosed('{"type":"FeatureCollection","features":[', "]}"), "value string")
    lines.write.option("maxRecordsPerFile", 0).mode("overwrite").text(path, compression="none")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(geometry_type, coordinates of the outer ring, properties...) of the features of all files of a layer of polygons."""
    feature = f"geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<{properties}>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"type string, features array<struct<{feature.replace('geometry ', 'geometry:').replace('properties ', 'properties:')}>>").alias("d"))
    each = whole.where("d.type = 'FeatureCollection'").select(F.explode("d.features").alias("f"))
    return each.select(F.col("f.geometry.type").alias("geometry_type"), F.element_at("f.geometry.coordinates", 1).alias("ring"), "f.properties.*")


def registry_lines(stations: DataFrame, sockets: DataFrame, station_key: str = "station_id", socket_key: str = "socket_id") -> DataFrame:
    """(section, key, value): the lines of one JSON document {"stations": [...], "sockets": [...], "counts": {...}} in the order of section and key.

    Rows of a section are parted by commas that stand before all but its first; so lines need no neighbours, and the document may be written in parts.
    """

    def rows(table: DataFrame, key: str, section: int) -> DataFrame:
        first = table.agg(F.min(key).alias("_first"))
        comma = F.when(F.col(key) == F.col("_first"), "").otherwise(",")
        body = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
        return table.join(first, F.lit(True)).select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.concat(comma, body).alias("value"))

    def marks(values: Sequence[tuple[int, str]]) -> DataFrame:
        return stations.sparkSession.createDataFrame([(n, "", v) for n, v in values], "section int, key string, value string")

    sizes = stations.agg(F.count("*").alias("stations")).join(sockets.agg(F.count("*").alias("sockets")), F.lit(True))
    end = sizes.select(F.lit(4).alias("section"), F.lit("").alias("key"), F.concat(F.lit('],"counts":'), F.to_json(F.struct("stations", "sockets")), F.lit("}")).alias("value"))
    return marks([(0, '{"stations":['), (2, '],"sockets":[')]).unionByName(rows(stations, station_key, 1)).unionByName(rows(sockets, socket_key, 3)).unionByName(end)


def registry_document(stations: DataFrame, sockets: DataFrame, path: str, station_key: str = "station_id", socket_key: str = "socket_id") -> None:
    """The registry's document as text: part files in order, which read one after the other are the document. Rows are sorted by key as text; keys must be unique."""
    lines = registry_lines(stations, sockets, station_key, socket_key)
    # the first of a section by its own order is not the first as text: sections start where the comma is missing
    ordered = lines.withColumn("_later", F.col("value").startswith(","))
    ordered.orderBy("section", "_later", "key").select("value").write.mode("overwrite").text(path, compression="none")


def candidate_struct() -> Column:
    """A candidate of the decision document, from the columns of CANDIDATE and the further ones named here."""
    c = F.col
    return F.struct(
        c("grid_id"), c("selection_rank"),
        F.struct(F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude")).alias("location"),
        F.struct(c("suitability_score").alias("score"), c("suitability_rank").alias("rank"), c("suitability_percentile").alias("percentile"), c("priority_band"), c("feasibility"), c("need"), c("accessibility"), c("parking"), c("infrastructure_gap"), c("technology_gap"), c("score_explanation").alias("explanation")).alias("suitability"),
        F.struct(c("nearest_selected_grid_id"), c("nearest_selected_candidate_m")).alias("spatial_diversity"),
        F.struct(
            F.lit("fold_normalized_spatial_oof_percentile").alias("method"), c("ml_logistic_percentile").alias("logistic_regression_percentile"), c("ml_random_forest_percentile").alias("random_forest_percentile"),
            c("ml_hgb_percentile").alias("hist_gradient_boosting_percentile"), c("ml_consensus_percentile").alias("consensus_percentile"), c("ml_consensus_rank").alias("consensus_rank"), c("ml_min_percentile").alias("minimum_model_percentile"),
            c("ml_max_percentile").alias("maximum_model_percentile"), c("ml_model_spread").alias("model_percentile_spread"), c("models_top_20pct_count"), c("models_top_10pct_count"),
            (c("models_top_20pct_count") >= 2).alias("at_least_two_models_top_20pct"), (c("models_top_20pct_count") == 3).alias("all_models_top_20pct"), c("support_label"), c("model_disagreement").alias("has_model_disagreement"),
        ).alias("ml_support"),
    )


def decision_document(shortlist: DataFrame, study_area: str, spacing_m: int, generated_at: str) -> DataFrame:
    """(value): the nested document of a shortlist, which has a few dozen candidates: header, policy and the candidates by rank."""
    listed = shortlist.agg(F.array_sort(F.collect_list(F.struct(F.col("selection_rank").alias("o"), candidate_struct().alias("c")))).alias("l"))
    policy = F.struct(F.lit("explainable_suitability").alias("primary_layer"), F.lit(False).alias("ml_is_blended_into_suitability"), F.lit(spacing_m).alias("minimum_spacing_m"))
    header = F.struct(F.lit("1.0").alias("schema_version"), F.lit(study_area).alias("study_area"), F.lit("EPSG:4326").alias("coordinate_reference_system"), F.size("l").alias("candidate_count"), policy.alias("decision_policy"), F.lit(generated_at).alias("generated_at_utc"), F.transform("l", lambda x: x["c"]).alias("candidates"))
    return listed.select(F.to_json(header, {"ignoreNullFields": "false"}).alias("value"))


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def candidate_csv_rows(candidates: DataFrame, columns: Sequence[str] = CANDIDATE) -> DataFrame:
    """(value): each candidate as a line of quoted fields; quotes are doubled, null is empty. The header line is `candidate_csv_header`."""
    return candidates.select(F.concat_ws(",", *[_quoted(c) for c in columns]).alias("value"))


def candidate_csv_header(columns: Sequence[str] = CANDIDATE) -> str:
    """The first line of the file, with the byte order mark that spreadsheets look for."""
    return BOM + ",".join(f'"{c}"' for c in columns)


def _headed(head: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return run


def candidate_csv(candidates: DataFrame, path: str, columns: Sequence[str] = CANDIDATE) -> None:
    """The list as text, by selection_rank, which candidates must have: part files in order, each a file of its own with the marked header, so that they are written and read
    apart. What fits one partition, as a shortlist does, is one file."""
    rows = candidates.select(F.concat_ws(",", *[_quoted(c) for c in columns]).alias("value"), F.col("selection_rank").cast("long").alias("at"))
    lines = rows.orderBy("at").select("value").mapInArrow(_headed(candidate_csv_header(columns)), "value string")
    lines.write.option("maxRecordsPerFile", 0).mode("overwrite").text(path, compression="none")


def fold_outputs(rows: DataFrame, blocks: DataFrame, path: str) -> None:
    rows.write.partitionBy("cv_fold").parquet(f"{path}/rows", mode="overwrite")
    blocks.write.parquet(f"{path}/blocks", mode="overwrite")
