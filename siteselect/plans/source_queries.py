"""Ingest and documents: payloads, registry reports, chunk manifests, streams and nested output from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from siteselect.operators import grid, ml, ranks, scoring, selection
from siteselect.operators.scratch import folder
from siteselect.plans.catalog import Tables, query
from siteselect.plans.clean_queries import poi_tags
from siteselect.plans.score_queries import CHOSEN, NEAR, ranked_points
from siteselect.plans.spatial_queries import lon_lat_sql
from siteselect.sources import readers, sinks


def _folder(t: Tables) -> str:
    """A fresh folder that executors share."""
    return f"{folder(t.spark)}/sources-{uuid.uuid4().hex}"


@query("s1_attribute_table_csv", "SELECT grid_id, target, pop0 FROM $candidate")
def _(t):
    path = f"{_folder(t)}/table.csv"
    sinks.feature_csv(t("candidate").select("grid_id", "target", "pop0"), path)
    return readers.attribute_table(t.spark, path, "grid_id string, target int, pop0 double")


@query("s2_spatial_table", "SELECT grid_id, x0, y0, x1, y1 FROM $grid JOIN (SELECT DISTINCT floor(x / 500) AS px, floor(y / 500) AS py FROM $poi) ON cx = px AND cy = py")
def _(t):
    path = f"{_folder(t)}/cells.parquet"
    busy = t("poi").select(F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 500).alias("cy")).distinct()
    t("grid").join(busy, ["cx", "cy"]).withColumn("crs", F.lit("EPSG:32636")).write.parquet(path)
    return readers.spatial_table(t.spark, path, crs="EPSG:32636", cell_size=500.0).select("grid_id", "x0", "y0", "x1", "y1")


@query("s3_boundary_geojson", """WITH b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM $poi), r AS (
  SELECT 0 AS part, 0 AS ring_no, x0, y0, x1, y1 FROM b UNION ALL SELECT 0, 1, x0 + (x1 - x0) / 4, y0 + (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1 - (y1 - y0) / 4 FROM b UNION ALL SELECT 1, 0, x1 + 1000, y0, x1 + 2000, y1 FROM b)
SELECT part, ring_no, ring_no > 0 AS hole, 0 AS k, x0 AS x, y0 AS y FROM r UNION ALL SELECT part, ring_no, ring_no > 0, 1, x1, y0 FROM r UNION ALL SELECT part, ring_no, ring_no > 0, 2, x1, y1 FROM r UNION ALL SELECT part, ring_no, ring_no > 0, 3, x0, y1 FROM r""")
def _(t):
    b = grid.bounds(t("poi")).select(F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), F.col("max_x").alias("x1"), F.col("max_y").alias("y1"))
    box = lambda x0, y0, x1, y1: F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = (x1 - x0) / 4, (y1 - y0) / 4
    parts = F.array(F.array(box(x0, y0, x1, y1), box(x0 + w, y0 + h, x1 - w, y1 - h)), F.array(box(x1 + 1000, y0, x1 + 2000, y1)))
    path = f"{_folder(t)}/boundary"
    feature = F.struct(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry"))
    b.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path)
    return readers.boundary(t.spark, path).select("part", "ring_no", "hole", F.posexplode("ring").alias("k", "p")).select("part", "ring_no", "hole", "k", "p.x", "p.y")


def payloads(t: Tables):
    """Points as payloads of a thousand elements: nodes with their own place, ways with a centre, every tenth without any."""
    p = t("poi").withColumn("payload_no", F.floor(F.col("point_id") / 1000)).withColumn("kind", F.when(F.col("point_id") % 2 == 0, "node").otherwise("way"))
    none = F.lit(None).cast("double")
    lost = F.col("point_id") % 10 == 9
    node = F.col("kind") == "node"
    element = F.struct(F.col("kind").alias("type"), (F.col("point_id") % 7000).alias("id"), F.when(node, F.col("y")).otherwise(none).alias("lat"), F.when(node, F.col("x")).otherwise(none).alias("lon"), F.when(~node & ~lost, F.struct(F.col("y").alias("lat"), F.col("x").alias("lon"))).alias("center"), poi_tags().alias("tags"), F.col("point_id").alias("o"))
    rows = p.select("payload_no", element.alias("e")).groupBy("payload_no").agg(F.collect_list("e").alias("l"))
    ordered = F.array_sort("l", lambda a, b: (a["o"] - b["o"]).cast("int"))
    return rows.select("payload_no", F.transform(ordered, lambda x: x.dropFields("o")).alias("elements"))


@query("s4_payload_elements", "SELECT CAST(floor(point_id / 1000) AS BIGINT) AS payload_no, CASE WHEN point_id % 2 = 0 THEN 'node' ELSE 'way' END AS type, point_id % 7000 AS id, x AS lon, y AS lat FROM $poi WHERE point_id % 10 <> 9")
def _(t):
    path = f"{_folder(t)}/payloads"
    payloads(t).write.json(path)
    read = t.spark.read.schema("payload_no bigint, " + readers.OVERPASS).json(path)
    return readers.elements(read).select("payload_no", "type", "id", "lon", "lat")


FIRST = "SELECT *, row_number() OVER (PARTITION BY point_id % 2, point_id % 7000 ORDER BY point_id) AS r FROM $poi WHERE point_id % 10 <> 9"


@query("s10_merge_payloads", f"SELECT CASE WHEN point_id % 2 = 0 THEN 'node' ELSE 'way' END AS type, point_id % 7000 AS id, x AS lon, y AS lat FROM ({FIRST}) WHERE r = 1")
def _(t):
    return readers.merged_elements(readers.elements(payloads(t))).select("type", "id", "lon", "lat")


T15 = """WITH e AS (SELECT point_id, CASE WHEN point_id % 2 = 0 THEN 'node' ELSE 'way' END AS type, point_id % 7000 AS id, CASE WHEN floor(point_id / 1000) % 2 = 0 THEN 'retail' ELSE 'all' END AS g,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN point_id % 10 = 0 THEN 'vacant' ELSE 'bakery' END ELSE 'no' END AS shop, CASE event_type WHEN 'signup' THEN 'school' WHEN 'view' THEN 'Clinic' ELSE '' END AS amenity,
    CASE WHEN event_type = 'click' THEN 'bus_stop' ELSE 'none' END AS highway FROM $poi WHERE point_id % 10 <> 9),
c AS (SELECT type, id, string_agg(DISTINCT g, '|' ORDER BY g) AS query_groups, arg_min(shop, point_id) AS shop, coalesce(arg_min(amenity, point_id) FILTER (WHERE amenity <> ''), '') AS amenity, arg_min(highway, point_id) AS highway FROM e GROUP BY type, id)
SELECT type, id, query_groups, shop = 'bakery' AS is_retail_commercial, amenity = 'school' AS is_education, amenity = 'Clinic' AS is_healthcare, highway = 'bus_stop' AS is_transport_activity,
  concat('{"amenity":"', amenity, '","highway":"', highway, '","shop":"', shop, '"}') AS tags_json FROM c WHERE shop = 'bakery' OR amenity <> '' OR highway = 'bus_stop'"""


@query("t15_consolidated_points", T15)
def _(t):
    each = readers.elements(payloads(t)).withColumn("query_group", F.when(F.col("payload_no") % 2 == 0, "retail").otherwise("all"))
    return readers.consolidated(each).drop("tags")


@query("s5_registry_report", "SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS station FROM orders")
def _(t):
    raw = t("orders").select(F.col("o_custkey").alias("Rapor"), F.col("o_orderkey").alias("Satir"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), "o_orderpriority")).alias("Istasyon"))
    out = readers.registry_report(raw, {"Rapor": "o_custkey", "Satir": "o_orderkey", "Istasyon": "station"}, "o_custkey", "o_orderkey", ["station"], F.col("station") == "Istasyon")
    return out.select("o_custkey", "o_orderkey", "station")


@query("s6_pixels", "SELECT prow, pcol, value FROM $pixel WHERE value IS NOT NULL AND value <> 9999")
def _(t):
    return readers.pixels(t("pixel"), 9999.0)


def manifest(t: Tables):
    return t("piece").groupBy(F.concat(F.lit("K_"), F.col("chunk_order").cast("string")).alias("chunk_id")).agg(F.count("*").alias("row_count"))


@query("s7_chunk_union", "SELECT concat('K_', CAST(chunk_order AS VARCHAR)) AS chunk_id, count(*) AS n FROM $piece GROUP BY 1")
def _(t):
    path = _folder(t)
    t("piece").withColumn("chunk_id", F.concat(F.lit("K_"), F.col("chunk_order").cast("string"))).write.parquet(path)
    return readers.chunks(t.spark, [path], manifest(t)).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("s8_chunk_audit", "SELECT DISTINCT concat('K_', CAST(chunk_order AS VARCHAR)) AS chunk_id FROM $piece WHERE chunk_order IN (2, 5)")
def _(t):
    m = manifest(t).withColumn("status", F.when(F.col("chunk_id") == "K_2", "failed").otherwise("success"))
    there = t("piece").where("chunk_order <> 5").select(F.concat(F.lit("K_"), F.col("chunk_order").cast("string")).alias("chunk_id"))
    return readers.incomplete(m, there)


@query("s9_incremental_ingest", "SELECT event_id, event_type FROM events")
def _(t):
    from siteselect.streaming.ingest import ingest_new, ingested

    at = _folder(t)
    e = t("events").select("event_id", "event_type")
    e.where("event_id % 2 = 0").write.json(f"{at}/in", mode="append")
    args = (t.spark, f"{at}/in", "event_id long, event_type string", f"{at}/out", f"{at}/done", ["event_id"])
    ingest_new(*args)
    e.where("event_id % 3 <> 1").write.json(f"{at}/in", mode="append")
    e.where("event_id % 2 = 1").write.json(f"{at}/in", mode="append")
    ingest_new(*args)
    return ingested(t.spark, f"{at}/out").select("event_id", "event_type")


@query("k1_feature_csv", "SELECT grid_id, pop1 FROM $candidate")
def _(t):
    path = f"{_folder(t)}/features.csv"
    sinks.feature_csv(t("candidate").select("grid_id", "pop1"), path)
    return t.spark.read.schema("grid_id string, pop1 double").csv(path, header=True)


K2 = f"""WITH met AS (SELECT grid_id, x0, y0 FROM $grid JOIN (SELECT DISTINCT floor(x / 500) AS px, floor(y / 500) AS py FROM $poi) ON cx = px AND cy = py),
corner AS (SELECT grid_id, k, x0 + 500 * [0, 1, 1, 0, 0][k] AS px, y0 + 500 * [0, 0, 1, 1, 0][k] AS py FROM met, range(1, 6) r(k)), {lon_lat_sql("corner")}
SELECT grid_id, 'Polygon' AS geometry_type, CAST(k AS INTEGER) AS corner, lon, lat FROM placed"""


@query("k2_geojson", K2)
def _(t):
    """The cells that have points as a layer in WGS84, written and read again, a row for each corner."""
    path = f"{_folder(t)}/cells"
    cells = t("grid").join(t("poi").select(F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 500).alias("cy")).distinct(), ["cx", "cy"])
    c = F.col
    polygon = sinks.geographic_polygon([(c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1"))])
    sinks.geojson(sinks.geojson_rows(cells, polygon, ["grid_id"]), path)
    read = sinks.read_geojson(t.spark, path, "grid_id:string")
    each = read.select("grid_id", "geometry_type", F.posexplode("ring").alias("n", "p"))
    return each.select("grid_id", "geometry_type", (F.col("n") + 1).alias("corner"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


K3 = """SELECT 'stations' AS section, point_id AS station_id, NULL AS socket_id, s_name, NULL AS current, NULL AS power FROM $station
UNION ALL SELECT 'sockets', station_id, socket_id, NULL, current, CAST(power AS DOUBLE) FROM $socket
UNION ALL SELECT 'counts', (SELECT count(*) FROM $station), (SELECT count(*) FROM $socket), NULL, NULL, NULL"""


@query("k3_registry_document", K3)
def _(t):
    """The registry's document written as text, and each of its lines read again."""
    path = f"{_folder(t)}/registry"
    stations = t("station").select(F.col("point_id").alias("station_id"), "s_name")
    sinks.registry_document(stations, t("socket").select("station_id", "socket_id", "current", F.col("power").cast("double").alias("power")), path)
    text = F.regexp_replace("value", r'^(,|\],"counts":)', "")
    body = F.from_json(F.when(F.col("value").startswith("],"), F.expr("substring(value, 12, length(value) - 12)")).otherwise(text), "station_id long, socket_id long, s_name string, current string, power double, stations long, sockets long")
    lines = t.spark.read.text(path).where("not value like '%:[' ").select("value", body.alias("b"))
    section = F.when(F.col("b.stations").isNotNull(), "counts").when(F.col("b.socket_id").isNotNull(), "sockets").otherwise("stations")
    first = lambda a, b: F.coalesce(F.col(f"b.{a}"), F.col(f"b.{b}"))
    return lines.select(section.alias("section"), first("station_id", "stations").alias("station_id"), first("socket_id", "sockets").alias("socket_id"), "b.s_name", "b.current", "b.power")


def exported(t: Tables):
    """Every candidate with the columns of the export, by integer arithmetic."""
    pc = lambda c: F.round(F.col(c) * 100, 4)
    n = F.substring("grid_id", 3, 20).cast("long")
    names = {
        "selection_rank": n, "longitude": F.round(32 + F.col("x") / 40000, 7), "latitude": F.round(39 + F.col("y") / 40000, 7), "priority_band": scoring.band(F.col("m1") * 100), "suitability_score": pc("m1"), "suitability_rank": n,
        "feasibility": pc("m2"), "need": pc("m3"), "accessibility": pc("m2"), "parking": pc("m3"), "infrastructure_gap": pc("m1"), "technology_gap": pc("m2"), "ml_consensus_percentile": pc("m2"), "ml_logistic_percentile": pc("m1"),
        "ml_random_forest_percentile": pc("m2"), "ml_hgb_percentile": pc("m3"), "ml_model_spread": F.round(F.abs(F.col("m1") - F.col("m3")) * 100, 4), "models_top_20pct_count": (n % 4).cast("int"), "model_disagreement": n % 4 < 3,
        "nearest_selected_grid_id": F.when(n % 7 == 0, F.concat(F.lit('C "'), n.cast("string"), F.lit('"'))), "nearest_selected_candidate_m": F.when(n % 7 == 0, F.col("x")),
    }
    return t("candidate").select("grid_id", *[c.alias(k) for k, c in names.items()])


EXPORTED = """WITH e AS (SELECT CAST(substr(grid_id, 3) AS BIGINT) AS n, * FROM $candidate)
SELECT n AS selection_rank, grid_id, round(32 + x / 40000, 7) AS longitude, round(39 + y / 40000, 7) AS latitude, CASE WHEN m1 * 100 >= 99 THEN 'A' WHEN m1 * 100 >= 95 THEN 'B' WHEN m1 * 100 >= 80 THEN 'C' WHEN m1 * 100 >= 50 THEN 'D' ELSE 'E' END AS priority_band,
  round(m1 * 100, 4) AS suitability_score, n AS suitability_rank, round(m2 * 100, 4) AS feasibility, round(m3 * 100, 4) AS need, round(m2 * 100, 4) AS accessibility, round(m3 * 100, 4) AS parking, round(m1 * 100, 4) AS infrastructure_gap, round(m2 * 100, 4) AS technology_gap,
  round(m2 * 100, 4) AS ml_consensus_percentile, round(m1 * 100, 4) AS ml_logistic_percentile, round(m2 * 100, 4) AS ml_random_forest_percentile, round(m3 * 100, 4) AS ml_hgb_percentile, round(abs(m1 - m3) * 100, 4) AS ml_model_spread, CAST(n % 4 AS INTEGER) AS models_top_20pct_count,
  n % 4 < 3 AS model_disagreement, CASE WHEN n % 7 = 0 THEN concat('C "', n, '"') END AS nearest_selected_grid_id, CASE WHEN n % 7 = 0 THEN x END AS nearest_selected_candidate_m FROM e"""


@query("k5_candidate_csv", EXPORTED)
def _(t):
    path = f"{_folder(t)}/candidates"
    e = exported(t)
    sinks.candidate_csv(e, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (e.schema[c] for c in sinks.CANDIDATE))
    read = t.spark.read.schema(schema).csv(path, header=True, escape='"', enforceSchema=True)
    return read.select(*[F.col(c) for c in sinks.CANDIDATE])


def shortlist(t: Tables):
    """The shortlist with all that the decision document tells of a candidate."""
    chosen = selection.diverse(ranked_points(t), 4000.0, 20)
    near = selection.spacing(chosen).select(F.col("point_id").alias("grid_id"), F.col("nearest_id").alias("nearest_selected_grid_id"), F.col("nearest_m").alias("nearest_selected_candidate_m"))
    listed = exported(t).drop("nearest_selected_grid_id", "nearest_selected_candidate_m", "selection_rank", "suitability_rank").join(chosen.select(F.col("point_id").alias("grid_id"), F.col("rank").alias("suitability_rank")), "grid_id").join(near, "grid_id")
    out = ranks.row_numbers(listed, "suitability_score", "grid_id", "selection_rank")
    models = F.array("ml_logistic_percentile", "ml_random_forest_percentile", "ml_hgb_percentile")
    more = {"suitability_percentile": F.col("suitability_score"), "score_explanation": F.concat(F.lit("band "), "priority_band"), "ml_consensus_rank": F.col("selection_rank"), "ml_min_percentile": F.array_min(models), "ml_max_percentile": F.array_max(models), "models_top_10pct_count": (F.col("selection_rank") % 3).cast("int"), "support_label": scoring.support_label("models_top_20pct_count")}
    return out.withColumns(more)


K4 = f"""{CHOSEN}, {NEAR}, x AS ({EXPORTED}),
l AS (SELECT x.*, c.rank AS original_rank, n.nearest_id, n.nearest_m, row_number() OVER (ORDER BY x.suitability_score DESC, x.grid_id) AS place FROM x JOIN chosen c ON c.point_id = x.grid_id JOIN near n ON n.point_id = x.grid_id)
SELECT '1.0' AS schema_version, CAST((SELECT count(*) FROM l) AS INTEGER) AS candidate_count, grid_id, place AS selection_rank, longitude, latitude, suitability_score AS score, original_rank AS rank, priority_band, concat('band ', priority_band) AS explanation,
  nearest_id AS nearest_selected_grid_id, round(nearest_m, 6) AS nearest_selected_candidate_m, ml_logistic_percentile AS logistic_regression_percentile, least(ml_logistic_percentile, ml_random_forest_percentile, ml_hgb_percentile) AS minimum_model_percentile,
  models_top_20pct_count >= 2 AS at_least_two_models_top_20pct, models_top_20pct_count = 3 AS all_models_top_20pct, [{", ".join(f"'{s}'" for s in scoring.SUPPORT)}][models_top_20pct_count + 1] AS support_label FROM l"""


@query("k4_decision_document", K4)
def _(t):
    """The shortlist's document, and its candidates read from its text again."""
    document = sinks.decision_document(shortlist(t), "fixture", 4000, "2024-01-01T00:00:00Z")
    location, spatial = "location:struct<longitude:double,latitude:double>", "spatial_diversity:struct<nearest_selected_grid_id:string,nearest_selected_candidate_m:double>"
    suitability = "suitability:struct<score:double,rank:bigint,priority_band:string,explanation:string>"
    support = "ml_support:struct<logistic_regression_percentile:double,minimum_model_percentile:double,at_least_two_models_top_20pct:boolean,all_models_top_20pct:boolean,support_label:string>"
    schema = f"schema_version string, candidate_count int, candidates array<struct<grid_id:string,selection_rank:bigint,{location},{suitability},{spatial},{support}>>"
    each = document.select(F.from_json("value", schema).alias("d")).select("d.schema_version", "d.candidate_count", F.explode("d.candidates").alias("c"))
    out = each.select("schema_version", "candidate_count", "c.grid_id", "c.selection_rank", "c.location.*", "c.suitability.*", "c.spatial_diversity.*", "c.ml_support.*")
    return out.withColumn("nearest_selected_candidate_m", F.round("nearest_selected_candidate_m", 6))


K6 = """WITH c AS (SELECT cv_fold, target, concat('B', CAST(floor(x / 5000) AS BIGINT), '_', CAST(floor(y / 5000) AS BIGINT)) AS spatial_block_id FROM $candidate),
b AS (SELECT spatial_block_id, count(*) AS row_count, sum(target) AS positive_count FROM c GROUP BY 1)
SELECT c.cv_fold, count(*) AS n, CAST(sum(b.row_count) AS BIGINT) AS block_rows, CAST(sum(b.positive_count) AS BIGINT) AS block_positives FROM c JOIN b USING (spatial_block_id) GROUP BY 1"""


@query("k6_fold_outputs", K6)
def _(t):
    """Rows and blocks, written and read again; each row meets its block's summary."""
    path = _folder(t)
    c = t("candidate").select("grid_id", "cv_fold", "target", grid.block_id("x", "y").alias("spatial_block_id"))
    sinks.fold_outputs(c, ml.block_summary(c, target="target"), path)
    met = t.spark.read.parquet(f"{path}/rows").join(t.spark.read.parquet(f"{path}/blocks"), "spatial_block_id")
    return met.groupBy("cv_fold").agg(F.count("*").alias("n"), F.sum("row_count").alias("block_rows"), F.sum("positive_count").alias("block_positives"))
