"""Cleaning functions on texts, numbers, flags and tags that the given tables yield."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteselect.functions import clean
from siteselect.operators import features
from siteselect.plans.catalog import query


@query("t1_clean_text", r"SELECT p_partkey, trim(regexp_replace(concat('  ', p_name, chr(9), ' ', p_brand, '  '), '\s+', ' ', 'g')) AS text FROM part")
def _(t):
    return t("part").select("p_partkey", clean.clean_text(F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_brand", F.lit("  "))).alias("text"))


@query("t2_first_number", r"SELECT c_custkey, CASE WHEN v >= 0 THEN v END AS number FROM (SELECT c_custkey, TRY_CAST(nullif(regexp_extract(replace(concat('about ', replace(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR), '.', ','), ' kW'), ',', '.'), '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS v FROM customer)")
def _(t):
    text = F.concat(F.lit("about "), F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" kW"))
    return t("customer").select("c_custkey", clean.first_number(text).alias("number"))


@query("t3_strict_number", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN v >= 0 THEN v END AS number FROM (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS v FROM customer)")
def _(t):
    text = F.concat(F.lit(" "), F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.when(F.col("c_custkey") % 7 == 0, " places").otherwise(" "))
    return t("customer").select("c_custkey", clean.strict_number(text).alias("number"))


@query("t4_integer_or_default", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE CAST(greatest(round_even(c_acctbal, 0), 0) AS BIGINT) END AS whole, CASE WHEN c_custkey % 5 = 0 THEN 0.5 ELSE greatest(c_acctbal, 0.0) END AS part FROM customer")
def _(t):
    text = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return t("customer").select("c_custkey", clean.integer_or(text, 3).alias("whole"), clean.float_or(text, 0.5).alias("part"))


@query("t5_digits_only", r"SELECT s_suppkey, regexp_replace(concat('SRJ/', s_name), '\D', '', 'g') AS digits FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", clean.digits(F.concat(F.lit("SRJ/"), "s_name")).alias("digits"))


@query("t6_tag_values", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE concat(p_brand, ';', p_type) END AS tags FROM part")
def _(t):
    nested = F.array(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" ")), F.array(F.col("p_type"), F.col("p_brand")))
    return t("part").select("p_partkey", clean.join_tags(nested).alias("tags"))


@query("t7_enumerations", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS green, CASE l_returnflag WHEN 'A' THEN 'AC' WHEN 'R' THEN 'DC' ELSE 'UNKNOWN' END AS current FROM lineitem")
def _(t):
    green = F.when(F.col("l_linestatus") == "O", " EVET ").otherwise("HAYIR")
    current = F.when(F.col("l_returnflag") == "A", " ac type 2").when(F.col("l_returnflag") == "R", "Dc").otherwise("?")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", clean.green_flag(green).alias("green"), clean.current_type(current).alias("current"))


@query("t8_boolean", "SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS flag FROM supplier")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "1", "no", "maybe")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t("supplier").select("s_suppkey", clean.boolean(text).alias("flag"))


@query("t9_socket_availability", "SELECT p_partkey, p_size > 25 OR p_size % 2 = 1 AS available FROM part")
def _(t):
    text = F.when(F.col("p_size") > 25, "yes").when(F.col("p_size") % 2 == 1, F.concat(F.lit("0; "), F.col("p_size").cast("string"))).otherwise("no")
    return t("part").select("p_partkey", clean.socket_available(text).alias("available"))


@query("t10_socket_count", "SELECT p_partkey, CAST(p_size + p_partkey % 3 AS DOUBLE) AS n FROM part")
def _(t):
    text = F.concat_ws(";", F.col("p_size").cast("string"), F.lit("-4"), F.lit("x"), (F.col("p_partkey") % 3).cast("string"))
    return t("part").select("p_partkey", clean.socket_count(text).alias("n"))


STATIONS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem),
s AS (SELECT concat(CASE WHEN l_linenumber % 2 = 0 THEN 'node' ELSE 'way' END, '_', l_suppkey) AS station_id, l_orderkey % 3 = 0 AS c, l_orderkey % 2 = 0 AS t, CAST(l_linenumber AS DOUBLE) AS n, CAST(l_quantity AS DOUBLE) AS q, l_returnflag FROM e WHERE r = 1)
SELECT station_id, CASE WHEN c AND t THEN 'chademo;type2' WHEN c THEN 'chademo' WHEN t THEN 'type2' ELSE '' END AS connector_types, CAST(c AS INTEGER) + CAST(t AS INTEGER) AS mapped_socket_type_count,
  CASE WHEN c THEN 2.0 ELSE 0.0 END + CASE WHEN t THEN n + 1 ELSE 0.0 END AS known_socket_count, t AS has_ac, c AS has_dc, CASE WHEN l_returnflag <> 'A' THEN q END AS capacity_numeric FROM s"""


@query("t11_station_preparation", STATIONS)
def _(t):
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("; 1"))
    chademo, type2 = F.when(F.col("l_orderkey") % 3 == 0, "2").otherwise("no"), F.when(F.col("l_orderkey") % 2 == 0, text).otherwise("0")
    capacity = F.when(F.col("l_returnflag") == "A", "about 4").otherwise(F.concat(F.lit(" "), F.translate(F.col("l_quantity").cast("double").cast("string"), ".", ",")))
    tags = F.create_map(F.lit("socket:type2"), type2, F.lit("socket:chademo"), chademo, F.lit("capacity"), capacity, F.lit("name"), F.lit("x"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "node").otherwise("way")
    each = t("lineitem").select(kind.alias("type"), F.col("l_suppkey").alias("id"), F.struct("l_orderkey", "l_linenumber").alias("pos"), tags.alias("tags"))
    columns = ("station_id", "connector_types", "mapped_socket_type_count", "known_socket_count", "has_ac", "has_dc", "capacity_numeric")
    return clean.prepared_stations(each).select(*columns)


@query("t12_parking_preparation", "SELECT point_id, (x1 - x0) * (y1 - y0) AS area_m2, CAST(capacity AS DOUBLE) AS capacity FROM $parking")
def _(t):
    from siteselect.functions import geo
    from siteselect.plans.spatial_queries import ring

    twice = t("parking").union(t("parking"))
    one = features.first_rows(twice, ["point_id"], ["x0", "y0"])
    return one.select("point_id", F.round(geo.area(ring()), 2).alias("area_m2"), clean.strict_number(F.col("capacity").cast("string")).alias("capacity"))


@query("t13_road_preparation", "SELECT road_id, CASE highway WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary;service' ELSE 'residential' END AS tags, highway IN ('1-URGENT', '2-HIGH') AS is_main, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 2) AS length_m FROM $road")
def _(t):
    from siteselect.functions import geo

    h = F.col("highway")
    tags = F.when(h == "1-URGENT", F.array(F.lit("motorway"))).when(h == "2-HIGH", F.array(F.lit("primary"), F.lit(" service"), F.lit("primary"))).otherwise(F.array(F.lit("residential")))
    return t("road").select("road_id", clean.join_tags(F.array(tags)).alias("tags"), clean.is_main_road(clean.tag_values(F.array(tags))).alias("is_main"), F.round(geo.distance("x1", "y1", "x2", "y2"), 2).alias("length_m"))


def poi_tags():
    kind, odd = F.col("event_type"), F.col("point_id") % 10 == 0
    return F.create_map(F.lit("shop"), F.when(kind == "purchase", F.when(odd, "vacant").otherwise("bakery")).otherwise("no"), F.lit("amenity"), F.when(kind == "signup", "school").when(kind == "view", "Clinic").otherwise(""), F.lit("highway"), F.when(kind == "click", "bus_stop").otherwise("none"))


@query("t14_activity_categories", "SELECT point_id, event_type = 'purchase' AND point_id % 10 <> 0 AS is_retail_commercial, event_type = 'signup' AS is_education, event_type = 'view' AS is_healthcare, event_type = 'click' AS is_transport_activity FROM $poi")
def _(t):
    tagged = t("poi").select("point_id", poi_tags().alias("tags"))
    return tagged.select("point_id", *[c.alias(k) for k, c in clean.categories("tags").items()])


@query("t16_unique_text", "SELECT o_custkey, string_agg(p, ';' ORDER BY k) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def _(t):
    return t("orders").groupBy("o_custkey").agg(clean.unique_text("o_orderkey", "o_orderpriority").alias("priorities"))


@query("t17_numeric_conversion", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS v, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS target FROM customer")
def _(t):
    raw = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.when(F.col("c_custkey") % 8 == 0, "NaN").otherwise("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("v"), (F.col("c_custkey") % 3).cast("string").alias("b"))
    return clean.numeric(raw, ["v"]).select("c_custkey", "v", clean.binary("b").alias("target"))


@query("t18_padded_ids", "SELECT o_orderkey, concat('CELL_', lpad(CAST(o_orderkey + 1 AS VARCHAR), 7, '0')) AS grid_id FROM orders")
def _(t):
    return t("orders").select("o_orderkey", clean.padded_id(F.col("o_orderkey") + 1, "CELL_", 7).alias("grid_id"))


@query("t19_usable_geometries", "SELECT point_id FROM $parking WHERE y1 - y0 > 20")
def _(t):
    from siteselect.plans.spatial_queries import ring

    shaped = t("parking").select("point_id", F.when(F.col("y1") - F.col("y0") > 20, "Polygon").otherwise("Point").alias("geometry_type"), ring().alias("ring"))
    return shaped.where(clean.usable("geometry_type", "ring")).select("point_id")


@query("t20_column_by_candidates", "SELECT s_suppkey AS station_id, count(*) OVER () AS n FROM supplier")
def _(t):
    s = t("supplier")
    key = clean.first_column(s, ["station_id", "osm_id", "s_suppkey"])
    return s.select(F.col(key).alias("station_id")).join(F.broadcast(s.agg(F.count("*").alias("n"))), F.lit(True))


@query("t21_station_normalisation", "SELECT CAST(s_suppkey AS VARCHAR) AS station_id, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS capacity, s_suppkey % 2 = 1 AS has_ac FROM supplier")
def _(t):
    raw = t("supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("station_id"), F.col("s_acctbal").cast("string").alias("capacity"), (F.col("s_suppkey") % 2).cast("string").alias("has_ac"))
    return clean.stations(raw, "station_id", "capacity", ["has_ac"])


@query("t22_chunk_provenance", "SELECT concat('K_', lpad(CAST(l_linenumber AS VARCHAR), 3, '0')) AS chunk_id, CAST(l_linenumber AS BIGINT) AS chunk_order, concat('K_', lpad(CAST(l_linenumber AS VARCHAR), 3, '0'), '_', CAST(l_orderkey AS VARCHAR), '_', CAST(l_partkey AS VARCHAR)) AS piece FROM lineitem")
def _(t):
    return clean.provenance(t("lineitem"), "l_linenumber", ["l_orderkey", "l_partkey"], out="piece").select("chunk_id", "chunk_order", "piece")


A9 = """WITH o AS (SELECT station_id, current, min(socket_id) AS k FROM $socket GROUP BY 1, 2), types AS (SELECT station_id, string_agg(current, ';' ORDER BY k, current) AS current_types FROM o GROUP BY 1),
s AS (SELECT station_id, count(DISTINCT socket_id) AS socket_count, count(*) FILTER (WHERE current = 'AC') AS ac_count, count(*) FILTER (WHERE current = 'DC') AS dc_count, count(power) AS known_power_count,
  sum(power) AS total_power_kw, max(power) AS max_power_kw, bool_or(current = 'AC') AS has_ac, bool_or(current = 'DC') AS has_dc FROM $socket GROUP BY station_id)
SELECT * FROM s JOIN types USING (station_id)"""


@query("a9_sockets_by_station", A9)
def _(t):
    return features.sockets_by_station(t("socket"))


@query("a10_station_rows", "SELECT l_suppkey AS station_id, min(l_orderkey * 10 + l_linenumber) AS first_row FROM lineitem GROUP BY 1")
def _(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("station_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_row"))
    return features.first_rows(rows, ["station_id"], ["first_row"])


@query("a11_forward_fill", "SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS header FROM orders")
def _(t):
    raw = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("header"))
    return features.forward_fill(raw, "o_custkey", "o_orderkey", ["header"])


@query("a12_station_dataset", "SELECT s_suppkey AS station_id, s_name, CAST(coalesce(n, 0) AS INTEGER) AS socket_count, coalesce(p, 0) AS total_power_kw FROM supplier LEFT JOIN (SELECT station_id, count(DISTINCT socket_id) AS n, sum(power) AS p FROM $socket GROUP BY 1) ON station_id = s_suppkey")
def _(t):
    return features.station_dataset(t("supplier").select(F.col("s_suppkey").alias("station_id"), "s_name"), t("socket"))


@query("a13_piece_dedup", "SELECT object_id, l_quantity, chunk_order, piece_id, n FROM (SELECT *, row_number() OVER (PARTITION BY object_id, l_quantity ORDER BY chunk_order, piece_id, measure) AS r, count(*) OVER (PARTITION BY object_id, l_quantity) AS n FROM $piece) WHERE r = 1")
def _(t):
    p = t("piece")
    n = p.groupBy("object_id", "l_quantity").agg(F.count("*").alias("n"))
    return features.first_rows(p, ["object_id", "l_quantity"], ["chunk_order", "piece_id", "measure"]).join(n, ["object_id", "l_quantity"]).select("object_id", "l_quantity", "chunk_order", "piece_id", "n")


@query("a14_largest_object", "SELECT object_id, measure, chunk_order, occurrences, variants FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY measure DESC, chunk_order, piece_id) AS r FROM $piece) JOIN (SELECT object_id, count(*) AS occurrences, count(DISTINCT measure) AS variants FROM $piece GROUP BY 1) USING (object_id) WHERE r = 1")
def _(t):
    return features.largest_objects(t("piece")).select("object_id", "measure", "chunk_order", "occurrences", "variants")


@query("a20_value_counts", "SELECT CASE WHEN y1 - y0 > 20 THEN 'Polygon' ELSE 'Point' END AS geometry_type, count(*) AS n FROM $parking GROUP BY 1")
def _(t):
    kind = F.when(F.col("y1") - F.col("y0") > 20, "Polygon").otherwise("Point")
    return features.value_counts(t("parking").withColumn("geometry_type", kind), "geometry_type")


@query("a20_source_counts", "SELECT event_type, count(*) AS n FROM $poi GROUP BY 1")
def _(t):
    return features.value_counts(t("poi"), "event_type")
