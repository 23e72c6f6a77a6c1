"""Spatial tables derived from the given ones by integer arithmetic, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    "grid": """SELECT concat('G_', lpad(CAST(i + 1 AS VARCHAR(20)), 6, '0')) AS grid_id, CAST(floor(i / 80.0) AS BIGINT) AS cx, CAST(i % 80 AS BIGINT) AS cy,
        CAST(floor(i / 80.0) * 500 AS DOUBLE) AS x0, CAST(i % 80 * 500 AS DOUBLE) AS y0, CAST(floor(i / 80.0) * 500 + 500 AS DOUBLE) AS x1, CAST(i % 80 * 500 + 500 AS DOUBLE) AS y1,
        CAST(250000 AS DOUBLE) AS cell_area_m2 FROM range(0, 6400) AS r(i)""",
    "poi": """SELECT event_id AS point_id, CAST(((user_id * 104729) % 40000 + (event_id * 7919) % 3000) % 40000 AS DOUBLE) AS x,
        CAST(((user_id * 1299709) % 40000 + (event_id * 15485863) % 3000) % 40000 AS DOUBLE) AS y, event_type, ts, value, props,
        event_type = 'purchase' AS is_retail, event_type = 'signup' AS is_education, event_type = 'view' AS is_health, event_type = 'click' AS is_transport FROM {events}""",
    "station": """SELECT s_suppkey AS point_id, CAST((s_suppkey * 104729 + 17) % 40000 AS DOUBLE) AS x, CAST((s_suppkey * 1299709 + 29) % 40000 AS DOUBLE) AS y,
        CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal / 1000.0) AS BIGINT) END AS capacity, s_suppkey % 5 = 0 AS has_ac, s_suppkey % 9 = 0 AS has_dc, s_name FROM {supplier}""",
    "parking": """SELECT p_partkey AS point_id, CAST((p_partkey * 7907) % 39000 AS DOUBLE) AS x0, CAST((p_partkey * 104723) % 39000 AS DOUBLE) AS y0,
        CAST((p_partkey * 7907) % 39000 + 20 + 4 * p_size AS DOUBLE) AS x1, CAST((p_partkey * 104723) % 39000 + 20 + 30 * (p_partkey % 7) AS DOUBLE) AS y1,
        CASE WHEN p_partkey % 25 = 0 THEN CAST(p_size AS BIGINT) END AS capacity FROM {part}""",
    "lot": """SELECT lot_id, x0, y0, x0 + w AS x1, y0 + h AS y1, holed FROM (SELECT p_partkey AS lot_id, CAST((p_partkey * 7907) % 36000 AS DOUBLE) AS x0, CAST((p_partkey * 104723) % 36000 AS DOUBLE) AS y0,
        CAST((20 + 4 * p_size) * CASE WHEN p_partkey % 40 = 0 THEN 10 ELSE 1 END AS DOUBLE) AS w, CAST((20 + 30 * (p_partkey % 7)) * CASE WHEN p_partkey % 40 = 0 THEN 10 ELSE 1 END AS DOUBLE) AS h,
        p_partkey % 2 = 0 AS holed FROM {part}) AS l""",
    "road": """SELECT * FROM (SELECT o_orderkey AS road_id, CAST((o_orderkey * 7919) % 38000 AS DOUBLE) AS x1, CAST((o_orderkey * 104729) % 38000 AS DOUBLE) AS y1,
        CAST((o_orderkey * 7919) % 38000 + (o_orderkey % 41 - 20) * 50 AS DOUBLE) AS x2, CAST((o_orderkey * 104729) % 38000 + (o_custkey % 37 - 18) * 50 AS DOUBLE) AS y2,
        o_orderpriority AS highway, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_main FROM {orders}) AS r WHERE x1 <> x2 OR y1 <> y2""",
    "pixel": """SELECT CAST(floor((c_custkey * 7919) % 160000 / 400.0) AS BIGINT) AS prow, CAST((c_custkey * 7919) % 160000 % 400 AS BIGINT) AS pcol,
        CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM {customer}""",
    "socket": """SELECT l_suppkey AS station_id, l_orderkey * 10 + l_linenumber AS socket_id,
        CASE l_returnflag WHEN 'A' THEN 'AC' WHEN 'R' THEN 'DC' ELSE 'UNKNOWN' END AS current, l_quantity AS power FROM {lineitem}""",
    "piece": """SELECT l_partkey AS object_id, CAST(l_linenumber AS BIGINT) AS chunk_order, l_extendedprice AS measure, l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS piece_id, l_quantity, l_discount, l_shipdate FROM {lineitem}""",
    "candidate": """SELECT concat('C_', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS grid_id, CAST((o_orderkey * 7919) % 40000 AS DOUBLE) AS x, CAST((o_orderkey * 104729) % 40000 AS DOUBLE) AS y,
        CAST(o_custkey % 4 AS BIGINT) AS main_road_segment_count, CAST(o_custkey % 4 * 125 AS DOUBLE) AS main_road_length_m, CAST((o_orderkey * 31) % 97 AS DOUBLE) / 8 AS road_density_km_per_km2,
        CAST((o_orderkey * 389) % 2003 AS DOUBLE) AS distance_to_main_road_m, CAST(greatest((o_orderkey * 71) % 5003 - 3000, 0) AS DOUBLE) AS parking_area_m2,
        CAST((o_orderkey * 977) % 3001 AS DOUBLE) AS distance_to_nearest_parking_m, CAST(greatest((o_orderkey * 13) % 17 - 9, 0) AS BIGINT) AS parking_count_within_1000m,
        CAST((o_orderkey * 577) % 40009 AS DOUBLE) AS distance_to_nearest_charging_station_m, CAST(greatest((o_orderkey * 7) % 11 - 8, 0) AS BIGINT) AS charging_station_count_within_2000m,
        CAST((o_orderkey * 3) % 5 % 2 AS BIGINT) AS ac_station_count_within_1000m, CAST((o_orderkey * 11) % 7 % 3 AS BIGINT) AS dc_station_count_within_1000m,
        CAST(o_orderkey % 5 AS INTEGER) AS cv_fold, CASE WHEN o_custkey % 23 = 0 THEN 1 ELSE 0 END AS target,
        CAST((o_orderkey * 193) % 1009 AS DOUBLE) / 1009 AS m1, CAST((o_orderkey * 449 + o_custkey % 23) % 503 AS DOUBLE) / 503 AS m2, CAST((o_orderkey * 83) % 211 AS DOUBLE) / 211 AS m3,
        CAST(greatest((o_orderkey * 53) % 401 - 100, 0) AS DOUBLE) AS pop0, CAST((o_orderkey * 53) % 401 + (o_orderkey * 19) % 307 AS DOUBLE) AS pop1, CAST((o_orderkey * 53) % 401 + (o_orderkey * 19) % 907 AS DOUBLE) AS pop2,
        o_totalprice FROM {orders}""",
}


def sql_for_duckdb(name: str) -> str:
    return FIXTURES[name].format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; names in braces are the given tables."""
    text = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **used)


def with_fixtures(sql: str) -> str:
    """SQL for DuckDB with the fixtures it names (as $name) as common tables."""
    names = list(dict.fromkeys(re.findall(r"\$(\w+)", sql)))
    body = re.sub(r"\$(\w+)", r"\1", sql).strip()
    head = ", ".join(f"{n} AS ({sql_for_duckdb(n)})" for n in names)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
