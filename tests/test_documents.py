"""Documents and layers that are written in parts, resumable ingest, and rules."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from siteselect.functions import clean
from siteselect.operators import checks, joins
from siteselect.sources import sinks
from siteselect.streaming import ingest


def test_each_part_of_a_layer_is_a_feature_collection(spark, tmp_path):
    cells = spark.range(0, 40, numPartitions=3).select(F.concat(F.lit("G"), "id").alias("grid_id"), (500000.0 + F.col("id") * 500).alias("x"), F.lit(4400000.0).alias("y"))
    c = F.col
    polygon = sinks.geographic_polygon([(c("x"), c("y")), (c("x") + 500, c("y")), (c("x") + 500, c("y") + 500), (c("x"), c("y") + 500)])
    path = str(tmp_path / "layer")
    sinks.geojson(sinks.geojson_rows(cells, polygon, ["grid_id"]), path)
    documents = [json.load(open(f)) for f in glob.glob(f"{path}/part-*")]
    assert len(documents) == 3 and all(d["type"] == "FeatureCollection" for d in documents)
    features = {f["properties"]["grid_id"]: f["geometry"] for d in documents for f in d["features"]}
    assert len(features) == 40 and all(g["type"] == "Polygon" and len(g["coordinates"][0]) == 5 and g["coordinates"][0][0] == g["coordinates"][0][4] for g in features.values())
    lon, lat = features["G0"]["coordinates"][0][0]
    assert lon == 33.0 and 39.7 < lat < 39.8
    assert sinks.read_geojson(spark, path, "grid_id:string").count() == 40
    sinks.geojson(sinks.geojson_rows(cells.limit(0), polygon, ["grid_id"]), path)
    assert sinks.read_geojson(spark, path, "grid_id:string").count() == 0
    sinks.geojson(sinks.geojson_rows(cells.where("grid_id in ('G1', 'G2')"), polygon, ["grid_id"]), path)
    documents = [json.load(open(f)) for f in glob.glob(f"{path}/part-*")]  # partitions without rows have documents, too
    assert sorted(len(d["features"]) for d in documents) == [0, 0, 2]


def test_a_registry_written_in_parts_is_one_document(spark, tmp_path):
    stations = spark.createDataFrame([(i, f'n"{i}' if i else None) for i in range(12)], "station_id long, name string")
    sockets = spark.createDataFrame([(i % 12, 100 + i, "AC") for i in range(30)], "station_id long, socket_id long, current string")
    path = str(tmp_path / "registry")
    sinks.registry_document(stations, sockets, path)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    document = json.loads(text)
    assert document["counts"] == {"stations": 12, "sockets": 30}
    assert sorted(s["station_id"] for s in document["stations"]) == list(range(12)) and {"station_id": 0, "name": None} in document["stations"]
    assert sorted(s["socket_id"] for s in document["sockets"]) == list(range(100, 130))
    sinks.registry_document(stations.limit(0), sockets.limit(0), path)
    assert json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))) == {"stations": [], "sockets": [], "counts": {"stations": 0, "sockets": 0}}


def test_a_batch_that_is_stopped_halfway_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    at, schema = str(tmp_path), "k long, v string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{at}/in")
    run = lambda: ingest.ingest_new(spark, f"{at}/in", schema, f"{at}/out", f"{at}/done", ["k"], buckets=8)
    put([(1, "a"), (2, "b"), (1, "c")])
    assert run() == 2
    put([(2, "late"), (3, "d"), (4, "e")])
    real = type(spark).createDataFrame

    def killed(self, *args, **how):
        raise OSError("killed before the manifest")

    monkeypatch.setattr(type(spark), "createDataFrame", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(type(spark), "createDataFrame", real)
    assert glob.glob(f"{at}/out/data/batch=*-1/bucket=*")  # written, but not committed
    assert ingest.ingested(spark, f"{at}/out").count() == 2
    assert run() == 4 and run() == 4
    got = {r["k"]: r["v"] for r in ingest.ingested(spark, f"{at}/out").collect()}
    assert got[2] == "b" and got[3] == "d" and set(got) == {1, 2, 3, 4}


def test_a_batch_reads_the_buckets_of_its_keys_alone(spark, tmp_path):
    at, schema = str(tmp_path), "k long, v string"
    spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("v")).coalesce(1).write.json(f"{at}/in")
    ingest.ingest_new(spark, f"{at}/in", schema, f"{at}/out", f"{at}/done", ["k"], buckets=64)
    known = ingest._read(spark, f"{at}/out", ingest._committed(spark, f"{at}/out"))
    assert known.select("bucket").distinct().count() == 64
    plan = known.where(F.col("bucket").isin([3, 5])).select("k", "bucket")
    assert "PartitionFilters: [bucket" in plan._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "bucket") or len(plan.inputFiles()) < len(known.inputFiles())


def test_stations_keep_the_first_of_equal_ids(spark):
    rows = [("node", 7, 2, {"socket:type2": "3"}), ("node", 7, 1, {"socket:type2": "2;1", "socket:chademo": "yes", "socket:foo": "no", "capacity": "4"}), ("way", 7, 1, {"capacity": "many"}), (None, 8, 1, {})]
    got = {r["station_id"]: r for r in clean.prepared_stations(spark.createDataFrame(rows, "type string, id long, pos int, tags map<string,string>")).collect()}
    assert set(got) == {"node_7", "way_7"}
    r = got["node_7"]
    assert (r["connector_types"], r["mapped_socket_type_count"], r["known_socket_count"], r["has_ac"], r["has_dc"], r["capacity_numeric"]) == ("chademo;type2", 2, 3.0, True, True, 4.0)
    r = got["way_7"]
    assert (r["connector_types"], r["mapped_socket_type_count"], r["known_socket_count"], r["has_ac"], r["has_dc"], r["capacity_numeric"]) == ("", 0, 0.0, False, False, None)


def test_duplicates_and_their_matches(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 500.0, 0.0, "b"), (3, None, 0.0, "c")], "point_id int, x double, y double, name string")
    reference = spark.createDataFrame([(10, 60.0, 80.0), (11, 900.0, 0.0)], "point_id int, x double, y double")
    got = {r["point_id"]: (r["matched_id"], r["distance"], r["duplicate"]) for r in joins.compared(points, reference, 100.0).collect()}
    assert got == {1: (10, 100.0, True), 2: (11, 400.0, False), 3: (None, None, False)}
    assert {r["name"] for r in joins.unmatched(points, reference, 100.0).collect()} == {"b", "c"}


def test_context_without_nulls(spark):
    base, context = spark.createDataFrame([("a",), ("b",)], "g string"), spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "g string, n int")
    assert {r["g"]: r["n"] for r in joins.attached(base, context, "g", ["n"]).collect()} == {"a": 1, "b": 2}
    for bad in (context.where("g <> 'b'"), context.replace(2, None, "n"), context.union(context)):
        with pytest.raises(Exception, match="no n for b|repeated g"):
            joins.attached(base, bad, "g", ["n"]).collect()


def test_rules_of_shortlists_registries_and_totals(spark):
    listed = spark.createDataFrame([(1, 1, 5.0, 5.0, 70.0, 3, None), (2, 2, 50.0, 5.0, 50.0, 4, 3.0), (2, 4, 5.0, None, 80.0, 0, 9.0)], "point_id int, rank int, x double, y double, score double, support int, nearest_m double")
    got = {r["rule"]: r["violations"] for r in checks.shortlist(listed, 4, 5.0, {"x": (0, 10), "y": (0, 10)}, {"score": 60}, ["support"]).collect()}
    assert {k for k, v in got.items() if v} == {"spacing below the minimum", "x outside 0 to 10", "y is missing or not finite", "score below 60", "support is not 0 to 3", "not 4 rows", "ids repeat", "ranks do not run from 1"}
    stations = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "station_id int, socket_count int")
    sockets = spark.createDataFrame([(1, "AC"), (1, "DC"), (2, "AC"), (2, "DC"), (9, "AC")], "station_id int, current string")
    got = {r["rule"]: r["violations"] for r in checks.registry(stations, sockets).collect()}
    assert got == {"AC and DC above the declared total": 1, "declared total differs": 1, "socket without station": 1, "socket_count differ from the whole": 2}
    assert [r["violations"] for r in checks.classes(stations.selectExpr("0 as t"), "t").collect()] == [0, 1]


def test_large_candidate_lists_are_written_in_parts(spark, tmp_path):
    """One task wrote the one file, however large the list was."""
    rows = spark.range(400).selectExpr("400 - id AS selection_rank", "concat('C \"', id, '\"') AS grid_id").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sinks.candidate_csv(rows, str(tmp_path / "many"), ["selection_rank", "grid_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sinks.candidate_csv(rows, str(tmp_path / "one"), ["selection_rank", "grid_id"])
    expected = [f'"{i}","C ""{400 - i}"""' for i in range(1, 401)]
    for folder, least, most in (("many", 2, 5), ("one", 1, 1)):
        files = [p.read_text(encoding="utf-8").splitlines() for p in sorted((tmp_path / folder).glob("part-*"))]
        assert least <= len(files) <= most and all(f[0] == '﻿"selection_rank","grid_id"' for f in files)
        assert [line for f in files for line in f[1:]] == expected
    read = spark.read.schema("selection_rank long, grid_id string").csv(str(tmp_path / "many"), header=True, escape='"', enforceSchema=True)
    assert {(r[0], r[1]) for r in read.collect()} == {(400 - i, f'C "{i}"') for i in range(400)}
