"""Places of values, looked up in what goes to every task or met where they are many."""

import random

import pytest
from pyspark.sql import functions as F

from siteselect.operators import ranks, scoring


def rows():
    draw = random.Random(5)
    return [(i, draw.choice([None, "x", "y"]), draw.choice([None, 0.0, 1.5, -2.0, 3.0]), float(draw.randint(0, 90)), None) for i in range(300)]


@pytest.mark.parametrize(("held", "dealt"), [(1 << 18, 1 << 21), (6, 50), (0, 50)])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_places_are_the_same_by_either_way(spark, monkeypatch, held, dealt, by):
    monkeypatch.setattr(ranks, "HELD", held, raising=False)
    monkeypatch.setattr(ranks, "DEALT", dealt, raising=False)
    given = rows()
    frame = spark.createDataFrame(given, "id int, g string, few double, many double, none double").repartition(3)
    out = ranks.with_places(frame, {"a": F.col("few"), "b": F.col("many"), "c": F.col("none")}, by)
    assert out.columns == ["id", "g", "few", "many", "none", *ranks.places(["a", "b", "c"])]
    found = {r["id"]: r for r in out.collect()}
    assert len(found) == len(given) == out.count()
    for i, g, few, many, _ in given:
        for name, at, v in (("a", 2, few), ("b", 3, many)):
            mates = [r[at] for r in given if r[at] is not None and (not by or r[1] == g)]
            want = (None, None, None) if v is None else (mates.count(v), sum(m < v for m in mates), len(mates))
            assert tuple(found[i][f"{name}_{c}"] for c in ("same", "below", "n")) == want
        assert found[i]["c_n"] is None


def test_few_values_are_looked_up_without_a_shuffle_of_the_rows(spark):
    """Each value of each row was shuffled twice, as a wide row the second time."""
    frame = spark.createDataFrame(rows(), "id int, g string, few double, many double, none double")
    plan = ranks.with_places(frame, {"a": F.col("few"), "b": F.col("many")}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


def test_consensus_without_a_rank_ranks_nothing(spark):
    frame = spark.createDataFrame([(1, 10.0, 90.0, 50.0)], "id int, p1 double, p2 double, p3 double")
    out = scoring.consensus(frame, ["p1", "p2", "p3"], ranked=False)
    assert "consensus_rank" not in out.columns and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert scoring.consensus(frame, ["p1", "p2", "p3"]).first()["consensus_rank"] == 1
