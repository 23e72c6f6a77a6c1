"""Each registered query of the library against its SQL, or its rows, on the smallest tables."""

import oracle
import pytest

from siteselect.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()
SLOW = {"m8_forest_out_of_fold", "m9_boosting_out_of_fold", "m20_feature_group_ablation", "m21_redundancy_sensitivity", "m22_incremental_value", "m23_forest_three_a_split", "m24_seed_stability", "m25_m27_permutation_importance"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    oracle.compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0 or name == "g6_buffer_filter"


SETS = {"m6_m7_logistic_out_of_fold": 1, "m8_forest_out_of_fold": 1, "m23_forest_three_a_split": 1, "m9_boosting_out_of_fold": 1}


@pytest.fixture
def small(monkeypatch):
    """Models of the same kinds with fewer trees and rounds."""
    from siteselect.plans import ml_queries

    monkeypatch.setitem(ml_queries.SMALL, "trees", 2)
    monkeypatch.setitem(ml_queries.SMALL, "rounds", 1)
    monkeypatch.setitem(ml_queries.OPTIONS, "forest", {"trees": 1, "depth": 2, "split": "3"})
    monkeypatch.setitem(ml_queries.OPTIONS, "boosting", {"rounds": 1})


@pytest.mark.parametrize("name", sorted(SETS))
def test_every_candidate_is_scored_out_of_fold(spark, small, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    ids = {r["grid_id"] for r in rows}
    assert len(rows) == len(ids) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows}) > 5


def test_importance_takes_every_model_and_feature(spark, small):
    from siteselect.plans.ml_queries import FEATURES

    rows = catalog.QUERIES["m25_m27_permutation_importance"](spark, SF).collect()
    assert {(r["model"], r["feature"]) for r in rows} == {(m, f) for m in ("logistic", "forest", "boosting") for f in FEATURES}
    for m in ("logistic", "forest", "boosting"):
        drops = [r["drop_mean"] for r in rows if r["model"] == m]
        assert drops == sorted(drops, reverse=True)


def test_seeds_are_paired(spark, small):
    rows = catalog.QUERIES["m24_seed_stability"](spark, SF).collect()
    assert len(rows) == 1 and rows[0]["seeds"] == 5 and 0 <= rows[0]["wins"] <= 5
