"""Joint logistic fits against a direct solver, shuffles, and studies without stand-ins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteselect.operators import ml, studies
from siteselect.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


def table(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(3, 2), rng.gauss(0, 50), rng.random()
        rows.append((f"g{i:04d}", i % 5, int(rng.random() < 1 / (1 + np.exp(-(a - 4 + b / 60)))), a, b, c, 7.0))
    return spark.createDataFrame(rows, "grid_id string, cv_fold int, y int, a double, b double, c double, flat double"), rows


def direct(rows, at, held, c=1.0):
    """Coefficients per deviation, by plain gradient descent with momentum on one array."""
    kept = [r for r in rows if r[1] != held]
    x, y = np.array([[r[i] for i in at] for r in kept]), np.array([r[2] for r in kept], float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / std], axis=1)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(20000):
        p = 1 / (1 + np.exp(-z @ w))
        g = c * z.T @ (s * (p - y)) + np.concatenate([[0], w[1:]])
        v = 0.9 * v - 0.5 / len(y) * g
        w = w + v
    return w, mean, std


def test_joint_fits_equal_a_direct_solver(spark):
    frame, rows = table(spark)
    sets = {"all": ["a", "b", "c"], "one": ["b"], "flat": ["a", "flat"]}
    models = studies.fit_logistic(frame.repartition(7), sets, "y", [0, 3, None])
    assert set(models) == {(s, f) for s in sets for f in (0, 3, None)}
    columns = {"a": 3, "b": 4, "c": 5, "flat": 6}
    for (name, held), m in models.items():
        w, mean, std = direct(rows, [columns[c] for c in sets[name]], held)
        assert np.allclose(m.standardised, w[1:], atol=1e-6)
        assert np.allclose(m.coefficients, w[1:] / std, atol=1e-6) and abs(m.intercept - (w[0] - (w[1:] / std) @ mean)) < 1e-5
    weak = studies.fit_logistic(frame, {"all": ["a", "b", "c"]}, "y", [None], c=0.01)["all", None]
    assert np.allclose(weak.standardised, direct(rows, [3, 4, 5], None, 0.01)[0][1:], atol=1e-6)
    with pytest.raises(Exception, match="null"):
        studies.fit_logistic(frame.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), {"s": ["a"]}, "y", [None])
    with pytest.raises(ValueError, match="class"):
        studies.fit_logistic(frame.where("y = 1"), {"s": ["a"]}, "y", [None])


def test_scores_come_from_the_model_that_did_not_see_the_fold(spark):
    frame, rows = table(spark)
    out = ml.configurations(frame, {"all": ["a", "b"], "one": ["a"]}, ["logistic", "prior"], "y", range(5)).collect()
    assert len(out) == 4 * len(rows) and {(r["model"], r["feature_set"]) for r in out} == {(m, s) for m in ("logistic", "prior") for s in ("all", "one")}
    w, mean, std = direct(rows, [3, 4], 2)
    by_id = {r[0]: r for r in rows}
    for r in out:
        if r["model"] == "logistic" and r["feature_set"] == "all" and r["cv_fold"] == 2:
            z = w[0] + ((np.array(by_id[r["grid_id"]][3:5]) - mean) / std) @ w[1:]
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    with pytest.raises(ValueError, match="options"):
        ml.configurations(frame, {"all": ["a"]}, ["logistic"], "y", range(5), options={"logistic": {"seed": 1}})


def test_shuffles_keep_each_folds_values_and_change_one_feature(spark):
    frame, rows = table(spark, 300)
    by_id = {r[0]: r for r in rows}
    out = studies.shuffles(frame, ["a", "b"], 3).collect()
    assert len(out) == 300 * 2 * 3
    again = {(r["grid_id"], r["feature"], r["repeat"]): r["a"] for r in studies.shuffles(frame.repartition(5), ["a", "b"], 3).collect()}
    assert again == {(r["grid_id"], r["feature"], r["repeat"]): r["a"] for r in out}
    for repeat in range(3):
        for f in range(5):
            part = [r for r in out if r["repeat"] == repeat and r["cv_fold"] == f]
            for feature, at in (("a", 3), ("b", 4)):
                other = {"a": "b", "b": "a"}[feature]
                mine = [r for r in part if r["feature"] == feature]
                assert sorted(r[feature] for r in mine) == sorted(r[at] for r in rows if r[1] == f)
                assert all(r[other] == by_id[r["grid_id"]][{"a": 3, "b": 4}[other]] and r["c"] == by_id[r["grid_id"]][5] for r in mine)
                assert sum(r[feature] != by_id[r["grid_id"]][at] for r in mine) > 0.8 * len(mine)


def test_importance_finds_the_feature_that_counts(spark):
    frame, _ = table(spark)
    models = studies.fit_logistic(frame, {"m": ["a", "b", "c"]}, "y", range(5))
    drops = studies.importance(frame, ["a", "b", "c"], lambda rows, columns: studies.score_logistic(rows, models, "y", columns), repeats=4)
    assert drops.count() == 12
    summary = ml.importance_summary(drops).collect()
    assert [r["drop_mean"] for r in summary] == sorted((r["drop_mean"] for r in summary), reverse=True)
    found = {r["feature"]: r for r in summary}
    assert summary[0]["feature"] == "a" and found["a"]["auc_drop_mean"] > 0.05 > abs(found["c"]["auc_drop_mean"])
    assert found["a"]["positive_fraction"] == 1.0


def test_tree_models_of_all_folds(spark):
    frame, rows = table(spark, 300)
    for options in ({"forest": {"trees": 3, "split": "sqrt"}}, {"forest": {"trees": 3, "split": "3"}}, {"boosting": {"rounds": 2}}):
        out = ml.configurations(frame, {"all": ["a", "b", "c"]}, list(options), "y", range(5), options=options).collect()
        assert len(out) == len({r["grid_id"] for r in out}) == 300 and all(0 <= r["score"] <= 1 for r in out)
    assert ml.estimator("forest").getFeatureSubsetStrategy() == "sqrt" and ml.estimator("forest", split="3").getFeatureSubsetStrategy() == "3"
    assert ml.estimator("forest").getNumTrees() == 400 and ml.estimator("boosting").getMaxIter() == 150


@pytest.mark.parametrize("name", ["m20_feature_group_ablation", "m21_redundancy_sensitivity", "m22_incremental_value"])
def test_studies_have_a_row_for_each_configuration(spark, monkeypatch, name):
    from siteselect.plans import ml_queries

    monkeypatch.setitem(ml_queries.OPTIONS, "forest", {"trees": 2, "depth": 3, "split": "3"})
    monkeypatch.setitem(ml_queries.OPTIONS, "boosting", {"rounds": 1})
    got = catalog.QUERIES[name](spark, SF).collect()
    assert len(got) == {"m20_feature_group_ablation": 9, "m21_redundancy_sensitivity": 9, "m22_incremental_value": 16}[name]
    assert all(0 <= r["ap"] <= 1 and 0 <= r["auc"] <= 1 for r in got)
    if name == "m22_incremental_value":
        assert all(r["ap_delta"] == 0 for r in got if r["feature_set"] == "baseline" or r["model"] == "prior")
    if name == "m21_redundancy_sensitivity":  # scaling a column does not change a standardised fit
        ap = {r["feature_set"]: r["ap"] for r in got if r["model"] == "logistic"}
        assert ap["normalised"] == pytest.approx(ap["raw"], abs=1e-9)


def test_fits_have_all_cores_and_one_queue(spark, monkeypatch):
    """Rows of one file are dealt to a part for each core, and the fits of all seeds and folds stand in one queue (they came set by set, and out_of_fold's one by one)."""
    frame, _ = table(spark, 200)
    assert ml.spread(frame.coalesce(1), "grid_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    taken = []
    monkeypatch.setattr(ml, "fitted_all", lambda rows, target, plans, real=ml.fitted_all: taken.append(len(plans)) or real(rows, target, plans))
    out = ml.configurations(frame, {"one": ["a"]}, ["forest"], "y", [0, 1], (1, 2), options={"forest": {"trees": 1, "depth": 2}})
    assert taken == [4] and {r["seed"] for r in out.select("seed").distinct().collect()} == {1, 2}
    assert ml.out_of_fold(frame, ["a"], "y", "forest", [0, 1], trees=1, depth=2).count() == 80 and taken == [4, 2]


@pytest.mark.parametrize("name", ["m20_feature_group_ablation", "m21_redundancy_sensitivity", "m22_incremental_value", "m25_m27_permutation_importance"])
def test_studies_have_models_of_full_size(spark, monkeypatch, name):
    """They had forests of 10 trees and 5 rounds of boosting."""

    class Asked(Exception):
        pass

    def asked(rows, target, plans):
        raise Asked([(m, ml.estimator(m, **options)) for _, m, _, options in plans])

    monkeypatch.setattr(ml, "fitted_all", asked)
    with pytest.raises(Asked) as caught:
        catalog.QUERIES[name](spark, SF)
    (models,) = caught.value.args
    assert {m for m, _ in models} == {"forest", "boosting"}
    assert all(e.getNumTrees() == 400 and e.getMaxDepth() == 12 if m == "forest" else e.getMaxIter() == 150 and e.getMaxDepth() == 4 for m, e in models)


def test_shuffled_rows_are_scored_by_all_cores(spark):
    """Merged shuffles left their models to few tasks."""
    frame, _ = table(spark, 200)
    models, parts = studies.fit_logistic(frame, {"m": ["a"]}, "y", range(5)), []

    def score(rows, columns):
        parts.append(rows.rdd.getNumPartitions())
        return studies.score_logistic(rows, models, "y", columns)

    assert studies.importance(frame, ["a"], score, repeats=2).count() == 2
    assert parts[1] >= 3 * spark.sparkContext.defaultParallelism
