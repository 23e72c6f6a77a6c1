"""Forests that grow in common passes, against Spark ML's and against their own rules."""

import numpy as np
import pytest

from siteselect.operators import ml, trees


def table(spark, n=3000, parts=3):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = (x[:, 0] * x[:, 1] + 0.4 * rng.normal(size=n) > 0.6).astype(int)
    rows = [(f"g{i}", int(i % 5), int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "grid_id string, cv_fold int, y int, a double, b double, c double, d double").repartition(parts), rows


FEATURES = ["a", "b", "c", "d"]


def test_all_forests_of_a_study_grow_in_one_pass_for_each_level(spark, monkeypatch):
    """Ten forests were ten fits, each with its own passes over the rows."""
    frame, _ = table(spark)
    passes = []
    monkeypatch.setattr(trees, "_counting", lambda shared, level, real=trees._counting: passes.append(level) or real(shared, level))
    options = {"forest": {"trees": 3, "depth": 4, "split": "3"}}
    out = ml.configurations(frame, {"two": FEATURES[:2], "all": FEATURES}, ["forest"], "y", range(5), (7, 21), options=options).collect()
    assert passes == [0, 1, 2, 3]
    assert len(out) == len({(r["feature_set"], r["seed"], r["grid_id"]) for r in out}) == 4 * 3000


def test_forest_is_as_good_as_spark_mls(spark):
    frame, _ = table(spark)
    frame = frame.cache()
    own = {f: ml.fitted_all(frame, "y", [(FEATURES, "forest", f, {"trees": 10, "depth": 6, "split": "sqrt"})])[0] for f in (0,)}
    mine = ml.average_precision(ml.score_folds(own, frame, "y", ["grid_id"]), []).first()
    spark_ml = {0: ml.fit(frame.where("cv_fold != 0"), FEATURES, "y", "forest", trees=10, depth=6, split="sqrt")}
    theirs = ml.average_precision(ml.score_folds(spark_ml, frame, "y", ["grid_id"]), []).first()
    assert mine["n"] == theirs["n"] == 600 and mine["auc"] > 0.85 and abs(mine["auc"] - theirs["auc"]) < 0.03 and abs(mine["ap"] - theirs["ap"]) < 0.06
    assert own[0].importances == pytest.approx(spark_ml[0].stages[-1].featureImportances.toArray(), abs=0.1)
    assert [r["feature"] for r in ml.coefficients(own[0], frame, FEATURES).collect()][:2] in (["a", "b"], ["b", "a"])


def test_trees_keep_their_rules_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 3)
    frame, rows = table(spark)
    plans = [(FEATURES, "forest", 1, {"trees": 4, "depth": 6, "split": "2"}), (["d", "a"], "forest", None, {"trees": 1, "seed": 5, "depth": 3})]
    ask = lambda df: trees.fit_forests(df, "y", [(own, held, ml.estimator("forest", **o)) for own, _, held, o in plans])
    found, again = ask(frame), ask(frame.repartition(7))
    for one, other in zip(found, again, strict=True):
        assert all(np.array_equal(p, q) for a, b in zip(one.trees, other.trees, strict=True) for p, q in zip(a, b, strict=True))
    assert found[1].cuts[0].tolist() == [0.0, 1.0] and [len(f.trees) for f in found] == [4, 1]
    hashes = {r["grid_id"]: r["h"] for r in frame.selectExpr("grid_id", f"xxhash64({', '.join(sorted(frame.columns))}) AS h").collect()}
    kept = [r for r in rows if r[1] != 1]
    drawn = trees._drawn(np.array([hashes[r[0]] for r in kept]).view(np.uint64), 42, 0)
    assert abs(drawn.mean() - 1) < 0.06 and abs(drawn.var() - 1) < 0.15
    codes = trees._codes(np.array([r[3:] for r in kept]), found[0].cuts)
    feature, cut, child, share = found[0].trees[0]
    at = trees._walked(codes, feature, cut, child, 6, chunk=100)
    y = np.array([r[2] for r in kept])
    weight = {t: len(y) / (2 * (y == t).sum()) for t in (0, 1)}
    for leaf in np.unique(at):
        assert child[2 * leaf] == leaf
        n = [drawn[(at == leaf) & (y == t)].sum() for t in (0, 1)]
        assert sum(n) == 0 or sum(n) >= 5
        if sum(n):
            assert share[leaf] == pytest.approx(n[1] * weight[1] / (n[0] * weight[0] + n[1] * weight[1]))
    first = (codes[feature[0]] > cut[0]) * 1  # the root's split is the best of the two features that it tries

    def left(split):
        sides = [[drawn[(split == s) & (y == t)].sum() * weight[t] for t in (0, 1)] for s in (0, 1)]
        return sum(a + b - (a * a + b * b) / (a + b) if a + b else 0 for a, b in sides)

    tried = trees._tried(42, 0, 0, 1, 4, 2)[0]
    assert left(first) == pytest.approx(min(left((codes[i] > c) * 1) for i in tried for c in range(31)))


def test_nulls_and_other_classes_are_errors(spark):
    frame, _ = table(spark, 50)
    forest = ml.estimator("forest", trees=1)
    with pytest.raises(ValueError, match="null"):
        trees.fit_forests(frame.selectExpr("*", "if(a > 0, a, null) AS e"), "y", [(["e"], 0, forest)])
    with pytest.raises(ValueError, match="values"):
        trees.fit_forests(frame.selectExpr("*", "cv_fold AS z"), "z", [(["a"], 0, forest)])
    with pytest.raises(ValueError, match="no rows"):
        trees.fit_forests(frame.where("cv_fold = 0"), "y", [(["a"], 0, forest)])


def steps(spark, n=3000):
    """Few values, all of which both implementations may split at."""
    rng = np.random.default_rng(8)
    x = np.clip(np.round(2 * rng.normal(size=(n, 3))), -8, 8)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=n) > 1).astype(int)
    rows = [(f"g{i}", int(i % 5), int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "grid_id string, cv_fold int, y int, a double, b double, c double").repartition(3).cache()


def test_boosting_equals_spark_mls(spark):
    frame = steps(spark)
    own = {0: ml.fitted_all(frame, "y", [(["a", "b", "c"], "boosting", 0, {"rounds": 8})])[0]}
    theirs = {0: ml.fit(frame.where("cv_fold != 0"), ["a", "b", "c"], "y", "boosting", rounds=8)}
    mine, spark_ml = ({r["grid_id"]: r["score"] for r in ml.score_folds(m, frame, "y", ["grid_id"]).collect()} for m in (own, theirs))
    assert len(mine) == 600 and mine == pytest.approx(spark_ml, abs=1e-5)
    assert own[0].importances == pytest.approx(theirs[0].stages[-1].featureImportances.toArray(), abs=1e-4)


def test_boosting_of_all_plans_grows_in_one_pass_for_each_level(spark, monkeypatch):
    """Each fit was one of Spark ML's, with its own jobs for each level. Where its rows are few, a task grows it alone; that, and how rows are dealt, changes nothing."""
    frame, passes = steps(spark), []
    plans = [(own, held, ml.estimator("boosting", rounds=5)) for own in (["a", "b", "c"], ["c", "a"]) for held in (0, 3, None)]
    alone = trees.fit_boosting(frame, "y", plans)
    monkeypatch.setattr(trees, "_tally", lambda shared, level, real=trees._tally: passes.append(level) or real(shared, level))
    monkeypatch.setattr(trees, "LOCAL", 0)
    monkeypatch.setattr(trees, "AFRESH", 2)
    for direct, rows in ((64, frame), (1, frame.repartition(7))):
        monkeypatch.setattr(trees, "DIRECT", direct)
        passes.clear()
        together = trees.fit_boosting(rows, "y", plans)
        assert len(passes) <= 5 * 4 and set(passes) == {0, 1, 2, 3}
        for one, other in zip(alone, together, strict=True):
            assert len(one.trees) == 5 and one.features == other.features
            assert all(np.array_equal(p, q) for a, b in zip(one.trees, other.trees, strict=True) for p, q in zip(a, b, strict=True))


def test_forests_are_the_same_by_passes_and_by_trees(spark, monkeypatch):
    """Many trees on few rows took a pass over the rows for each level; rows that are alike were counted one by one."""
    frame, passes = steps(spark), []
    monkeypatch.setattr(trees, "_counting", lambda shared, level, real=trees._counting: passes.append(level) or real(shared, level))
    plans = [(own, held, ml.estimator("forest", trees=3, seed=seed, depth=7, split="2")) for own, seed in ((["a", "b", "c"], 4), (["b"], 9)) for held in (1, None)]
    ask = lambda: trees.fit_forests(frame, "y", plans)
    passed = ask()
    codes = np.array([[i % 3 for i in range(99)]], np.uint8)
    kinds, own, y = trees._alike(codes, np.arange(99) % 2)
    assert passes and own.shape == (1, 6) and np.array_equal(own[:, kinds], codes) and np.array_equal(y[kinds], np.arange(99) % 2)
    passes.clear()
    monkeypatch.setattr(trees, "MANY", 1)
    alone = ask()
    monkeypatch.setattr(trees, "_alike", lambda codes, y: None)
    singly = ask()
    assert not passes
    for one, two, three in zip(passed, alone, singly, strict=True):
        assert len(one.trees) == 3 and one.importances == pytest.approx(two.importances) and two.importances == pytest.approx(three.importances)
        for a, b, c in zip(one.trees, two.trees, three.trees, strict=True):
            assert all(np.array_equal(p, q) and np.array_equal(q, r) for p, q, r in zip(a, b, c, strict=True))
