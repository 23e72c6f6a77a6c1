"""Tables, folds, metrics and models on the candidate fixture. m8, m9, m23 and m24 have small tree models (SMALL); the other studies have the full ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteselect.operators import checks, grid, ml, studies, trees
from siteselect.operators.scratch import keep
from siteselect.plans.catalog import Tables, query

FEATURES = ["road_density_km_per_km2", "distance_to_main_road_m", "parking_area_m2", "pop0", "pop1"]
SMALL = {"trees": 10, "rounds": 5}


def rows(t: Tables):
    block = grid.block_id("x", "y")
    return t("candidate").withColumn("spatial_block_id", block).drop("y").withColumnRenamed("target", "y")


def folded(t: Tables):
    r = rows(t).drop("cv_fold")
    folds = ml.assign_folds(ml.block_summary(r))
    return r.join(F.broadcast(folds), "spatial_block_id")  # a row for each block of the study area


@query("m1_training_table", "SELECT grid_id, pop0, pop1, target FROM $candidate")
def _(t):
    return ml.training_table(t("candidate"), ["pop0", "pop1"], "target", forbidden=["distance_to_nearest_charging_station_m"])


@query("m2_candidate_table", "SELECT grid_id, pop0, distance_to_nearest_charging_station_m FROM $candidate WHERE target = 0")
def _(t):
    return ml.candidate_table(t("candidate"), ["pop0", "distance_to_nearest_charging_station_m"], "target")


@query("m3_canonical_tables", "SELECT grid_id, pop0, m1, target FROM $candidate")
def _(t):
    context = t("candidate").select("grid_id", "m1")
    return ml.training_table(t("candidate").drop("m1").join(context, "grid_id"), ["pop0", "m1"], "target")


@query("a15_block_summary", "SELECT concat('B', CAST(floor(x / 5000) AS BIGINT), '_', CAST(floor(y / 5000) AS BIGINT)) AS spatial_block_id, count(*) AS row_count, CAST(sum(target) AS BIGINT) AS positive_count, CAST(count(*) - sum(target) AS BIGINT) AS negative_count FROM $candidate GROUP BY 1")
def _(t):
    return ml.block_summary(rows(t))


BLOCKED = "blocked AS (SELECT *, concat('B', CAST(floor(x / 5000) AS BIGINT), '_', CAST(floor(y / 5000) AS BIGINT)) AS block FROM $candidate)"
FOLDS = f"""WITH RECURSIVE {BLOCKED}, sums AS (SELECT block, CAST(sum(target) AS BIGINT) AS p, count(*) AS r FROM blocked GROUP BY 1),
ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN p > 0 THEN 0 ELSE 1 END, p DESC, r DESC, block) AS k FROM sums),
dealt(k, block, fold, load) AS (
  SELECT CAST(0 AS BIGINT), NULL::VARCHAR, NULL::INTEGER, list_transform(range(5), lambda i: {{'p': CAST(0 AS BIGINT), 'r': CAST(0 AS BIGINT), 'i': CAST(i AS INTEGER)}})
  UNION ALL
  SELECT k, block, fold, list_transform(load, lambda s: CASE WHEN s.i = fold THEN {{'p': s.p + p, 'r': s.r + r, 'i': s.i}} ELSE s END)
  FROM (SELECT o.k, o.block, o.p, o.r, d.load, CASE WHEN o.p > 0 THEN list_sort(list_transform(d.load, lambda s: {{'a': s.p, 'b': s.r, 'i': s.i}}))[1].i ELSE list_sort(list_transform(d.load, lambda s: {{'a': s.r, 'b': s.p, 'i': s.i}}))[1].i END AS fold
    FROM dealt d JOIN ordered o ON o.k = d.k + 1)),
folds AS (SELECT block, fold FROM dealt WHERE k > 0)"""


@query("m5_fold_assignment", f"{FOLDS} SELECT block AS spatial_block_id, fold AS cv_fold FROM folds")
def _(t):
    return ml.assign_folds(ml.block_summary(rows(t)))


@query("a16_fold_summary", f"{FOLDS} SELECT fold AS cv_fold, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives, count(DISTINCT block) AS blocks, count(DISTINCT block) FILTER (WHERE target = 1) AS positive_blocks, round(avg(CAST(target AS DOUBLE)), 9) AS rate FROM blocked JOIN folds USING (block) GROUP BY fold")
def _(t):
    return ml.fold_summary(folded(t)).withColumn("rate", F.round("rate", 9))


V8 = f"""{FOLDS} SELECT 'block in more than one fold' AS rule, count(*) FILTER (WHERE n > 1) AS violations FROM (SELECT block, count(DISTINCT fold) AS n FROM folds GROUP BY 1)
UNION ALL SELECT 'fold without positives', count(*) FILTER (WHERE p = 0) FROM (SELECT fold, sum(target) AS p FROM blocked JOIN folds USING (block) GROUP BY 1)
UNION ALL SELECT 'rows differ from the whole', (SELECT count(*) FROM $candidate) - (SELECT count(*) FROM blocked JOIN folds USING (block))
UNION ALL SELECT 'positives differ from the whole', CAST((SELECT sum(target) FROM $candidate) - (SELECT sum(target) FROM blocked JOIN folds USING (block)) AS BIGINT)"""


@query("v8_fold_checks", V8)
def _(t):
    f = folded(t)
    blocks, sums = f.groupBy("spatial_block_id").agg(F.countDistinct("cv_fold").alias("folds")), ml.fold_summary(f)
    rules = checks.report(blocks, {"block in more than one fold": F.col("folds") > 1}).unionByName(checks.report(sums, {"fold without positives": F.col("positives") == 0}))
    return rules.unionByName(checks.totals(sums, rows(t), {"rows": F.count("*"), "positives": F.sum("y")}))


@query("m10_balanced_weights", "SELECT target AS y, count(*) AS n, round((SELECT count(*) FROM $candidate) / (2.0 * count(*)), 9) AS weight FROM $candidate GROUP BY target")
def _(t):
    return ml.balanced_weights(rows(t), "y").groupBy("y").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


def long_scores(t: Tables):
    r = rows(t).select("grid_id", "cv_fold", "y", "m1", "m2", "m3")
    return r.unpivot(["grid_id", "cv_fold", "y"], ["m1", "m2", "m3"], "model", "score")


LONG = "l AS (SELECT grid_id, cv_fold, target AS y, 'm1' AS model, m1 AS score FROM $candidate UNION ALL SELECT grid_id, cv_fold, target, 'm2', m2 FROM $candidate UNION ALL SELECT grid_id, cv_fold, target, 'm3', m3 FROM $candidate)"
CURVE = f"{LONG}, g AS (SELECT model, score, count(*) AS n, sum(y) AS p FROM l GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY model) AS tp, sum(n) OVER (PARTITION BY model) AS tn FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))"


@query("m12_average_precision", f"WITH {CURVE} SELECT model, round(sum(p * cp / cn) / max(tp), 8) AS ap FROM c GROUP BY model")
def _(t):
    return ml.average_precision(long_scores(t), ["model"]).select("model", F.round("ap", 8).alias("ap"))


@query("m13_roc_auc", f"WITH {CURVE} SELECT model, round(sum((n - p) * (cp - p) + p * (n - p) / 2.0) / max(tp * (tn - tp)), 8) AS auc FROM c GROUP BY model")
def _(t):
    return ml.average_precision(long_scores(t), ["model"]).select("model", F.round("auc", 8).alias("auc"))


@query("m14_threshold_metrics", f"WITH {LONG}, s AS (SELECT model, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5) AS predicted, sum(y) AS p FROM l GROUP BY model) SELECT model, round(tp / predicted, 8) AS \"precision\", round(tp / p, 8) AS recall, round(2.0 * tp / (predicted + p), 8) AS f1, predicted FROM s")
def _(t):
    return ml.threshold_metrics(long_scores(t), ["model"]).select("model", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "predicted")


TOPS = f"{LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY model, cv_fold ORDER BY score DESC, grid_id) AS k, count(*) OVER (PARTITION BY model, cv_fold) AS n FROM l), s AS (SELECT model, cv_fold, count(*) FILTER (WHERE k <= ceil(n * 0.05)) AS k, count(*) FILTER (WHERE k <= ceil(n * 0.05) AND y = 1) AS tp, sum(y) AS p, count(*) AS n FROM r GROUP BY 1, 2)"


@query("m15_top_fraction_metrics", f"WITH {TOPS} SELECT model, cv_fold, round(tp / k, 8) AS \"precision\", round(tp / p, 8) AS recall, round((tp / k) / (p / n), 8) AS lift FROM s")
def _(t):
    return ml.top_metrics(long_scores(t), ["model", "cv_fold"], 0.05, "grid_id").select("model", "cv_fold", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "lift")])


BY_FOLD = "g AS (SELECT model, cv_fold, score, count(*) AS n, sum(y) AS p FROM l GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY model, cv_fold) AS tp, sum(n) OVER (PARTITION BY model, cv_fold) AS tn FROM g WINDOW w AS (PARTITION BY model, cv_fold ORDER BY score DESC)), areas AS (SELECT model, cv_fold, sum(p * cp / cn) / max(tp) AS ap, sum((n - p) * (cp - p) + p * (n - p) / 2.0) / max(tp * (tn - tp)) AS auc, CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS positives FROM c GROUP BY ALL)"
PLACED = "r AS (SELECT *, row_number() OVER (PARTITION BY model, cv_fold ORDER BY score DESC, grid_id) AS k, count(*) OVER (PARTITION BY model, cv_fold) AS n FROM l)"
SHARE = "count(*) FILTER (WHERE k <= greatest(1, ceil(n * {f} - 1e-9)) AND y = 1)"
TOP_SQL = ", ".join(f"round({SHARE.format(f=f)} / sum(y), 8) AS recall_top_{k}, round(({SHARE.format(f=f)} / count(*) FILTER (WHERE k <= greatest(1, ceil(n * {f} - 1e-9)))) / (sum(y) / count(*)), 8) AS lift_top_{k}" for k, f in ((1, 0.01), (5, 0.05)))


@query("m16_ranking_metrics", f"WITH {LONG}, {BY_FOLD}, {PLACED}, t AS (SELECT model, cv_fold, {TOP_SQL} FROM r GROUP BY ALL) SELECT model, cv_fold, round(ap, 8) AS ap, round(auc, 8) AS auc, n, positives, recall_top_1, lift_top_1, recall_top_5, lift_top_5 FROM areas JOIN t USING (model, cv_fold)")
def _(t):
    out = ml.ranking_metrics(long_scores(t), ["model", "cv_fold"], "grid_id")
    return out.withColumns({c: F.round(c, 8) for c in ("ap", "auc", "recall_top_1", "lift_top_1", "recall_top_5", "lift_top_5")})


@query("m17_fold_records", f"WITH {TOPS}, q AS (SELECT model, cv_fold, tp / p AS recall FROM s) SELECT model, round(avg(recall), 8) AS recall_mean, round(stddev_samp(recall), 8) AS recall_std, round(min(recall), 8) AS recall_min, round(max(recall), 8) AS recall_max FROM q GROUP BY model")
def _(t):
    m = ml.top_metrics(long_scores(t), ["model", "cv_fold"], 0.05, "grid_id")
    return ml.fold_record(m, ["model"], ["recall"]).select("model", *[F.round(f"recall_{k}", 8).alias(f"recall_{k}") for k in ("mean", "std", "min", "max")])


@query("m18_precision_recall_curve", f"WITH {CURVE} SELECT model, round(score, 9) AS threshold, round(cp / cn, 8) AS \"precision\", round(cp / tp, 8) AS recall FROM c")
def _(t):
    c = ml.precision_recall_curve(long_scores(t), ["model"])
    return c.select("model", F.round("threshold", 9).alias("threshold"), F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query("m19_wide_scores", "SELECT grid_id, cv_fold, target AS y, m1, m2, m3 FROM $candidate")
def _(t):
    return ml.wide(long_scores(t), "grid_id", ["m1", "m2", "m3"])


@query("m6_m7_logistic_out_of_fold")
def _(t):
    return ml.configurations(folded(t), {"all": FEATURES}, ["logistic"], "y", range(5)).select("grid_id", "cv_fold", "y", "model", "score")


@query("m8_forest_out_of_fold")
def _(t):
    """The square root of the features at each split."""
    return ml.out_of_fold(folded(t), FEATURES, "y", "forest", range(5), trees=SMALL["trees"], split="sqrt")


@query("m23_forest_three_a_split")
def _(t):
    return ml.out_of_fold(folded(t), FEATURES, "y", "forest", range(5), trees=SMALL["trees"], split="3")


@query("m9_boosting_out_of_fold")
def _(t):
    return ml.out_of_fold(folded(t), FEATURES, "y", "boosting", range(5), rounds=SMALL["rounds"])


@query("m11_prior_baseline", "WITH f AS (SELECT cv_fold, sum(target) AS p, count(*) AS n FROM $candidate GROUP BY 1) SELECT cv_fold, round(((SELECT sum(p) FROM f) - p) / ((SELECT sum(n) FROM f) - n), 9) AS lowest, round(((SELECT sum(p) FROM f) - p) / ((SELECT sum(n) FROM f) - n), 9) AS highest, n FROM f")
def _(t):
    out = ml.out_of_fold(rows(t), FEATURES, "y", "prior", range(5))
    return out.groupBy("cv_fold").agg(F.round(F.min("score"), 9).alias("lowest"), F.round(F.max("score"), 9).alias("highest"), F.count("*").alias("n"))


MODELS = ["logistic", "forest", "boosting"]
#: Full sizes, which are the estimators' defaults: 400 trees, 150 rounds.
OPTIONS = {"forest": {"split": "3"}, "boosting": {}}


@query("m20_feature_group_ablation")
def _(t):
    out = ml.configurations(folded(t), {"road": FEATURES[:2], "parking": FEATURES[2:3], "all": FEATURES}, MODELS, "y", range(5), options=OPTIONS)
    return ml.ranking_metrics(keep(out), ["model", "feature_set"], "grid_id")


@query("m21_redundancy_sensitivity")
def _(t):
    # the raw and the normalised column say the same: all, the normalised alone, the raw alone
    r = folded(t).withColumn("main_road_km", F.col("main_road_length_m") / 1000)
    sets = {"full": [*FEATURES, "main_road_length_m", "main_road_km"], "normalised": [*FEATURES, "main_road_km"], "raw": [*FEATURES, "main_road_length_m"]}
    return ml.ranking_metrics(keep(ml.configurations(r, sets, MODELS, "y", range(5), options=OPTIONS)), ["model", "feature_set"], "grid_id")


@query("m22_incremental_value")
def _(t):
    """What activity, population and both add to a baseline, for each model."""
    activity = ["charging_station_count_within_2000m", "parking_count_within_1000m"]
    sets = {"baseline": FEATURES[:3], "activity": [*FEATURES[:3], *activity], "population": FEATURES, "both": [*FEATURES, *activity]}
    out = ml.configurations(folded(t), sets, [*MODELS, "prior"], "y", range(5), options=OPTIONS)
    return ml.deltas(ml.ranking_metrics(keep(out), ["model", "feature_set"], "grid_id"), "model", "feature_set", "baseline", ["ap", "auc", "recall_top_5"])


@query("m24_seed_stability")
def _(t):
    seeds, options = (7, 21, 42, 84, 168), {"forest": {"trees": SMALL["trees"], **OPTIONS["forest"]}}
    out = ml.configurations(folded(t), {"baseline": FEATURES[:3], "population": FEATURES}, ["forest"], "y", range(5), seeds, options=options)
    return ml.paired(ml.ranking_metrics(keep(out), ["model", "feature_set", "seed"], "grid_id"), "seed", "feature_set", "baseline", "population", "ap")


@query("m22_incremental_deltas", f"WITH {TOPS}, q AS (SELECT cv_fold, model, tp / p AS recall FROM s) SELECT q.cv_fold, q.model, round(q.recall - b.recall, 8) AS recall_delta FROM q JOIN q b ON q.cv_fold = b.cv_fold AND b.model = 'm1'")
def _(t):
    m = ml.top_metrics(long_scores(t), ["model", "cv_fold"], 0.05, "grid_id")
    return ml.deltas(m, "cv_fold", "model", "m1", ["recall"]).select("cv_fold", "model", F.round("recall_delta", 8).alias("recall_delta"))


@query("m24_paired_deltas", f"WITH {TOPS}, q AS (SELECT cv_fold, model, tp / p AS recall FROM s), d AS (SELECT b.recall - a.recall AS d FROM q a JOIN q b ON a.cv_fold = b.cv_fold AND a.model = 'm1' AND b.model = 'm2') SELECT round(avg(d), 8) AS mean_delta, round(stddev_samp(d), 8) AS std_delta, count(*) FILTER (WHERE d > 0) AS wins, count(*) AS seeds FROM d")
def _(t):
    m = ml.top_metrics(long_scores(t), ["model", "cv_fold"], 0.05, "grid_id")
    out = ml.paired(m, "cv_fold", "model", "m1", "m2", "recall")
    return out.select(F.round("mean_delta", 8).alias("mean_delta"), F.round("std_delta", 8).alias("std_delta"), "wins", "seeds")


@query("m25_m27_permutation_importance")
def _(t):
    """Three models, all features, five repeats; the largest losses first."""
    rows_ = ml.spread(folded(t).select("grid_id", "cv_fold", "y", *FEATURES), "grid_id")
    logistic = studies.fit_logistic(rows_, {"logistic": FEATURES}, "y", range(5))
    plans = [(m, fold) for m in OPTIONS for fold in range(5)]
    fitted = dict(zip(plans, ml.fitted_all(rows_, "y", [(FEATURES, m, fold, OPTIONS[m]) for m, fold in plans]), strict=True))
    grown = {(m,): {fold: fitted[m, fold] for fold in range(5)} for m in OPTIONS}

    def score(table, columns):
        own = studies.score_logistic(table, logistic, "y", columns).withColumnRenamed("feature_set", "model")
        return own.unionByName(trees.score_forests(table, grown, "y", columns, ["model"], "model string"))

    return ml.importance_summary(studies.importance(rows_, FEATURES, score, by=["model"]), ["model", "feature"])


@query("m26_shuffle_keeps_values", "SELECT cv_fold, sum(pop0) AS total, sum(pop0 * pop0) AS squares, count(*) AS n, true AS moved FROM $candidate GROUP BY 1")
def _(t):
    r = rows(t).withColumn("before", F.col("pop0"))
    moved = F.sum((F.col("pop0") != F.col("before")).cast("long")) > 0.5 * F.count("*")
    return ml.shuffled(r, "pop0", 42).groupBy("cv_fold").agg(F.sum("pop0").alias("total"), F.sum(F.col("pop0") * F.col("pop0")).alias("squares"), F.count("*").alias("n"), moved.alias("moved"))


@query("m28_full_fit")
def _(t):
    """Standardised coefficients of all rows, the largest first."""
    model = studies.fit_logistic(rows(t), {"all": FEATURES}, "y", [None])["all", None]
    values = list(zip(model.features, model.standardised, strict=True))
    return t.spark.createDataFrame(values, "feature string, value double").orderBy(F.desc(F.abs("value")), "feature")
