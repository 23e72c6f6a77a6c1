"""Leakage-safe tables, spatial folds, out-of-fold scores, ranking metrics, stability and permutation studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.operators import ranks, trees
from siteselect.operators.checks import require
from siteselect.operators.scratch import keep


def training_table(source: DataFrame, predictors: Sequence[str], target: str, id_col: str = "grid_id", forbidden: Sequence[str] = ()) -> DataFrame:
    """Ids, predictors and target; a predictor that is forbidden (derived from the target) is an error."""
    leaked = [c for c in predictors if c in forbidden]
    if leaked:
        raise ValueError(f"forbidden predictors {leaked}")
    return require(source, [id_col, *predictors, target]).select(id_col, *predictors, target)


def candidate_table(source: DataFrame, columns: Sequence[str], target: str, id_col: str = "grid_id") -> DataFrame:
    return source.where(F.col(target) == 0).select(id_col, *columns)


def block_summary(rows: DataFrame, block: str = "spatial_block_id", target: str = "y") -> DataFrame:
    return rows.groupBy(block).agg(F.count("*").alias("row_count"), F.sum(F.col(target).cast("long")).alias("positive_count")).withColumn("negative_count", F.col("row_count") - F.col("positive_count"))


def assign_folds(blocks: DataFrame, folds: int = 5, area: str | None = None) -> DataFrame:
    """(spatial_block_id, cv_fold): blocks with positives first, the most positives, then rows, then id, to the fold with the fewest
    positives, then rows, then index; then the others, largest first, to the fold with the fewest rows, then positives, then index.

    Blocks are summaries of many cells; those of one study area are one group.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        load = [[0, 0, i] for i in range(folds)]  # positives, rows, index
        chosen = {}
        ordered = group.sort_values(["positive_count", "row_count", "spatial_block_id"], ascending=[False, False, True])
        for r in ordered[ordered["positive_count"] > 0].itertuples():
            fold = min(load)
            chosen[r.spatial_block_id] = fold[2]
            fold[0] += r.positive_count
            fold[1] += r.row_count
        rest = ordered[ordered["positive_count"] == 0].sort_values(["row_count", "spatial_block_id"], ascending=[False, True])
        for r in rest.itertuples():
            fold = min(load, key=lambda x: (x[1], x[0], x[2]))
            chosen[r.spatial_block_id] = fold[2]
            fold[1] += r.row_count
        return pd.DataFrame({"spatial_block_id": list(chosen), "cv_fold": pd.array(list(chosen.values()), dtype="int32")})

    keyed = blocks.withColumn("_area", F.col(area) if area else F.lit("all"))
    return keyed.groupBy("_area").applyInPandas(run, "spatial_block_id string, cv_fold int")


def fold_summary(rows: DataFrame, block: str = "spatial_block_id", target: str = "y") -> DataFrame:
    positive = F.col(target) == 1
    return rows.groupBy("cv_fold").agg(F.count("*").alias("rows"), F.sum(F.col(target).cast("long")).alias("positives"), F.countDistinct(block).alias("blocks"), F.countDistinct(F.when(positive, F.col(block))).alias("positive_blocks"), F.avg(F.col(target).cast("double")).alias("rate"))


def balanced_weights(rows: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """n / (2 * n of the class)."""
    counts = keep(rows.groupBy(F.col(target).alias("_t")).agg(F.count("*").alias("_n")))
    total, classes = counts.agg(F.sum("_n"), F.count("*")).first()
    if classes > 2:
        raise ValueError(f"{target} has {classes} values; two are expected")
    return rows.join(F.broadcast(counts), F.col(target) == F.col("_t")).withColumn(out, F.lit(float(total or 0)) / (2 * F.col("_n"))).drop("_t", "_n")


#: Models of Spark ML that are fitted at a time.
FITS = 8


def estimator(model: str, seed: int = 42, trees: int = 400, rounds: int = 150, depth: int | None = None, split: str = "sqrt", weights_sum: float | None = None):
    """logistic (standardised, C = 1), forest (400 trees of depth 12, 5 rows a leaf, `split` features at each split: sqrt or a number such as 3), boosting (150 rounds at 0.05, depth 4)."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if model == "logistic":
        return LogisticRegression(standardization=True, regParam=1.0 / (weights_sum or 1.0), elasticNetParam=0.0, maxIter=100, **common)
    if model == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=12 if depth is None else depth, minInstancesPerNode=5, featureSubsetStrategy=split, seed=seed, **common)
    if model == "boosting":
        return GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=4 if depth is None else depth, minInstancesPerNode=100, seed=seed, **common)
    raise ValueError(model)


def fit(rows: DataFrame, features: Sequence[str], target: str, model: str, **options):
    train = balanced_weights(rows, target).withColumn("label", F.col(target).cast("double"))
    total = train.agg(F.sum("weight")).first()[0] if model == "logistic" else None
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator(model, weights_sum=total, **options)]).fit(train)


def score(fitted, rows: DataFrame) -> DataFrame:
    return fitted.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, features: Sequence[str], target: str, model: str, folds: Sequence[int], id_col: str = "grid_id", **options) -> DataFrame:
    """(id, cv_fold, y, model, score): each fold scored by a model of the others. `prior` scores the share of positives in the others."""
    rows, parts = spread(rows.select(*dict.fromkeys([id_col, "cv_fold", target, *features])), id_col), []
    if model != "prior":
        return score_folds(fitted_folds(rows, features, target, model, folds, **options), rows, target, [id_col]).select(id_col, "cv_fold", "y", F.lit(model).alias("model"), "score")
    for fold in folds:
        rate = rows.where(F.col("cv_fold") != fold).agg(F.avg(F.col(target).cast("double"))).first()[0]
        parts.append(rows.where(F.col("cv_fold") == fold).select(id_col, "cv_fold", F.col(target).cast("int").alias("y"), F.lit(model).alias("model"), F.lit(rate).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def average_precision(scores: DataFrame, by: Sequence[str], y: str = "y", score_: str = "score") -> DataFrame:
    """(by..., ap, auc, n, positives): step-wise average precision with ties taken together, and the Mann-Whitney area."""
    counts = ranks.prefix_counts(scores, score_, by, {"pos": F.col(y).cast("long")})
    above = F.col("n") - F.col("below") - F.col("same")
    above_pos = F.col("pos_n") - F.col("pos_below") - F.col("pos_same")
    precision = (above_pos + F.col("pos_same")) / (above + F.col("same"))
    negative = F.col("same") - F.col("pos_same")
    wins = F.col("pos_same") * (F.col("below") - F.col("pos_below")) + F.col("pos_same") * negative / 2.0
    sums = counts.groupBy(*by).agg(F.sum(F.col("pos_same") * precision).alias("a"), F.sum(wins).alias("w"), F.max("n").alias("n"), F.max("pos_n").alias("positives"))
    p, n = F.col("positives"), F.col("n")
    return sums.select(*by, F.when(p > 0, F.col("a") / p).alias("ap"), F.when((p > 0) & (p < n), F.col("w") / (p * (n - p))).alias("auc"), "n", "positives")


def precision_recall_curve(scores: DataFrame, by: Sequence[str] = (), y: str = "y", score_: str = "score") -> DataFrame:
    """(by..., threshold, precision, recall): one point for each distinct score."""
    counts = ranks.prefix_counts(scores, score_, by, {"pos": F.col(y).cast("long")})
    hit, taken = F.col("pos_n") - F.col("pos_below"), F.col("n") - F.col("below")
    return counts.select(*by, F.col(score_).alias("threshold"), (hit / taken).alias("precision"), F.when(F.col("pos_n") > 0, hit / F.col("pos_n")).otherwise(0.0).alias("recall"))


def threshold_metrics(scores: DataFrame, by: Sequence[str], threshold: float = 0.5, y: str = "y", score_: str = "score") -> DataFrame:
    """Precision, recall, F1 and predicted positives; 0 where the denominator is."""
    hit = F.col(score_) >= threshold
    sums = scores.groupBy(*by).agg(F.sum((hit & (F.col(y) == 1)).cast("long")).alias("tp"), F.sum(hit.cast("long")).alias("predicted"), F.sum(F.col(y).cast("long")).alias("p"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("p"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, "precision", "recall", "f1", "predicted")


def top_metrics(scores: DataFrame, by: Sequence[str], fraction: float, id_col: str, y: str = "y", score_: str = "score") -> DataFrame:
    """Precision, recall and lift of the max(1, ceil(n * fraction)) highest scores of each group, ties by id."""
    group = [F.asc(b) for b in by]
    placed = ranks.numbered(scores, [*group, F.desc_nulls_last(score_), F.asc(id_col)], "_place")
    sizes = placed.groupBy(*by).agg(F.min("_place").alias("_first"), F.count(score_).alias("_n")).withColumnsRenamed({b: f"_by_{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction - 1e-9))
    top = F.col("_top")
    ranked = placed.join(sizes, same).withColumn("_top", (F.col("_place") - F.col("_first") < k) & F.col(score_).isNotNull())
    sums = ranked.groupBy(*by).agg(F.sum((top & (F.col(y) == 1)).cast("long")).alias("tp"), F.sum(top.cast("long")).alias("k"), F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))
    precision, recall = F.col("tp") / F.col("k"), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    return sums.select(*by, precision.alias("precision"), recall.alias("recall"), F.when(F.col("p") > 0, precision / (F.col("p") / F.col("n"))).otherwise(0.0).alias("lift"))


def ranking_metrics(scores: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """AP, AUC, recall and lift at 1 and 5 percent."""
    out = average_precision(scores, by)
    for share in (1, 5):
        top = top_metrics(scores, by, share / 100, id_col).select(*by, F.col("recall").alias(f"recall_top_{share}"), F.col("lift").alias(f"lift_top_{share}"))
        out = out.join(top, list(by))
    return out


def fold_record(fold_metrics: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum over folds."""
    return fold_metrics.groupBy(*by).agg(*[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def wide(scores: DataFrame, id_col: str, models: Sequence[str]) -> DataFrame:
    return scores.groupBy(id_col, "cv_fold", "y").pivot("model", list(models)).agg(F.first("score"))


def deltas(metrics: DataFrame, by: str, variant: str, base: str, columns: Sequence[str]) -> DataFrame:
    """Each variant's difference to the base variant of the same `by`."""
    w = W.partitionBy(by)
    return metrics.withColumns({f"{c}_delta": F.col(c) - F.max(F.when(F.col(variant) == base, F.col(c))).over(w) for c in columns})


def paired(metrics: DataFrame, seed: str, variant: str, a: str, b: str, column: str) -> DataFrame:
    """One row: mean and sample deviation of b - a by seed, and wins of b."""
    pairs = metrics.groupBy(seed).pivot(variant, [a, b]).agg(F.first(column)).withColumn("d", F.col(f"`{b}`") - F.col(f"`{a}`"))
    return pairs.agg(F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("std_delta"), F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.count("*").alias("seeds"))


def shuffled(rows: DataFrame, column: str, seed: int | Column, id_col: str = "grid_id", fold: str = "cv_fold") -> DataFrame:
    """rows with `column` shuffled within each fold: the same values in another order, the same for a seed.

    The rows are numbered by fold and id, the values by fold and a hash of id and seed; each row takes the value of its number.
    """
    key = F.xxhash64(F.lit("order"), F.lit(seed) if isinstance(seed, int) else seed, id_col)
    places = ranks.numbered(rows, [F.asc(fold), F.asc(id_col)], "_place")
    values = ranks.numbered(rows.select(F.col(fold).alias("_f"), F.col(column).alias("_v"), key.alias("_key"), F.col(id_col).alias("_id")), [F.asc("_f"), F.asc("_key"), F.asc("_id")], "_place")
    return places.join(values.select("_place", "_v"), "_place").withColumn(column, F.col("_v")).drop("_place", "_v")


def spread(rows: DataFrame, id_col: str) -> DataFrame:
    """rows written in a part for each core, dealt by id, so that each fit, which reads them again and again, has all cores however few files they came from."""
    return keep(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, id_col))


def fitted_all(rows: DataFrame, target: str, plans: Sequence[tuple[Sequence[str], str, int, Mapping]]) -> list:
    """A model for each plan (features, model, held fold, options), in their order, whatever study, fold or seed they are of: forests grow together, level by level, and so does boosting; of
    the others FITS at a time share the executors."""
    together = {"forest": trees.fit_forests, "boosting": trees.fit_boosting}
    single = [i for i in range(len(plans)) if plans[i][1] not in together]
    grown, forests = [], []
    for model, fit_ in together.items():
        if own := [i for i, plan in enumerate(plans) if plan[1] == model]:
            grown += own
            forests += fit_(rows, target, [(plans[i][0], plans[i][2], estimator(model, **plans[i][3])) for i in own])
    with ThreadPool(FITS) as pool:
        others = pool.map(lambda i: fit(rows.where(F.col("cv_fold") != plans[i][2]), plans[i][0], target, plans[i][1], **plans[i][3]), single, chunksize=1)
    found = dict(zip(grown + single, [*forests, *others], strict=True))
    return [found[i] for i in range(len(plans))]


def fitted_folds(rows: DataFrame, features: Sequence[str], target: str, model: str, folds: Sequence[int], **options) -> dict:
    """{fold: a model of the other folds}; the fits share the executors."""
    return dict(zip(folds, fitted_all(rows, target, [(features, model, fold, options) for fold in folds]), strict=True))


def score_folds(fitted: Mapping, rows: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(columns..., cv_fold, y, score): each row scored by the model that its fold was held out of."""
    if all(isinstance(one, trees.Forest) for one in fitted.values()):
        return trees.score_forests(rows, {(): fitted}, target, columns, [], "")
    out = None
    for fold, one in fitted.items():
        scored = score(one, rows.where(F.col("cv_fold") == fold)).select(*columns, F.col("cv_fold").cast("int").alias("cv_fold"), F.col(target).cast("int").alias("y"), "score")
        out = scored if out is None else out.unionByName(scored)
    return out


def importance_summary(drops: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean and deviation of the pooled drops, means over folds, the share of repeats with a drop, of average precision and area; the largest drop first."""
    sums = {"drop_mean": F.avg("pooled_drop"), "drop_std": F.stddev_samp("pooled_drop"), "fold_drop_mean": F.avg("fold_drop_mean"), "positive_fraction": F.avg((F.col("pooled_drop") > 0).cast("double"))}
    sums |= {"auc_drop_mean": F.avg("pooled_auc_drop"), "auc_drop_std": F.stddev_samp("pooled_auc_drop"), "fold_auc_drop_mean": F.avg("fold_auc_drop_mean")}
    return drops.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()]).orderBy(*by[:-1], F.desc("drop_mean"), by[-1])


def coefficients(fitted, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value): standardised coefficients, or the importances of a tree model; one row for each feature, the largest magnitude first."""
    last = fitted if isinstance(fitted, trees.Forest) else fitted.stages[-1]
    if isinstance(last, trees.Forest):
        values = list(zip(features, last.importances, strict=True))
    elif hasattr(last, "coefficients"):
        std = rows.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
        values = [(f, float(c) * float(std[f] or 0)) for f, c in zip(features, last.coefficients, strict=True)]
    else:
        values = [(f, float(v)) for f, v in zip(features, last.featureImportances.toArray(), strict=True)]
    return rows.sparkSession.createDataFrame(values, "feature string, value double").orderBy(F.desc(F.abs("value")), "feature")


def configurations(rows: DataFrame, sets: Mapping[str, Sequence[str]], models: Sequence[str], target: str, folds: Sequence[int], seeds: Sequence[int] = (42,), id_col: str = "grid_id", options: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(model, feature_set, seed, grid_id, cv_fold, y, score): out-of-fold scores of a table of configurations (ablations, sensitivity, seeds).

    Logistic models of all feature sets and folds are fitted and scored in common passes, and like the prior they have no seed: their scores stand under the first one. Tree models
    of all sets, seeds and folds grow together; `options` are theirs by model. Options of other models are an error.
    """
    from siteselect.operators import studies

    options = dict(options or {})
    if foreign := [m for m in options if m not in models or m in ("logistic", "prior")]:
        raise ValueError(f"options for {foreign}")
    features_ = [f for own in sets.values() for f in own]
    out, rows = [], spread(rows.select(*dict.fromkeys([id_col, "cv_fold", target, *features_])), id_col)
    plans = [(m, name, seed, fold) for m in models if m not in ("logistic", "prior") for name in sets for seed in seeds for fold in folds]
    fitted = dict(zip(plans, fitted_all(rows, target, [(sets[name], m, fold, {"seed": seed, **options.get(m, {})}) for m, name, seed, fold in plans]), strict=True))
    row = lambda scored, model, seed: scored.select(id_col, "cv_fold", "y", "feature_set", "score", F.lit(model).alias("model"), (F.lit(seed) if isinstance(seed, int) else seed).alias("seed"))
    for model in models:
        if model == "logistic":
            out.append(row(studies.score_logistic(rows, studies.fit_logistic(rows, sets, target, folds), target, [id_col]), model, seeds[0]))
        elif model == "prior":
            one = keep(out_of_fold(rows, [], target, "prior", folds, id_col))
            out.append(row(one.withColumn("feature_set", F.explode(F.array(*[F.lit(s) for s in sets]))), model, seeds[0]))
        else:
            for name in sets:  # the trees of one set go to the tasks at a time
                own = {(name, seed): {fold: fitted[model, name, seed, fold] for fold in folds} for seed in seeds}
                scored = trees.score_forests(rows, own, target, [id_col], ["feature_set", "seed"], "feature_set string, seed int")
                out.append(row(scored, model, F.col("seed")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
