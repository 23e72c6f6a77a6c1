"""Correlations, differences between classes and comparisons of rankings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.operators import ranks
from siteselect.operators.scratch import keep


def with_average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with {column}_rank, the average rank of its value, for each column."""
    names = {c: f"_{i}" for i, c in enumerate(columns)}
    ranked = ranks.with_places(df, {names[c]: F.col(c) for c in columns})
    return ranked.withColumns({f"{c}_rank": F.col(f"{k}_below") + (F.col(f"{k}_same") + 1) / 2 for c, k in names.items()}).drop(*ranks.places(list(names.values())))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) for each pair of columns: Pearson's correlation over the rows that have both. Values are best centred near 0.

    Each task adds up the products of its rows as matrices, of values, squares and counts; tasks return a row for each pair.
    """
    pairs = list(combinations(range(len(columns)), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x, 0.0)
            sums += np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
        one, other = (list(v) for v in zip(*pairs, strict=True)) if pairs else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(other, pa.int32()), *[pa.array(m[one, other]) for m in sums]], ["a", "b", *_MOMENTS])

    values = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    summed = values.mapInArrow(run, "a int, b int, " + ", ".join(f"{m} double" for m in _MOMENTS)).groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in _MOMENTS])
    n, x, y, xx, yy, xy = (F.col(m) for m in _MOMENTS)
    spread = F.sqrt((n * xx - x * x) * (n * yy - y * y))
    name = lambda c: F.get(F.array(*[F.lit(k) for k in columns]), F.col(c))
    return summed.select(name("a").alias("a"), name("b").alias("b"), F.when(spread > 0, (n * xy - x * y) / spread).alias("rho"))


_MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) for each pair of columns: the correlation of average ranks."""
    names = {c: f"_{i}" for i, c in enumerate(columns)}
    ranked = ranks.with_places(df.select(*columns), {names[c]: F.col(c) for c in columns})
    middle = [(F.col(f"{k}_below") + (F.col(f"{k}_same") - F.col(f"{k}_n")) / 2).alias(c) for c, k in names.items()]
    return correlations(ranked.select(*middle), columns)


def redundant(correlations: DataFrame, limit: float = 0.9) -> DataFrame:
    return correlations.where(F.abs("rho") >= limit).orderBy(F.desc(F.abs("rho")), "a", "b")


def scale_relation(df: DataFrame, raw: str, scaled: str) -> DataFrame:
    """One row: Pearson correlation, and minimum, median, maximum and population deviation of scaled / raw where raw is not 0."""
    ratio = F.when(F.col(raw) != 0, F.col(scaled) / F.col(raw))
    own = df.agg(F.corr(raw, scaled).alias("pearson"), F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"), F.stddev_pop(ratio).alias("ratio_std"), F.count(ratio).alias("n"))
    middle = ranks.quantiles(df.select(ratio.alias("ratio")), "ratio", {"ratio_median": 0.5})
    return own.join(middle, F.lit(True)).select("pearson", "ratio_min", "ratio_median", "ratio_max", "ratio_std", "n")


def _medians(long: DataFrame, target: str) -> DataFrame:
    """(feature, median_1, median_0) of v by class."""
    each = ranks.quantiles(long.where(F.col(target).isin(0, 1)), "v", {"m": 0.5}, ["feature", target])
    return each.groupBy("feature").agg(*[F.max(F.when(F.col(target) == t, F.col("m"))).alias(f"median_{t}") for t in (1, 0)])


def class_comparison(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """For each column: means, medians and nonzero shares of the two classes and the standardised mean difference, 0 where the pooled variance is."""
    long = _long(df, columns, [target])
    of = lambda t: F.when(F.col(target) == t, F.col("v"))
    aggs = [f(of(t)).alias(f"{name}_{t}") for t in (1, 0) for name, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    out = long.groupBy("feature").agg(*aggs, *[F.avg((of(t) != 0).cast("double")).alias(f"nonzero_{t}") for t in (1, 0)]).join(_medians(long, target), "feature", "left")
    pooled = ((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_0") - 1) * F.col("var_0")) / (F.col("n_1") + F.col("n_0") - 2)
    return out.select("feature", "mean_1", "mean_0", "median_1", "median_0", "nonzero_1", "nonzero_0", F.when(pooled > 0, (F.col("mean_1") - F.col("mean_0")) / F.sqrt(pooled)).otherwise(0.0).alias("smd"))


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, v): the columns below one another as doubles."""
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "feature", "v")


def feature_summary(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """For each column: the share of negatives (percent) at or below the positives' median, and the mean difference over the negatives' deviation."""
    long = _long(df, columns, [target])
    of = lambda t: F.when(F.col(target) == t, F.col("v"))
    first = long.groupBy("feature").agg(F.avg(of(1)).alias("positive_mean"), F.avg(of(0)).alias("negative_mean"), F.stddev_pop(of(0)).alias("negative_std"))
    first = keep(first.join(_medians(long, target).toDF("feature", "positive_median", "negative_median"), "feature", "left"))
    share = long.where(F.col(target) == 0).join(first.select("feature", "positive_median"), "feature").groupBy("feature").agg((100 * F.avg((F.col("v") <= F.col("positive_median")).cast("double"))).alias("positive_median_percentile"))
    out = first.join(share, "feature").select("feature", "positive_mean", "negative_mean", "positive_median", "negative_median", "negative_std", "positive_median_percentile")
    return out.withColumn("standard_difference", F.when(F.col("negative_std") > 0, (F.col("positive_mean") - F.col("negative_mean")) / F.col("negative_std")).otherwise(0.0))


def rank_shift(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: median, 95th percentile and maximum of the absolute difference of two ranks."""
    return rank_shifts(df, a, {b: b}).drop("share")


def rank_shifts(df: DataFrame, a: str, others: Mapping[str, object]) -> DataFrame:
    """(share, median_shift, p95_shift, max_shift): for each {rank column: its share} the absolute differences to rank a; all are counted as one long table."""
    each = F.explode(F.array(*[F.struct(F.lit(share).alias("share"), F.abs(F.col(a) - F.col(b)).alias("shift")) for b, share in others.items()]))
    return ranks.quantiles(df.select(each.alias("s")).select("s.*"), "shift", {"median_shift": 0.5, "p95_shift": 0.95, "max_shift": 1.0}, ["share"])


def _settled_places(ranked: DataFrame, names: Mapping[str, str], id_col: str, limits: Sequence[int]) -> DataFrame:
    """ranked with {name}_place: places by value, highest first, as far as `limits` ask. A value's rows that all lie within or beyond each limit share the place of the
    first; only rows of values that a limit cuts through are sorted by id."""
    above = {k: F.col(f"{k}_n") - F.col(f"{k}_below") - F.col(f"{k}_same") for k in names.values()}
    cut = lambda k: reduce(lambda p, q: p | q, [(above[k] < limit) & (above[k] + F.col(f"{k}_same") > limit) for limit in limits])
    each = F.explode(F.array_compact(F.array(*[F.when(cut(k), F.struct(F.lit(i).alias("_name"), above[k].alias("_above"))) for i, k in enumerate(names.values())])))
    tied = ranks.numbered(ranked.select(id_col, each.alias("t")).select(id_col, "t.*"), [F.asc("_name"), F.asc("_above"), F.asc(id_col)], "_nth")
    starts = tied.groupBy("_name", "_above").agg((F.min("_nth") - 1).alias("_start"))  # a row for each name and limit at most
    found = tied.join(F.broadcast(starts), ["_name", "_above"]).groupBy(id_col)
    settled = keep(found.agg(*[F.max(F.when(F.col("_name") == i, F.col("_above") + F.col("_nth") - F.col("_start"))).alias(f"{k}_at") for i, k in enumerate(names.values())]))
    return ranked.join(settled, id_col, "left").withColumns({f"{c}_place": F.coalesce(f"{k}_at", above[k] + 1) for c, k in names.items()}).drop(*[f"{k}_at" for k in names.values()])


def score_metrics(df: DataFrame, scores: Sequence[str], base: str, others: Sequence[str] = (), id_col: str = "grid_id", fractions: Sequence[float] = (0.01, 0.05), top: int = 20, limit: float = 70.0) -> DataFrame:
    """A row for each of scores: its median, mean and maximum; Spearman correlations with base and others; how many of its top fractions are in base's, and which
    share; and of the `top` best by base the score's median, minimum and number at `limit` or more. Ties go by id.

    All columns are ranked once; medians, correlations and places are read off these ranks.
    """
    columns = list(dict.fromkeys([base, *scores, *others]))
    names = {c: f"_{i}" for i, c in enumerate(columns)}
    ranked = keep(ranks.with_places(df.select(id_col, *columns), {names[c]: F.col(c) for c in columns}))
    n = ranked.count()
    ks = {f: max(1, math.ceil(n * f - 1e-9)) for f in fractions}
    placed = _settled_places(ranked, {c: names[c] for c in dict.fromkeys([base, *scores])}, id_col, list(dict.fromkeys([top, *ks.values()])))
    placed = keep(placed.select(*columns, *[f"{c}_place" for c in dict.fromkeys([base, *scores])]))
    middle = [(F.col(f"{k}_below") + (F.col(f"{k}_same") - F.col(f"{k}_n")) / 2).alias(c) for c, k in names.items()]
    rho = {}
    for r in correlations(ranked.select(*middle), columns).collect():  # a row for each pair of columns
        rho[r["a"], r["b"]] = rho[r["b"], r["a"]] = r["rho"]

    def median(c: str) -> Column:
        first, place = F.col(f"{names[c]}_below"), 0.5 * (F.col(f"{names[c]}_n") - 1)
        held = lambda r: F.max(F.when((first <= r) & (r < first + F.col(f"{names[c]}_same")), F.col(c).cast("double")))
        return 0.5 * held(F.floor(place)) + 0.5 * held(F.ceil(place))

    middles = ranked.agg(*[median(c).alias(c) for c in scores]).first()
    whole = []
    for c in scores:
        whole += [F.avg(c).alias(f"{c}|mean"), F.min(c).alias(f"{c}|min"), F.max(c).alias(f"{c}|max")]
        whole += [F.sum(((F.col(f"{c}_place") <= k) & (F.col(f"{base}_place") <= k)).cast("long")).alias(f"{c}|{f}") for f, k in ks.items()]
    sums = placed.agg(*whole).first()
    best = placed.where(F.col(f"{base}_place") <= top)  # `top` rows
    tops = best.agg(*[v.alias(f"{c}|{k}") for c in scores for k, v in (("median", F.median(c)), ("min", F.min(c)), ("limit", F.sum((F.col(c) >= limit).cast("long"))))]).first()

    def spearman_of(c: str, o: str) -> float | None:
        return rho[c, o] if c != o else None if sums[f"{c}|min"] == sums[f"{c}|max"] else 1.0

    def row(c: str) -> Column:
        fields = [F.lit(c).alias("score"), F.lit(middles[c]).cast("double").alias("median"), F.lit(sums[f"{c}|mean"]).cast("double").alias("mean"), F.lit(sums[f"{c}|max"]).cast(df.schema[c].dataType).alias("max")]
        fields += [F.lit(spearman_of(c, o)).cast("double").alias(f"spearman_{o}") for o in dict.fromkeys([base, *others])]
        for f, k in ks.items():
            common = F.lit(sums[f"{c}|{f}"]).cast("long")
            fields += [common.alias(f"overlap_{round(100 * f)}"), (common / k).alias(f"overlap_fraction_{round(100 * f)}")]
        return F.struct(*fields, F.lit(tops[f"{c}|median"]).cast("double").alias("top_median"), F.lit(tops[f"{c}|min"]).cast(df.schema[c].dataType).alias("top_min"), F.lit(tops[f"{c}|limit"]).cast("long").alias("top_at_limit"))

    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*[row(c) for c in scores])).alias("m")).select("m.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """(bin, n, median): counts in equal bins from 0 on, the last one closed, and the median of the whole column."""
    at = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    middle = ranks.quantiles(df.select(F.col(column).cast("double").alias("v")), "v", {"median": 0.5})
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).join(middle, F.lit(True))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lowest, q1, middle, q3, highest) for each column; one without values has nulls."""
    found = ranks.quantiles(_long(df, columns), "v", {"lowest": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "highest": 1.0}, ["feature"])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(found, "feature", "left").withColumnRenamed("feature", "column")
