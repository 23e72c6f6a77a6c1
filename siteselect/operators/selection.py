"""Eligibility, spatially diverse shortlists, overlaps and candidate queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.operators import joins, ranks
from siteselect.operators.scratch import keep

def eligible(scores: DataFrame, suitability: float = 60.0, feasibility: float = 60.0, need: float = 50.0) -> DataFrame:
    return scores.where((F.col("suitability_score") >= suitability) & (F.col("feasibility_score") >= feasibility) & (F.col("need_score") >= need))


def failures(scores: DataFrame, suitability: float = 60.0, feasibility: float = 60.0, need: float = 50.0) -> DataFrame:
    """One row: how many rows fail each criterion; a row may fail several."""
    fails = {"suitability": F.col("suitability_score") < suitability, "feasibility": F.col("feasibility_score") < feasibility, "need": F.col("need_score") < need}
    return scores.agg(*[F.sum(c.cast("long")).alias(f"fail_{k}") for k, c in fails.items()], F.count("*").alias("n"))


def _spread(pts: DataFrame, spacing: float, rounds: int) -> DataFrame:
    """Those of pts that a walk by rank accepts.

    The same set comes from rounds: of the undecided points, those with no better-ranked undecided point nearer than spacing are taken, and their neighbours
    go. Conflicting pairs come once from a radius join; each round ends in a written table.
    """
    near = joins.within_radius(pts.select(F.col("point_id").alias("centre_id"), "x", "y", F.col("rank").alias("r1")), pts.withColumnRenamed("rank", "r2"), spacing, ["r2"])
    edges = keep(near.where((F.col("d2") < spacing * spacing) & (F.col("r2") < F.col("r1"))).select(F.col("centre_id").alias("worse"), F.col("point_id").alias("better")))
    state = keep(pts.select("point_id", F.lit(0).alias("taken")))  # 0 undecided, 1 taken, -1 gone
    for _ in range(rounds):
        of = state.select(F.col("point_id").alias("better"), F.col("taken").alias("b"))
        seen = edges.join(of, "better").groupBy("worse").agg(F.max((F.col("b") == 1).cast("int")).alias("hit"), F.max((F.col("b") == 0).cast("int")).alias("waits"))
        step = state.join(seen, F.col("point_id") == F.col("worse"), "left").select("point_id", F.when(F.col("taken") != 0, F.col("taken")).when(F.coalesce("hit", F.lit(0)) == 1, -1).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0).alias("taken"))
        state = keep(step)
        if state.where("taken = 0").isEmpty():
            return pts.join(state.where("taken = 1").select("point_id"), "point_id")
    raise RuntimeError(f"points still undecided after {rounds} rounds")


def diverse(points: DataFrame, spacing: float, k: int | None = None, rounds: int = 200, first: int = 256, strict: bool = False) -> DataFrame:
    """Points (point_id, x, y, rank; ranks unique) that a walk by rank accepts, if it takes each point at `spacing` or more from all taken before; the first k.

    Whether a point is taken depends on better ranks alone. So with a k the best `first` points are walked, then, while they do not fill it, four times as many
    of those that no taken point is near to, until k are taken or none is left. strict: fewer than k are an error.
    """
    pts = keep(points.select("point_id", "x", "y", "rank"))
    if k is None:
        return _spread(pts, spacing, rounds)
    taken, left, size = None, pts, max(first, k)
    while not left.isEmpty():
        limit = left.orderBy("rank").limit(size).agg(F.max("rank")).first()[0]
        found = keep(_spread(left.where(F.col("rank") <= limit), spacing, rounds))
        taken = found if taken is None else keep(taken.unionByName(found))
        if taken.count() >= k:
            break
        near = joins.within_radius(left.where(F.col("rank") > limit).select(F.col("point_id").alias("centre_id"), "x", "y"), found.select("point_id", "x", "y"), spacing).where(F.col("d2") < spacing * spacing)
        left, size = keep(left.where(F.col("rank") > limit).join(near.select(F.col("centre_id").alias("point_id")).distinct(), "point_id", "left_anti")), size * 4
    n = taken.count() if taken is not None else 0
    if strict and n < k:
        raise ValueError(f"{n} of {k} points can be taken at this spacing")
    return (taken if taken is not None else pts).orderBy("rank").limit(k)


def spacing(shortlist: DataFrame) -> DataFrame:
    """(point_id, nearest_id, nearest_m) within a shortlist, which is small by nature: it has at most k rows."""
    a, b = shortlist.select("point_id", "x", "y"), shortlist.select(F.col("point_id").alias("nearest_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    return a.join(b, F.col("point_id") != F.col("nearest_id")).groupBy("point_id").agg(F.min(F.struct(d.alias("d"), F.col("nearest_id"))).alias("m")).select("point_id", F.col("m.nearest_id").alias("nearest_id"), F.col("m.d").alias("nearest_m"))


def pairwise(shortlist: DataFrame) -> DataFrame:
    """One row: mean, median and maximum distance of a shortlist's pairs."""
    a, b = shortlist.select(F.col("rank").alias("ra"), "x", "y"), shortlist.select(F.col("rank").alias("rb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2).alias("d")
    return a.join(b, F.col("ra") < F.col("rb")).select(d).agg(F.avg("d").alias("mean_m"), F.median("d").alias("median_m"), F.max("d").alias("max_m"), F.count("*").alias("pairs"))


def overlap(df: DataFrame, a: str, b: str, fraction: float, id_col: str) -> DataFrame:
    """One row: how many of the top fraction by a are in that by b, and which share."""
    left, right = ranks.top_fraction(df, a, fraction, id_col).select(id_col), ranks.top_fraction(df, b, fraction, id_col).select(id_col)
    n = left.agg(F.count("*").alias("selected"))
    common = left.join(right, id_col, "left_semi").agg(F.count("*").alias("common"))
    return common.join(n, F.lit(True)).select("selected", "common", (F.col("common") / F.col("selected")).alias("fraction"))


def changes(old: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """(id, change): common, removed or added."""
    a, b = old.select(on).distinct().withColumn("_a", F.lit(1)), new.select(on).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, on, "full_outer")
    return both.select(on, F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("common").alias("change"))


SORTS: Mapping[str, Sequence[Column | str]] = {"rank": ("selection_rank",), "suitability": ("-suitability_score", "selection_rank"), "support": ("-models_top_20", "selection_rank"), "need": ("-need_score", "selection_rank"), "feasibility": ("-feasibility_score", "selection_rank")}


def browse(candidates: DataFrame, text: str = "", band: str | None = None, support: str | None = None, sort: str = "rank") -> DataFrame:
    """Candidates whose id has the text, of a band, of a support (all, two_plus, disagreement), in one of SORTS, ties by selection_rank."""
    out = candidates.where(F.upper("grid_id").contains(text.strip().upper())) if text.strip() else candidates
    out = out.where(F.col("priority_band") == band) if band else out
    rule = {"all": F.col("models_top_20") == 3, "two_plus": F.col("models_top_20") >= 2, "disagreement": F.col("models_top_20") < 3}
    out = out.where(rule[support]) if support else out
    return out.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in SORTS[sort]])


def best(candidates: DataFrame, columns: Mapping[str, str], id_col: str = "grid_id", tolerance: float = 1e-9) -> DataFrame:
    """(metric, best, winners): the highest or lowest value ('max' or 'min') and all ids within the tolerance of it, sorted."""
    limits = candidates.agg(*[(F.max(c) if how == "max" else F.min(c)).alias(f"_{c}") for c, how in columns.items()])
    pairs = candidates.join(F.broadcast(limits), F.lit(True))
    rows = F.array(*[F.when(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.struct(F.lit(c).alias("metric"), F.col(f"_{c}").cast("double").alias("best"))) for c in columns])
    each = pairs.select(id_col, F.explode(rows).alias("m")).where("m is not null")
    return each.groupBy("m.metric", "m.best").agg(F.array_join(F.array_sort(F.collect_list(id_col)), ",").alias("winners"))


def lookup(candidates: DataFrame, grid_id: str) -> DataFrame:
    return candidates.where(F.upper(F.trim("grid_id")) == grid_id.strip().upper())
