"""Ranks over whole tables without a window that one task must run."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.operators.scratch import keep


def stretches(df: DataFrame) -> int:
    """Into how many stretches values are dealt: as many as the session shuffles to, so that a larger cluster ranks in more tasks; 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_counts(df: DataFrame, column: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """(by..., column, same, below, n): for each distinct value how many rows have it, how many a smaller one, and how many there are.

    Equal values meet in one aggregate; the distinct ones are range-partitioned by group and value, so that a stretch is a partition and no value is compared with
    cuts. Each stretch is summed, and starts from the sum of those before in its group. weights: more columns to sum up in the same way (name_same and name_below).
    `parts` fixes the number of stretches; otherwise it follows the number of distinct values.
    """
    by, sums = list(by), {"": F.count("*"), **{f"{k}_": F.sum(v) for k, v in (weights or {}).items()}}
    values = df.where(F.col(column).isNotNull()).withColumn(column, F.col(column).cast("double"))
    counted = keep(values.groupBy(*by, column).agg(*[a.alias(f"{k}same") for k, a in sums.items()]))
    ranged = counted.repartitionByRange(parts, *by, column) if parts else counted.repartitionByRange(*by, column)
    counted = keep(ranged.withColumn("stretch", F.spark_partition_id()))  # written, as another run may cut elsewhere
    each = counted.groupBy(*by, "stretch").agg(*[F.sum(f"{k}same").alias(f"{k}sum") for k in sums])
    before = W.partitionBy(*by).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)  # a row for each stretch that a group lies in
    whole = W.partitionBy(*by)
    bases = each.select(*by, "stretch", *[F.coalesce(F.sum(f"{k}sum").over(before), F.lit(0)).alias(f"{k}base") for k in sums], *[F.sum(f"{k}sum").over(whole).alias(f"{k}n") for k in sums])
    inside = W.partitionBy(*by, "stretch").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    running = counted.select("*", *[F.coalesce(F.sum(f"{k}same").over(inside), F.lit(0)).alias(f"{k}in") for k in sums])
    out = running.join(bases, [*by, "stretch"])
    return out.select(*by, column, *[c for k in sums for c in (F.col(f"{k}same"), (F.col(f"{k}base") + F.col(f"{k}in")).alias(f"{k}below"), F.col(f"{k}n"))])


def quantiles(df: DataFrame, column: str, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., names...): exact percentiles of a column, linear between ranks, each by selection: what stands at a rank is looked up in the counts of values, so that no
    task holds a group's values. Nulls are left out; a group of nulls alone has no row, and without groups there is always one."""
    counts = prefix_counts(df, column, by)
    first, end = F.col("below"), F.col("below") + F.col("same")

    def at(p: float) -> Column:
        place = p * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        held = lambda r: F.max(F.when((first <= r) & (r < end), F.col(column)))
        share = F.max(place - low)
        return F.when(share == 0, held(low)).otherwise((1 - share) * held(low) + share * held(high))

    return counts.groupBy(*by).agg(*[at(p).alias(k) for k, p in probabilities.items()])


#: Counts of values that go to every task, for all names together; values a task ranks, at most, where they are more.
HELD, DEALT = 1 << 18, 1 << 21


def with_places(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """df with {name}_same, {name}_below and {name}_n of each value, within groups of equal `by`; nulls have nulls.

    All values come from df itself: its rows are numbered and written, their values stand in one long table of (row, name, value) and are counted. Counts of names
    with few values go to every task, and rows look them up where they are. Values of other names meet their counts by name and value and go back to their rows,
    in as many parts as there are values to rank (DEALT in each), so that a task's share does not grow; they travel one by one and are made wide where their row is.
    """
    rows = keep(df.withColumn("_row", F.monotonically_increasing_id()))
    keys = ["_name", *(["_by"] if by else [])]
    group = [F.struct(F.lit(0), *by).alias("_by")] if by else []  # a struct, so that nulls in it are equal

    def long(of: Sequence[int]) -> DataFrame:
        columns = list(values.values())
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("_name"), columns[i].cast("double").alias("_value")) for i in of]))
        return rows.select("_row", *group, each.alias("v")).select("_row", *keys[1:], "v.*").where("_value is not null")

    counts = keep(prefix_counts(long(range(len(values))), "_value", keys))
    sizes = {r["_name"]: (r["kinds"], r["rows"]) for r in counts.groupBy("_name").agg(F.count("*").alias("kinds"), F.sum("same").alias("rows")).collect()}
    held, room = [], HELD
    for i, (kinds, _) in sorted(sizes.items(), key=lambda x: x[1]):
        if kinds <= room:
            held.append(i)
            room -= kinds
    out = rows
    for i, (name, value) in enumerate(values.items()):
        if i in sizes and i in held:
            own = counts.where(F.col("_name") == i).select(*[F.col(k).alias(f"_{k}") for k in keys[1:]], F.col("_value").alias("_at"), *[F.col(c).alias(f"{name}_{c}") for c in ("same", "below", "n")])
            on = value.cast("double") == F.col("_at")
            out = out.join(F.broadcast(own), on & (group[0] == F.col("__by")) if by else on, "left").drop("_at", "__by")
        elif i not in sizes:  # nulls alone
            out = out.withColumns({f"{name}_{c}": F.lit(None).cast("long") for c in ("same", "below", "n")})
    many = [i for i in sizes if i not in held]
    if many:
        parts = max(stretches(df), math.ceil(sum(sizes[i][1] for i in many) / DEALT))
        on = [*keys, "_value"]
        met = long(many).repartition(parts, *on).join(counts.where(F.col("_name").isin(many)).repartition(parts, *on), on).select("_row", "_name", "same", "below", "n")
        names = list(values)
        wide = met.repartition(parts, "_row").groupBy("_row").agg(*[F.max(F.when(F.col("_name") == i, F.col(c))).alias(f"{names[i]}_{c}") for i in many for c in ("same", "below", "n")])
        out = out.join(wide, "_row", "left")
    return out.select(*df.columns, *places(list(values)))


def places(names: Sequence[str]) -> list[str]:
    """The columns that with_places adds."""
    return [f"{name}_{c}" for name in names for c in ("same", "below", "n")]


def with_ranks(df: DataFrame, column: str, by: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """df with {prefix}_same, {prefix}_below and {prefix}_n of its value; nulls have nulls."""
    prefix = prefix or column
    counts = keep(prefix_counts(df, column, by)).withColumnsRenamed({"same": f"{prefix}_same", "below": f"{prefix}_below", "n": f"{prefix}_n", column: f"_{prefix}"})
    on = [F.col(f"_{prefix}") == F.col(column).cast("double")]
    if by:
        counts = counts.withColumnsRenamed({b: f"_by_{b}" for b in by})
        on += [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return df.join(counts, condition, "left").drop(f"_{prefix}", *[f"_by_{b}" for b in by])


def percentile(prefix: str, descending: bool = False) -> Column:
    """Average rank in percent, from with_ranks' columns."""
    same, below, n = F.col(f"{prefix}_same"), F.col(f"{prefix}_below"), F.col(f"{prefix}_n")
    rank = (n - below - same if descending else below) + (same + 1) / 2
    return 100.0 * rank / n


def rank_min(prefix: str, descending: bool = True) -> Column:
    same, below, n = F.col(f"{prefix}_same"), F.col(f"{prefix}_below"), F.col(f"{prefix}_n")
    return ((n - below - same if descending else below) + 1).cast("long")


def percentile_score(df: DataFrame, column: str, out: str, higher: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Percentile score 0-100 by average rank; with higher=False small values score high."""
    ranked = with_ranks(df, column, by, "_r")
    return ranked.withColumn(out, percentile("_r", descending=not higher)).drop("_r_same", "_r_below", "_r_n")


def positive_percentile_score(df: DataFrame, column: str, out: str) -> DataFrame:
    """Percentile among positive values; zeros, negatives and nulls score 0."""
    positive = df.withColumn("_p", F.when(F.col(column) > 0, F.col(column)))
    return percentile_score(positive, "_p", "_s").withColumn(out, F.coalesce("_s", F.lit(0.0))).drop("_p", "_s")


def percentile_scores(df: DataFrame, scores: Mapping[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """df with a percentile score for each entry {out: (column, kind)}, within groups of equal `by`; kind is high, low or positive."""
    names = {out: f"_{i}" for i, out in enumerate(scores)}
    value = lambda c, kind: F.when(F.col(c) > 0, F.col(c)) if kind == "positive" else F.col(c)
    ranked = with_places(df, {names[out]: value(*how) for out, how in scores.items()}, by)
    score = {out: percentile(names[out], descending=kind == "low") for out, (_, kind) in scores.items()}
    filled = {out: F.coalesce(c, F.lit(0.0)) if scores[out][1] == "positive" else c for out, c in score.items()}
    return ranked.withColumns(filled).drop(*places(list(names.values())))


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """df with its place in an order, from 1. Range partitions number their own rows and start after those before; no value, however frequent, is one task's."""
    ranged = df.repartitionByRange(stretches(df), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = keep(ranged.withColumns({"_part": F.spark_partition_id(), "_at": at}))
    before, bases = 0, []
    for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        bases.append((r["_part"], before))
        before += r["n"]
    parts = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    return ranged.join(F.broadcast(parts), "_part").withColumn(out, F.col("_base") + F.col("_at") + 1).drop("_part", "_base", "_at")


def row_numbers(df: DataFrame, column: str, id_col: str, out: str) -> DataFrame:
    """Place by value, highest first, ties by id: a rank without gaps or ties. Nulls have none."""
    return numbered(df, [F.desc_nulls_last(column), F.asc(id_col)], out).withColumn(out, F.when(F.col(column).isNotNull(), F.col(out)))


def row_places(df: DataFrame, columns: Sequence[str], id_col: str, suffix: str = "_place") -> DataFrame:
    """(id, {column}_place...): for each column the place by value, highest first, ties by id; nulls have none. All columns are sorted and numbered as one long table."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_name"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)]))
    long = df.select(id_col, each.alias("v")).select(id_col, "v.*").where("_value is not null")
    placed = numbered(long, [F.col("_name"), F.desc("_value"), F.col(id_col)], "_nth")
    starts = placed.groupBy("_name").agg((F.min("_nth") - 1).alias("_start"))
    places_ = placed.join(F.broadcast(starts), "_name").groupBy(id_col)  # a row for each column
    return places_.agg(*[F.max(F.when(F.col("_name") == i, F.col("_nth") - F.col("_start"))).alias(f"{c}{suffix}") for i, c in enumerate(columns)])


def top_fraction(df: DataFrame, column: str, fraction: float, id_col: str) -> DataFrame:
    """The max(1, ceil(n * fraction)) rows with the highest values, ties by id; nulls are the lowest.

    An approximate quantile a little below the fraction cuts most rows off; only what is left is sorted and numbered. Should it cut too much, all rows are.
    """
    slack = 0.002
    sizes = df.agg(F.count("*").alias("n"), F.count(column).alias("known"), F.percentile_approx(column, max(0.0, 1 - 1.1 * fraction - slack), 10_000).alias("cut")).first()
    k = max(1, math.ceil(sizes["n"] * fraction - 1e-9))
    order = [F.desc_nulls_last(column), F.asc(id_col)]
    if sizes["cut"] is not None and k <= sizes["known"]:
        best = numbered(df.where(F.col(column) >= F.lit(sizes["cut"])), order, "_place")
        if best.count() >= k:
            return best.where(F.col("_place") <= k).drop("_place")
    return numbered(df, order, "_place").where(F.col("_place") <= k).drop("_place")
