"""Data quality: rules as violation counts in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): a rule is a condition that is true for a bad row. All rules are counted in one aggregate."""
    row = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in rules.items()])
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations")) for k in rules])
    return row.select(F.explode(each).alias("r")).select("r.*")


def enforce(report_: DataFrame) -> None:
    """Raise if a rule is violated; the report has a row for each rule."""
    bad = report_.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in bad))


def require(df: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    missing, leaked = [c for c in columns if c not in df.columns], [c for c in forbidden if c in df.columns]
    if missing or leaked:
        raise ValueError(f"missing columns {missing}, forbidden columns {leaked}")
    return df


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} is missing or not finite": F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns}


def negative(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} is negative": F.col(c) < 0 for c in columns}


def not_integer(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} is no whole number": F.col(c) != F.floor(c) for c in columns}


def nested(*columns: str) -> dict[str, Column]:
    """Counts of growing radii do not fall."""
    return {f"{a} above {b}": F.col(a) > F.col(b) for a, b in zip(columns, columns[1:], strict=False)}


def between(column: str, low: float, high: float) -> dict[str, Column]:
    return {f"{column} outside {low:g} to {high:g}": ~F.col(column).between(low, high)}


def classes(df: DataFrame, target: str) -> DataFrame:
    """(rule, violations): 1 for each of the two classes that no row has."""
    seen = df.agg(*[F.count_if(F.col(target) == t).alias(f"n{t}") for t in (0, 1)])
    return report(seen, {f"no row of class {t}": F.col(f"n{t}") == 0 for t in (0, 1)})


def totals(parts: DataFrame, whole: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): by how much the sum of each part column differs from the whole's; sums are {part column: the whole's aggregate}."""
    a = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_a{i}") for i, c in enumerate(sums)])
    b = whole.agg(*[F.coalesce(v, F.lit(0)).alias(f"_b{i}") for i, v in enumerate(sums.values())])
    each = F.array(*[F.struct(F.lit(f"{c} differ from the whole").alias("rule"), F.abs(F.col(f"_a{i}") - F.col(f"_b{i}")).cast("long").alias("violations")) for i, c in enumerate(sums)])
    return a.join(b, F.lit(True)).select(F.explode(each).alias("r")).select("r.*")


def shortlist(picked: DataFrame, size: int, spacing: float, bounds: Mapping[str, tuple[float, float]], least: Mapping[str, float], counts: Sequence[str] = (), rank: str = "rank", id_col: str = "point_id") -> DataFrame:
    """(rule, violations) for a shortlist: its size, unique ids, ranks from 1 without gaps or ties, coordinates within bounds, scores that reach their thresholds, counts
    from 0 to 3, and its nearest_m not below the spacing."""
    rules = {"spacing below the minimum": F.col("nearest_m") < spacing}
    for c, (low, high) in bounds.items():
        rules |= between(c, low, high)
    rules |= {f"{c} below {v:g}": ~(F.col(c) >= v) for c, v in least.items()} | {f"{c} is not 0 to 3": ~F.col(c).isin(0, 1, 2, 3) for c in counts} | missing([rank, *bounds, *least, *counts])
    sizes = picked.agg(F.count("*").alias("n"), F.count_distinct(F.col(id_col)).alias("ids"), F.count_distinct(F.col(rank)).alias("ranks"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    whole = {
        f"not {size} rows": F.abs(F.col("n") - size),
        "ids repeat": F.col("n") - F.col("ids"),
        "ranks repeat": F.col("n") - F.col("ranks"),
        "ranks do not run from 1": F.coalesce((F.col("low") != 1) | (F.col("high") != F.col("n")), F.lit(False)).cast("long"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("long").alias("violations")) for k, v in whole.items()])
    return report(picked, rules).unionByName(sizes.select(F.explode(each).alias("r")).select("r.*"))


def registry(stations: DataFrame, sockets: DataFrame, key: str = "station_id", declared: str = "socket_count") -> DataFrame:
    """(rule, violations) for a registry: sockets without a station, stations whose AC and DC sockets exceed the number they declare, stations whose declared number is not that of
    their sockets, and by how much the declared numbers' sum differs from that of all sockets."""
    own = sockets.groupBy(key).agg(F.count_if(F.col("current").isin("AC", "DC")).alias("_acdc"), F.count("*").alias("_n"))
    met = stations.select(key, declared).join(own, key, "left").fillna(0, ["_acdc", "_n"])
    rules = {"AC and DC above the declared total": F.col("_acdc") > F.col(declared), "declared total differs": F.col("_n") != F.col(declared)}
    orphan = orphans(sockets, stations, key).agg(F.count("*").alias("violations")).select(F.lit("socket without station").alias("rule"), "violations")
    return report(met, rules).unionByName(orphan).unionByName(totals(stations, sockets, {declared: F.count("*")}))


def orphans(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    return children.join(parents, on, "left_anti")


def partition(whole: DataFrame, first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """One row: the sizes of two id sets that should part a table, and how many ids are in both, in neither and not in the table."""
    flag = lambda d, c: d.select(on).distinct().withColumn(c, F.lit(True))
    flags = flag(whole, "_w").join(flag(first, "_a"), on, "full_outer").join(flag(second, "_b"), on, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b, w = (F.col(c).isNotNull() for c in ("_a", "_b", "_w"))
    return flags.agg(count(a).alias("first"), count(b).alias("second"), count(a & b).alias("in_both"), count(w & ~a & ~b).alias("lost"), count(~w).alias("foreign"))
