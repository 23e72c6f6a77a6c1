"""Explainable percentile scores, ranks, bands, consensus and scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.operators import ranks
from siteselect.operators.scratch import keep

# Component weights of the two suitability models.
ACCESSIBILITY = {"road_proximity_score": 0.45, "main_road_presence_score": 0.35, "road_density_score": 0.20}
PARKING = {"parking_proximity_score": 0.45, "parking_coverage_score": 0.35, "parking_area_score": 0.20}
INFRASTRUCTURE_GAP = {"charging_distance_gap_score": 0.75, "charging_density_gap_score": 0.25}
TECHNOLOGY_GAP = {"dc_gap_score": 0.60, "ac_gap_score": 0.40}
FEASIBILITY = {"accessibility_score": 0.60, "parking_score": 0.40}
NEED = {"infrastructure_gap_score": 0.85, "technology_gap_score": 0.15}
# Band limits and their long labels.
BANDS = ((99.0, "A"), (95.0, "B"), (80.0, "C"), (50.0, "D"))
LONG_BANDS = {"A": "A - Highest priority", "B": "B - High priority", "C": "C - Medium priority", "D": "D - Lower priority", "E": "E - Lowest priority"}
# Names of the components in explanations.
LABELS = {"accessibility_score": "road accessibility", "parking_score": "parking suitability", "infrastructure_gap_score": "charging infrastructure gap", "technology_gap_score": "AC/DC technology gap"}
# Support labels by the number of models.
SUPPORT = ("no_model_top_20pct", "one_of_three_top_20pct", "two_of_three_top_20pct", "all_three_top_20pct")


def low_count_gap(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return 100.0 / (1.0 + F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))


def absence(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit(0)) <= 0, 100.0).otherwise(0.0)


def weighted(weights: Mapping[str, float]) -> Column:
    """Weighted mean of columns, kept in 0-100; the weights must sum to 1."""
    if abs(sum(weights.values()) - 1) > 1e-8:
        raise ValueError(f"weights sum to {sum(weights.values())}")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def band(percentile: Column | str, long: bool = False) -> Column:
    p = F.col(percentile) if isinstance(percentile, str) else percentile
    label = F.lit(LONG_BANDS["E"] if long else "E")
    for limit, letter in reversed(BANDS):
        label = F.when(p >= limit, LONG_BANDS[letter] if long else letter).otherwise(label)
    return label


def components(df: DataFrame, pilot: bool = False) -> DataFrame:
    """The ten component scores and the six means of them, and suitability = sqrt(feasibility * need)."""
    scores = {
        "road_proximity_score": ("distance_to_main_road_m", "low"), "road_density_score": ("road_density_km_per_km2", "positive"), "parking_proximity_score": ("distance_to_nearest_parking_m", "low"),
        "parking_coverage_score": ("parking_count_within_1000m", "positive"), "parking_area_score": ("parking_area_m2", "positive"), "charging_distance_gap_score": ("distance_to_nearest_charging_station_m", "high"),
    }
    if pilot:
        scores["main_road_presence_score"] = ("main_road_length_m", "positive")
    df = ranks.percentile_scores(df, scores)
    if not pilot:
        df = df.withColumn("main_road_presence_score", F.when(F.col("main_road_segment_count") > 0, 100.0).otherwise(0.0))
    df = df.withColumns({"charging_density_gap_score": low_count_gap("charging_station_count_within_2000m"), "ac_gap_score": absence("ac_station_count_within_1000m"), "dc_gap_score": absence("dc_station_count_within_1000m")})
    df = df.withColumns({"accessibility_score": weighted(ACCESSIBILITY), "parking_score": weighted(PARKING), "infrastructure_gap_score": weighted(INFRASTRUCTURE_GAP), "technology_gap_score": weighted(TECHNOLOGY_GAP)})
    df = df.withColumns({"feasibility_score": weighted(FEASIBILITY), "need_score": weighted(NEED)})
    # written once: the ranks that follow read the scores twice
    return keep(df.withColumn("suitability_score", F.sqrt(F.col("feasibility_score") * F.col("need_score"))))


#: What `components` reads.
INPUTS = (
    "distance_to_main_road_m", "main_road_length_m", "main_road_segment_count", "road_density_km_per_km2", "distance_to_nearest_parking_m", "parking_count_within_1000m", "parking_area_m2",
    "distance_to_nearest_charging_station_m", "charging_station_count_within_2000m", "ac_station_count_within_1000m", "dc_station_count_within_1000m",
)
COMPONENTS = (*ACCESSIBILITY, *PARKING, *INFRASTRUCTURE_GAP, *TECHNOLOGY_GAP, *FEASIBILITY, *NEED, "suitability_score")


def _rounded(scored: DataFrame, digits: int | None) -> DataFrame:
    """Scores kept in 0-100 and rounded half to even; digits None leaves them as they are."""
    if digits is None:
        return scored
    return scored.withColumns({c: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(c))), digits) for c in dict.fromkeys((*COMPONENTS, "suitability_percentile"))})


def suitability_province(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Average-rank percentile, minimum rank (highest first), band on the exact percentile, then scores rounded and explained."""
    scored = ranks.with_ranks(components(df).withColumn("suitability_key", F.round("suitability_score", 9)), "suitability_key", (), "_s")
    scored = scored.withColumns({"suitability_percentile": ranks.percentile("_s"), "suitability_rank": ranks.rank_min("_s")}).drop("_s_same", "_s_below", "_s_n", "suitability_key")
    scored = scored.withColumn("priority_band", band("suitability_percentile"))
    return _rounded(scored, digits).withColumn("score_explanation", explain_phrases())


def explain_phrases(limit: float = 70.0) -> Column:
    strengths = F.concat_ws("; ", F.when(F.col("accessibility_score") >= limit, "strong road accessibility"), F.when(F.col("parking_score") >= limit, "strong parking feasibility"))
    needs = F.concat_ws("; ", F.when(F.col("infrastructure_gap_score") >= limit, "large charging infrastructure gap"), F.when(F.col("technology_gap_score") >= limit, "AC/DC technology gap"))
    other = lambda c, text: F.when(c == "", text).otherwise(c)
    return F.concat_ws("; ", other(strengths, "moderate site feasibility"), other(needs, "moderate infrastructure need"))


def suitability_pilot(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Ranks without ties (by id), percentile (n - rank) / (n - 1), long band labels, the two strongest and the weakest component named."""
    scored = ranks.row_numbers(components(df, pilot=True).withColumn("suitability_key", F.round("suitability_score", 9)), "suitability_key", "grid_id", "suitability_rank").drop("suitability_key")
    n = df.count()
    scored = scored.withColumn("suitability_percentile", F.lit(100.0) if n <= 1 else (n - F.col("suitability_rank")) / (n - 1) * 100.0)
    scored = scored.withColumns({"priority_band": band("suitability_percentile", long=True), "score_explanation": explain_extremes()})
    return _rounded(scored, digits)


def explain_extremes() -> Column:
    ordered = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(i).alias("o"), F.lit(label).alias("l")) for i, (c, label) in enumerate(LABELS.items())]))
    one = lambda k: F.concat(F.element_at(ordered, k)["l"], F.lit(" ("), F.format_string("%.1f", -F.element_at(ordered, k)["v"]), F.lit(")"))
    return F.concat(F.format_string("Feasibility %.1f/100; need %.1f/100. Strengths: ", F.col("feasibility_score"), F.col("need_score")), one(1), F.lit(", "), one(2), F.lit(". Main constraint: "), one(len(LABELS)), F.lit("."))


def consensus(df: DataFrame, models: Sequence[str], suitability: str | None = None, ranked: bool = True) -> DataFrame:
    """Row-wise median, minimum, maximum, spread and counts of percentile columns; if `ranked`, the rank of the median; its lead over another percentile."""
    ordered = F.array_sort(F.array(*[F.col(m) for m in models]))
    k = len(models)
    middle = F.element_at(ordered, k // 2 + 1) if k % 2 else (F.element_at(ordered, k // 2) + F.element_at(ordered, k // 2 + 1)) / 2
    over = lambda t: sum(((F.col(m) >= t).cast("int") for m in models[1:]), (F.col(models[0]) >= t).cast("int"))
    out = df.withColumns({"consensus_median": middle, "consensus_min": F.element_at(ordered, 1), "consensus_max": F.element_at(ordered, -1), "models_top_20": over(80.0), "models_top_10": over(90.0)})
    out = out.withColumns({"consensus_spread": F.col("consensus_max") - F.col("consensus_min"), "at_least_two": F.col("models_top_20") >= 2, "all_models": F.col("models_top_20") == k})
    if ranked:
        out = ranks.with_ranks(out, "consensus_median", (), "_m").withColumn("consensus_rank", ranks.rank_min("_m")).drop("_m_same", "_m_below", "_m_n")
    return out.withColumn("consensus_minus_suitability", F.col("consensus_median") - F.col(suitability)) if suitability else out


def ensemble(models: Sequence[str]) -> Column:
    return sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)


def _with_minimum_ranks(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """df with the minimum rank (highest first) of each score {out: score}."""
    names = {out: f"_{i}" for i, out in enumerate(scores)}
    ranked = ranks.with_places(df, {names[out]: F.col(c) for out, c in scores.items()})
    return ranked.withColumns({out: ranks.rank_min(k) for out, k in names.items()}).drop(*ranks.places(list(names.values())))


def scenarios(df: DataFrame, components_: Sequence[str], weights: Mapping[str, Sequence[float]], ranked: bool = True) -> DataFrame:
    """Positive percentiles of the components, then a score and, if `ranked`, a minimum rank for each scenario."""
    df = ranks.percentile_scores(df, {f"{c}_score": (c, "positive") for c in components_})
    df = df.withColumns({f"{name}_score": F.round(weighted({f"{c}_score": x for c, x in zip(components_, w, strict=True)}), 9) for name, w in weights.items()})
    return _with_minimum_ranks(df, {f"{name}_rank": f"{name}_score" for name in weights}) if ranked else df


def blends(df: DataFrame, score: str, other: str, shares: Sequence[int] = (0, 5, 10, 15, 20), ranked: bool = True) -> DataFrame:
    """(1 - w) * score + w * other and, if `ranked`, its rank for each share in percent; a share of 0 gives the score itself."""
    blend = lambda w: F.round((1 - w) * F.col(score) + w * F.col(other), 9)
    df = df.withColumns({f"blend_{share}_score": blend(share / 100) for share in shares})
    return _with_minimum_ranks(df, {f"blend_{share}_rank": f"blend_{share}_score" for share in shares}) if ranked else df


def support_label(count: Column | str) -> Column:
    c = F.col(count) if isinstance(count, str) else count
    return F.element_at(F.array(*[F.lit(s) for s in SUPPORT]), c.cast("int") + 1)


def band_counts(df: DataFrame, band_: Column | str) -> DataFrame:
    """(band, n) for each band, 0 for those that no row has."""
    counts = df.groupBy((F.col(band_) if isinstance(band_, str) else band_).alias("band")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(b,) for b in LONG_BANDS], "band string")
    return every.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))
