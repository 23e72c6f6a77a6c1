"""Percentiles, suitability, selection, statistics and data quality on candidate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteselect.operators import checks, features, joins, ranks, scoring, selection, stats
from siteselect.operators.scratch import keep
from siteselect.plans.catalog import Tables, query


def pct(v: str, part: str = "", desc: bool = False) -> str:
    """SQL of an average-rank percentile."""
    over = f"PARTITION BY {part} " if part else ""
    same = f"PARTITION BY {part + ', ' if part else ''}{v}"
    return f"100.0 * (rank() OVER ({over}ORDER BY {v}{' DESC' if desc else ''}) + (count(*) OVER ({same}) - 1) / 2.0) / count(*) OVER ({over.strip()})"


def pos(v: str) -> str:
    return f"CASE WHEN {v} > 0 THEN {pct(v, f'{v} > 0')} ELSE 0 END"


SCORED = f"""comp AS (SELECT *, {pct('distance_to_main_road_m', desc=True)} AS rp, CASE WHEN main_road_segment_count > 0 THEN 100.0 ELSE 0.0 END AS mp, {pos('main_road_length_m')} AS mpb, {pos('road_density_km_per_km2')} AS rd,
  {pct('distance_to_nearest_parking_m', desc=True)} AS pp, {pos('parking_count_within_1000m')} AS pc, {pos('parking_area_m2')} AS pa, {pct('distance_to_nearest_charging_station_m')} AS cd,
  100.0 / (1 + charging_station_count_within_2000m) AS cg, CASE WHEN ac_station_count_within_1000m <= 0 THEN 100.0 ELSE 0 END AS ag, CASE WHEN dc_station_count_within_1000m <= 0 THEN 100.0 ELSE 0 END AS dg FROM $candidate),
means AS (SELECT *, rp * 0.45 + mp * 0.35 + rd * 0.2 AS acc, rp * 0.45 + mpb * 0.35 + rd * 0.2 AS accb, pp * 0.45 + pc * 0.35 + pa * 0.2 AS par, cd * 0.75 + cg * 0.25 AS inf, dg * 0.6 + ag * 0.4 AS tec FROM comp),
scored AS (SELECT *, acc * 0.6 + par * 0.4 AS fea, accb * 0.6 + par * 0.4 AS feab, inf * 0.85 + tec * 0.15 AS need, round(sqrt((acc * 0.6 + par * 0.4) * (inf * 0.85 + tec * 0.15)), 9) AS suit, round(sqrt((accb * 0.6 + par * 0.4) * (inf * 0.85 + tec * 0.15)), 9) AS suitb FROM means)"""
BAND = "CASE WHEN {p} >= 99 THEN 'A' WHEN {p} >= 95 THEN 'B' WHEN {p} >= 80 THEN 'C' WHEN {p} >= 50 THEN 'D' ELSE 'E' END"


@query("p1_percentile_higher", f"SELECT grid_id, round({pct('road_density_km_per_km2')}, 6) AS score FROM $candidate")
def _(t):
    return ranks.percentile_score(t("candidate"), "road_density_km_per_km2", "score").select("grid_id", F.round("score", 6).alias("score"))


@query("p2_percentile_lower", f"SELECT grid_id, round({pct('distance_to_main_road_m', desc=True)}, 6) AS score FROM $candidate")
def _(t):
    return ranks.percentile_score(t("candidate"), "distance_to_main_road_m", "score", higher=False).select("grid_id", F.round("score", 6).alias("score"))


@query("p3_percentile_positive", f"SELECT grid_id, round({pos('parking_area_m2')}, 6) AS score FROM $candidate")
def _(t):
    return ranks.positive_percentile_score(t("candidate"), "parking_area_m2", "score").select("grid_id", F.round("score", 6).alias("score"))


@query("p4_low_count_gap", "SELECT grid_id, round(100.0 / (1 + charging_station_count_within_2000m), 6) AS score FROM $candidate")
def _(t):
    return t("candidate").select("grid_id", F.round(scoring.low_count_gap("charging_station_count_within_2000m"), 6).alias("score"))


@query("p5_absence", "SELECT grid_id, CASE WHEN dc_station_count_within_1000m <= 0 THEN 100.0 ELSE 0.0 END AS score FROM $candidate")
def _(t):
    return t("candidate").select("grid_id", scoring.absence("dc_station_count_within_1000m").alias("score"))


@query("p6_weighted_score", "SELECT grid_id, round(least(100, greatest(0, m1 * 100 * 0.5 + m2 * 100 * 0.3 + m3 * 100 * 0.2)), 6) AS score FROM $candidate")
def _(t):
    c = t("candidate").withColumns({f"s{i}": F.col(f"m{i}") * 100 for i in (1, 2, 3)})
    return c.select("grid_id", F.round(scoring.weighted({"s1": 0.5, "s2": 0.3, "s3": 0.2}), 6).alias("score"))


NAMES = {
    "rp": "road_proximity_score", "rd": "road_density_score", "pp": "parking_proximity_score", "pc": "parking_coverage_score", "pa": "parking_area_score", "cd": "charging_distance_gap_score", "cg": "charging_density_gap_score",
    "ag": "ac_gap_score", "dg": "dc_gap_score", "par": "parking_score", "inf": "infrastructure_gap_score", "tec": "technology_gap_score", "need": "need_score",
}
PROVINCE, PILOT = {**NAMES, "mp": "main_road_presence_score", "acc": "accessibility_score", "fea": "feasibility_score", "sqrt(fea * need)": "suitability_score"}, {**NAMES, "mpb": "main_road_presence_score", "accb": "accessibility_score", "feab": "feasibility_score", "sqrt(feab * need)": "suitability_score"}


def sixes(names: dict[str, str]) -> str:
    return ", ".join(f"round({k}, 6) AS {v}" for k, v in names.items())


PHRASES = """concat(CASE WHEN acc >= 70 AND par >= 70 THEN 'strong road accessibility; strong parking feasibility' WHEN acc >= 70 THEN 'strong road accessibility' WHEN par >= 70 THEN 'strong parking feasibility' ELSE 'moderate site feasibility' END, '; ',
  CASE WHEN inf >= 70 AND tec >= 70 THEN 'large charging infrastructure gap; AC/DC technology gap' WHEN inf >= 70 THEN 'large charging infrastructure gap' WHEN tec >= 70 THEN 'AC/DC technology gap' ELSE 'moderate infrastructure need' END)"""


@query("p7_suitability_province", f"WITH {SCORED}, r AS (SELECT *, {pct('suit')} AS p, rank() OVER (ORDER BY suit DESC) AS k FROM scored) SELECT grid_id, {sixes(PROVINCE)}, k AS suitability_rank, round(p, 6) AS suitability_percentile, {BAND.format(p='p')} AS priority_band, {PHRASES} AS score_explanation FROM r")
def _(t):
    s = scoring.suitability_province(t("candidate").select("grid_id", *scoring.INPUTS), digits=None)
    return s.select("grid_id", *[F.round(c, 6).alias(c) for c in (*PROVINCE.values(), "suitability_percentile")], "suitability_rank", "priority_band", "score_explanation")


LONG_BAND = BAND.replace("'A'", "'A - Highest priority'").replace("'B'", "'B - High priority'").replace("'C'", "'C - Medium priority'").replace("'D'", "'D - Lower priority'").replace("'E'", "'E - Lowest priority'")


@query("p8_suitability_pilot", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY suitb DESC, grid_id) AS k, count(*) OVER () AS n FROM scored), p AS (SELECT *, (n - k) / (n - 1) * 100.0 AS p FROM r) SELECT grid_id, {sixes(PILOT)}, k AS suitability_rank, round(p, 6) AS suitability_percentile, {LONG_BAND.format(p='p')} AS priority_band FROM p")
def _(t):
    s = scoring.suitability_pilot(t("candidate").select("grid_id", *scoring.INPUTS), digits=None)
    return s.select("grid_id", *[F.round(c, 6).alias(c) for c in (*PILOT.values(), "suitability_percentile")], "suitability_rank", "priority_band")


@query("p9_priority_band", f"WITH r AS (SELECT grid_id, m1 * 100 AS p FROM $candidate) SELECT grid_id, {BAND.format(p='p')} AS band FROM r")
def _(t):
    return t("candidate").select("grid_id", scoring.band(F.col("m1") * 100).alias("band"))


def explained(t: Tables):
    return t("candidate").select("grid_id", (F.col("m1") * 100).alias("accessibility_score"), (F.col("m2") * 100).alias("parking_score"), (F.col("m3") * 100).alias("infrastructure_gap_score"), (100 - F.col("m1") * 100).alias("technology_gap_score"), (F.col("m2") * 50).alias("feasibility_score"), (F.col("m3") * 50).alias("need_score"))


@query("p10_explanation_phrases", """WITH e AS (SELECT grid_id, concat_ws('; ', CASE WHEN m1 * 100 >= 70 THEN 'strong road accessibility' END, CASE WHEN m2 * 100 >= 70 THEN 'strong parking feasibility' END) AS s, concat_ws('; ', CASE WHEN m3 * 100 >= 70 THEN 'large charging infrastructure gap' END, CASE WHEN 100 - m1 * 100 >= 70 THEN 'AC/DC technology gap' END) AS n FROM $candidate)
SELECT grid_id, concat(CASE WHEN s = '' THEN 'moderate site feasibility' ELSE s END, '; ', CASE WHEN n = '' THEN 'moderate infrastructure need' ELSE n END) AS explanation FROM e""")
def _(t):
    return explained(t).select("grid_id", scoring.explain_phrases().alias("explanation"))


@query("p11_explanation_extremes", """WITH e AS (SELECT grid_id, m2 * 50 AS fea, m3 * 50 AS need, list_sort([{'v': -(m1 * 100), 'o': 0, 'l': 'road accessibility'}, {'v': -(m2 * 100), 'o': 1, 'l': 'parking suitability'}, {'v': -(m3 * 100), 'o': 2, 'l': 'charging infrastructure gap'}, {'v': -(100 - m1 * 100), 'o': 3, 'l': 'AC/DC technology gap'}]) AS s FROM $candidate)
SELECT grid_id, printf('Feasibility %.1f/100; need %.1f/100. Strengths: %s (%.1f), %s (%.1f). Main constraint: %s (%.1f).', fea, need, s[1].l, -s[1].v, s[2].l, -s[2].v, s[4].l, -s[4].v) AS explanation FROM e""")
def _(t):
    return explained(t).select("grid_id", scoring.explain_extremes().alias("explanation"))


@query("p12_fold_percentile", f"SELECT grid_id, cv_fold, round({pct('m1', 'cv_fold')}, 6) AS score FROM $candidate WHERE target = 0")
def _(t):
    return ranks.percentile_score(t("candidate").where("target = 0"), "m1", "score", by=["cv_fold"]).select("grid_id", "cv_fold", F.round("score", 6).alias("score"))


PERC = ", ".join(f"{pct(f'm{i}', 'cv_fold')} AS p{i}" for i in (1, 2, 3))


def percentiles(t: Tables):
    return ranks.percentile_scores(t("candidate").where("target = 0").select("grid_id", "cv_fold", "m1", "m2", "m3"), {f"p{i}": (f"m{i}", "high") for i in (1, 2, 3)}, by=["cv_fold"])


@query("p13_consensus", f"WITH p AS (SELECT *, {PERC} FROM $candidate WHERE target = 0), c AS (SELECT grid_id, list_sort([p1, p2, p3]) AS l, CAST(p1 >= 80 AS INTEGER) + CAST(p2 >= 80 AS INTEGER) + CAST(p3 >= 80 AS INTEGER) AS a, CAST(p1 >= 90 AS INTEGER) + CAST(p2 >= 90 AS INTEGER) + CAST(p3 >= 90 AS INTEGER) AS b FROM p) SELECT grid_id, round(l[2], 5) AS consensus_median, round(l[1], 5) AS consensus_min, round(l[3], 5) AS consensus_max, a AS models_top_20, b AS models_top_10, a >= 2 AS at_least_two, a = 3 AS all_models FROM c")
def _(t):
    out = scoring.consensus(percentiles(t), ["p1", "p2", "p3"], ranked=False)
    return out.select("grid_id", *[F.round(c, 5).alias(c) for c in ("consensus_median", "consensus_min", "consensus_max")], "models_top_20", "models_top_10", "at_least_two", "all_models")


@query("p14_rank_ensemble", f"WITH p AS (SELECT *, {PERC} FROM $candidate WHERE target = 0) SELECT grid_id, round((p1 + p2 + p3) / 3, 5) AS score FROM p")
def _(t):
    return percentiles(t).select("grid_id", F.round(scoring.ensemble(["p1", "p2", "p3"]), 5).alias("score"))


DEMAND = {"local_only": (1.0, 0.0, 0.0), "near_context": (0.3, 0.4, 0.3), "balanced_context": (0.2, 0.35, 0.45), "broad_context": (0.1, 0.3, 0.6)}
SHARES = (0, 5, 10, 15, 20)
SCENARIOS = f"p AS (SELECT *, {pos('pop0')} AS a, {pos('pop1')} AS b, {pos('pop2')} AS c FROM $candidate), s AS (SELECT *, " + ", ".join(f"round(a * {w[0]} + b * {w[1]} + c * {w[2]}, 9) AS {k}_score" for k, w in DEMAND.items()) + ", m1 * 100 AS suitability_score, m2 * 100 AS feasibility_score, m3 * 100 AS need_score FROM p)"
BLENDS = "s AS (SELECT *, m1 * 100 AS suitability_score, m2 * 100 AS demand, " + ", ".join(f"round((1 - {w / 100}) * (m1 * 100) + {w / 100} * (m2 * 100), 9) AS blend_{w}_score" for w in SHARES) + " FROM $candidate)"


@query("p15_demand_scenarios", f"WITH {SCENARIOS} SELECT grid_id, " + ", ".join(f"round({k}_score, 6) AS {k}_score, rank() OVER (ORDER BY {k}_score DESC) AS {k}_rank" for k in DEMAND) + " FROM s")
def _(t):
    out = scoring.scenarios(t("candidate").select("grid_id", "pop0", "pop1", "pop2"), ["pop0", "pop1", "pop2"], DEMAND)
    return out.select("grid_id", *[c for k in DEMAND for c in (F.round(f"{k}_score", 6).alias(f"{k}_score"), F.col(f"{k}_rank"))])


def blended(t: Tables, ranked: bool = True):
    given = t("candidate").select("grid_id", (F.col("m1") * 100).alias("suitability_score"), (F.col("m2") * 100).alias("demand"))
    return scoring.blends(given, "suitability_score", "demand", SHARES, ranked)


@query("p16_blends", f"WITH {BLENDS} SELECT grid_id, " + ", ".join(f"round(blend_{w}_score, 6) AS blend_{w}_score, rank() OVER (ORDER BY blend_{w}_score DESC) AS blend_{w}_rank" for w in SHARES) + ", true AS identity FROM s")
def _(t):
    same = F.col("blend_0_score") == F.round("suitability_score", 9)
    return blended(t).select("grid_id", *[c for w in SHARES for c in (F.round(f"blend_{w}_score", 6).alias(f"blend_{w}_score"), F.col(f"blend_{w}_rank"))], same.alias("identity"))


@query("p17_adjusted_rank", "WITH b AS (SELECT grid_id, round(0.95 * m1 * 100 + 0.05 * m2 * 100, 9) AS s FROM $candidate) SELECT grid_id, rank() OVER (ORDER BY s DESC) AS adjusted_rank FROM b")
def _(t):
    c = t("candidate").select("grid_id", (F.col("m1") * 100).alias("s"), (F.col("m2") * 100).alias("d"))
    return scoring.blends(c, "s", "d", (5,)).select("grid_id", F.col("blend_5_rank").alias("adjusted_rank"))


@query("p18_support_label", "SELECT grid_id, CASE k WHEN 0 THEN 'no_model_top_20pct' WHEN 1 THEN 'one_of_three_top_20pct' WHEN 2 THEN 'two_of_three_top_20pct' ELSE 'all_three_top_20pct' END AS label, k < 3 AS disagreement FROM (SELECT grid_id, main_road_segment_count AS k FROM $candidate)")
def _(t):
    return t("candidate").select("grid_id", scoring.support_label("main_road_segment_count").alias("label"), (F.col("main_road_segment_count") < 3).alias("disagreement"))


def simple(t: Tables):
    return t("candidate").select("grid_id", "x", "y", (F.col("m1") * 100).alias("suitability_score"), (F.col("m2") * 100).alias("feasibility_score"), (F.col("m3") * 100).alias("need_score"), "o_totalprice")


@query("l1_eligibility", "SELECT grid_id FROM $candidate WHERE m1 * 100 >= 60 AND m2 * 100 >= 60 AND m3 * 100 >= 50")
def _(t):
    return selection.eligible(simple(t)).select("grid_id")


@query("l2_adjusted_eligibility", "SELECT grid_id, rank() OVER (ORDER BY o_totalprice DESC, grid_id) AS place FROM $candidate WHERE m1 * 100 >= 60 AND m2 * 100 >= 60 AND m3 * 100 >= 50")
def _(t):
    return ranks.row_numbers(selection.eligible(simple(t)), "o_totalprice", "grid_id", "place").select("grid_id", "place")


def ranked_points(t: Tables):
    eligible = selection.eligible(simple(t))
    return ranks.row_numbers(eligible, "o_totalprice", "grid_id", "rank").select(F.col("grid_id").alias("point_id"), "x", "y", "rank")


def walk(name: str, score: str, k: int = 20, spacing: float = 4000.0) -> str:
    """SQL of the greedy walk: ranked eligible rows, the walk itself and the rows chosen."""
    kept = "list_append(w.taken, {'point_id': e.grid_id, 'x': e.x, 'y': e.y, 'rank': e.rank})"
    return f"""{name}_ranked AS (SELECT grid_id, x, y, row_number() OVER (ORDER BY {score} DESC, grid_id) AS rank FROM $candidate WHERE m1 * 100 >= 60 AND m2 * 100 >= 60 AND m3 * 100 >= 50),
{name}_walk(rank, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(point_id VARCHAR, x DOUBLE, y DOUBLE, rank BIGINT)[])
  UNION ALL
  SELECT e.rank, CASE WHEN len(list_filter(w.taken, lambda a: (a.x - e.x) * (a.x - e.x) + (a.y - e.y) * (a.y - e.y) < {spacing * spacing})) = 0 THEN {kept} ELSE w.taken END
  FROM {name}_walk w JOIN {name}_ranked e ON e.rank = w.rank + 1 WHERE len(w.taken) < {k}),
{name} AS (SELECT s.point_id, s.x, s.y, s.rank FROM (SELECT unnest(taken) AS s FROM (SELECT taken FROM {name}_walk ORDER BY rank DESC LIMIT 1)))"""


CHOSEN = f"WITH RECURSIVE {walk('chosen', 'o_totalprice')}"
NEAR = "near AS (SELECT a.point_id, arg_min(b.point_id, struct_pack(d := sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), i := b.point_id)) AS nearest_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS nearest_m FROM chosen a JOIN chosen b ON a.point_id <> b.point_id GROUP BY a.point_id)"
APART = "apart AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM chosen a JOIN chosen b ON a.rank < b.rank)"


def chosen(t: Tables):
    return selection.diverse(ranked_points(t), 4000.0, 20)


@query("l3_diverse_top_k", f"{CHOSEN} SELECT * FROM chosen")
def _(t):
    return chosen(t)


@query("l4_spacing_diagnostics", f"{CHOSEN}, {NEAR} SELECT point_id, nearest_id, round(nearest_m, 6) AS nearest_m FROM near")
def _(t):
    return selection.spacing(chosen(t)).withColumn("nearest_m", F.round("nearest_m", 6))


@query("l5_two_shortlists", f"{CHOSEN}, {walk('other', 'm1 * 100')} SELECT coalesce(a.point_id, b.point_id) AS point_id, CASE WHEN b.point_id IS NULL THEN 'removed' WHEN a.point_id IS NULL THEN 'added' ELSE 'common' END AS change FROM chosen a FULL JOIN other b ON a.point_id = b.point_id")
def _(t):
    again = ranks.row_numbers(selection.eligible(simple(t)), "suitability_score", "grid_id", "rank").select(F.col("grid_id").alias("point_id"), "x", "y", "rank")
    return selection.changes(chosen(t).select("point_id"), selection.diverse(again, 4000.0, 20).select("point_id"), "point_id")


@query("j15_pairwise_distances", f"{CHOSEN}, {APART} SELECT round(avg(d), 6) AS mean_m, round(median(d), 6) AS median_m, round(max(d), 6) AS max_m, count(*) AS pairs FROM apart")
def _(t):
    return selection.pairwise(chosen(t)).select(*[F.round(c, 6).alias(c) for c in ("mean_m", "median_m", "max_m")], "pairs")


@query("l6_top_fraction", "SELECT grid_id FROM (SELECT grid_id, row_number() OVER (ORDER BY m2 DESC, grid_id) AS r, count(*) OVER () AS n FROM $candidate) WHERE r <= greatest(1, ceil(n * 0.05))")
def _(t):
    return ranks.top_fraction(t("candidate"), "m2", 0.05, "grid_id").select("grid_id")


@query("l7_failure_counts", "SELECT count(*) FILTER (WHERE m1 * 100 < 60) AS fail_suitability, count(*) FILTER (WHERE m2 * 100 < 60) AS fail_feasibility, count(*) FILTER (WHERE m3 * 100 < 50) AS fail_need, count(*) AS n FROM $candidate")
def _(t):
    return selection.failures(simple(t))


def browsable(t: Tables):
    return simple(t).withColumns({"selection_rank": F.substring("grid_id", 3, 20).cast("long"), "priority_band": scoring.band("suitability_score"), "models_top_20": (F.substring("grid_id", 3, 20).cast("long") % 4).cast("int")})


@query("l8_browse", "SELECT grid_id FROM $candidate WHERE contains(grid_id, '00') AND m1 * 100 >= 80 AND m1 * 100 < 95 AND CAST(substr(grid_id, 3) AS BIGINT) % 4 >= 2")
def _(t):
    return selection.browse(browsable(t), "00", "C", "two_plus", "need").select("grid_id")


@query("l9_compare_highlights", "WITH a AS (SELECT max(m1 * 100) AS top, min(m2 * 100) AS low FROM $candidate) SELECT 'suitability_score' AS metric, round(top, 6) AS best, string_agg(grid_id, ',' ORDER BY grid_id) AS winners FROM $candidate, a WHERE abs(m1 * 100 - top) <= 1e-9 GROUP BY top UNION ALL SELECT 'feasibility_score', round(low, 6), string_agg(grid_id, ',' ORDER BY grid_id) FROM $candidate, a WHERE abs(m2 * 100 - low) <= 1e-9 GROUP BY low")
def _(t):
    return selection.best(simple(t), {"suitability_score": "max", "feasibility_score": "min"}).withColumn("best", F.round("best", 6))


@query("l10_lookup", "SELECT grid_id, x, y FROM $candidate WHERE grid_id = 'C_000000042'")
def _(t):
    return selection.lookup(t("candidate"), " c_000000042 ").select("grid_id", "x", "y")


@query("u1_concatenate", "SELECT o_orderkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def _(t):
    return joins.concatenated(t("orders").select(F.col("o_orderkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")))


@query("u2_set_changes", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'common' END AS change FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.k = b.k")
def _(t):
    k = F.col("o_orderkey").alias("k")
    return selection.changes(t("orders").where("o_orderstatus = 'F'").select(k), t("orders").where("o_orderpriority = '1-URGENT'").select(k), "k")


TOP = "SELECT grid_id FROM (SELECT grid_id, row_number() OVER (ORDER BY {} DESC, grid_id) AS r, count(*) OVER () AS n FROM $candidate) WHERE r <= ceil(n * 0.1)"


@query("u3_top_overlap", f"WITH a AS ({TOP.format('m1')}), b AS ({TOP.format('m2')}) SELECT (SELECT count(*) FROM a) AS selected, (SELECT count(*) FROM a JOIN b USING (grid_id)) AS common, (SELECT count(*) FROM a JOIN b USING (grid_id)) * 1.0::DOUBLE / (SELECT count(*) FROM a) AS fraction")
def _(t):
    return selection.overlap(t("candidate"), "m1", "m2", 0.1, "grid_id")


U4 = """WITH w AS (SELECT grid_id AS k FROM $candidate), a AS (SELECT grid_id AS k FROM $candidate WHERE target = 0 AND main_road_segment_count > 0),
b AS (SELECT grid_id AS k FROM $candidate WHERE target = 1 OR main_road_segment_count = 3 UNION SELECT concat('S_', CAST(s_suppkey AS VARCHAR)) FROM supplier),
u AS (SELECT k, k IN (SELECT k FROM w) AS w, k IN (SELECT k FROM a) AS a, k IN (SELECT k FROM b) AS b FROM (SELECT k FROM w UNION SELECT k FROM a UNION SELECT k FROM b))
SELECT count(*) FILTER (WHERE a) AS first, count(*) FILTER (WHERE b) AS second, count(*) FILTER (WHERE a AND b) AS in_both, count(*) FILTER (WHERE w AND NOT a AND NOT b) AS lost, count(*) FILTER (WHERE NOT w) AS "foreign" FROM u"""


@query("u4_partition_check", U4)
def _(t):
    """Two sets that overlap, lose rows and hold others."""
    c = t("candidate").select("grid_id", "target", "main_road_segment_count")
    others = t("supplier").select(F.concat(F.lit("S_"), F.col("s_suppkey").cast("string")).alias("grid_id"))
    second = c.where("target = 1 or main_road_segment_count = 3").select("grid_id").unionByName(others)
    return checks.partition(c, c.where("target = 0 and main_road_segment_count > 0"), second, "grid_id")


def rk(v: str) -> str:
    return f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


MANY = (
    "main_road_segment_count", "main_road_length_m", "road_density_km_per_km2", "distance_to_main_road_m", "parking_area_m2", "distance_to_nearest_parking_m", "parking_count_within_1000m",
    "distance_to_nearest_charging_station_m", "charging_station_count_within_2000m", "m1", "m2", "m3", "pop0", "pop1", "pop2",
)


@query("x1_spearman", "WITH r AS (SELECT " + ", ".join(f"{rk(c)} AS {c}" for c in MANY) + " FROM $candidate) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS rho FROM r" for i, a in enumerate(MANY) for b in MANY[i + 1 :]))
def _(t):
    return stats.spearman(t("candidate"), MANY).withColumn("rho", F.round("rho", 7))


@query("x2_redundant_pairs", f"WITH r AS (SELECT {rk('main_road_segment_count')} AS a, {rk('main_road_length_m')} AS b FROM $candidate) SELECT 'main_road_segment_count' AS a, 'main_road_length_m' AS b, round(corr(a, b), 8) AS rho FROM r WHERE true")
def _(t):
    return stats.redundant(stats.spearman(t("candidate"), ["main_road_segment_count", "main_road_length_m", "m3"]).where("a <> 'm3'")).withColumn("rho", F.round("rho", 8))


@query("x3_scale_relation", "WITH r AS (SELECT main_road_segment_count AS a, main_road_length_m AS b, main_road_length_m / nullif(main_road_segment_count, 0) AS q FROM $candidate) SELECT round(corr(a, b), 8) AS pearson, min(q) AS ratio_min, median(q) AS ratio_median, max(q) AS ratio_max, round(stddev_pop(q), 8) AS ratio_std, count(q) AS n FROM r")
def _(t):
    return stats.scale_relation(t("candidate"), "main_road_segment_count", "main_road_length_m").withColumns({"pearson": F.round("pearson", 8), "ratio_std": F.round("ratio_std", 8)})


FEATURES = ["parking_area_m2", "pop1", "road_density_km_per_km2"]
LONG = "l AS (" + " UNION ALL ".join(f"SELECT target, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM $candidate" for f in FEATURES) + ")"
CLASSES = f"WITH {LONG}, s AS (SELECT feature, " + ", ".join(f"avg(v) FILTER (WHERE target = {k}) AS mean_{k}, median(v) FILTER (WHERE target = {k}) AS median_{k}, var_samp(v) FILTER (WHERE target = {k}) AS var_{k}, count(*) FILTER (WHERE target = {k}) AS n_{k}, avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE target = {k}) AS nonzero_{k}" for k in (1, 0)) + " FROM l GROUP BY feature)"


@query("x4_standardised_difference", f"{CLASSES} SELECT feature, round((mean_1 - mean_0) / sqrt(((n_1 - 1) * var_1 + (n_0 - 1) * var_0) / (n_1 + n_0 - 2)), 6) AS smd FROM s")
def _(t):
    return stats.class_comparison(t("candidate").select("target", *FEATURES), FEATURES, "target").select("feature", F.round("smd", 6).alias("smd"))


@query("x5_target_comparison", f"{CLASSES} SELECT feature, round(mean_1, 6) AS mean_1, round(mean_0, 6) AS mean_0, median_1, median_0, round(nonzero_1, 6) AS nonzero_1, round(nonzero_0, 6) AS nonzero_0 FROM s")
def _(t):
    out = stats.class_comparison(t("candidate").select("target", *FEATURES), FEATURES, "target")
    return out.select("feature", "median_1", "median_0", *[F.round(c, 6).alias(c) for c in ("mean_1", "mean_0", "nonzero_1", "nonzero_0")])


@query("x6_feature_summary", f"{CLASSES} SELECT s.feature, median_1 AS positive_median, round(100.0 * avg(CASE WHEN v <= median_1 THEN 1.0 ELSE 0.0 END), 6) AS positive_median_percentile FROM s JOIN l ON s.feature = l.feature AND l.target = 0 GROUP BY s.feature, median_1")
def _(t):
    return stats.feature_summary(t("candidate").select("target", *FEATURES), FEATURES, "target").select("feature", "positive_median", F.round("positive_median_percentile", 6).alias("positive_median_percentile"))


def metric_sql(score: str, base: str, others: tuple[str, ...], fractions: tuple[int, ...], limit: float = 70.0) -> str:
    """A row of the metrics of a score, from a table s with the scores."""
    place = lambda c: f"row_number() OVER (ORDER BY {c} DESC, grid_id)"
    top = lambda f: f"count(*) FILTER (WHERE pa <= greatest(1, ceil(n * {f / 100} - 1e-9)) AND pb <= greatest(1, ceil(n * {f / 100} - 1e-9)))"
    tops = "".join(f", {top(f)} AS overlap_{f}, round({top(f)} / max(greatest(1, ceil(n * {f / 100} - 1e-9))), 7) AS overlap_fraction_{f}" for f in fractions)
    spearman = "".join(f", round(corr(ra, ro{i}), 7) AS spearman_{o}" for i, o in enumerate((base, *others)))
    inner = f"SELECT {score} AS v, {place(score)} AS pa, {place(base)} AS pb, count(*) OVER () AS n, {rk(score)} AS ra" + "".join(f", {rk(o)} AS ro{i}" for i, o in enumerate((base, *others))) + " FROM s"
    return f"SELECT '{score}' AS score, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(max(v), 6) AS max{spearman}{tops}, round(median(v) FILTER (WHERE pb <= 20), 6) AS top_median, round(min(v) FILTER (WHERE pb <= 20), 6) AS top_min, count(*) FILTER (WHERE pb <= 20 AND v >= {limit}) AS top_at_limit FROM ({inner})"


def rounded_metrics(m):
    sixes_ = {"median", "mean", "max", "top_median", "top_min"}
    return m.select(*[F.round(c, 6).alias(c) if c in sixes_ else F.round(c, 7).alias(c) if c.startswith(("spearman", "overlap_fraction")) else F.col(c) for c in m.columns])


@query("x8_scenario_metrics", f"WITH {SCENARIOS} " + " UNION ALL ".join(metric_sql(f"{k}_score", "suitability_score", ("feasibility_score", "need_score"), (1, 5)) for k in DEMAND))
def _(t):
    given = t("candidate").select("grid_id", "pop0", "pop1", "pop2", "m1", "m2", "m3")
    scored = scoring.scenarios(given, ["pop0", "pop1", "pop2"], DEMAND, ranked=False).withColumns({"suitability_score": F.col("m1") * 100, "feasibility_score": F.col("m2") * 100, "need_score": F.col("m3") * 100})
    return rounded_metrics(stats.score_metrics(scored, [f"{k}_score" for k in DEMAND], "suitability_score", ["feasibility_score", "need_score"]))


@query("x9_blend_metrics", f"WITH {BLENDS} " + " UNION ALL ".join(metric_sql(f"blend_{w}_score", "suitability_score", ("demand",), (1, 5)) for w in SHARES))
def _(t):
    return rounded_metrics(stats.score_metrics(blended(t, ranked=False), [f"blend_{w}_score" for w in SHARES], "suitability_score", ["demand"]))


@query("x9_rank_shift", f"WITH {BLENDS}, k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY blend_{w}_score DESC) AS k{w}" for w in SHARES) + " FROM s) " + " UNION ALL ".join(f"SELECT {w} AS share, median(abs(k0 - k{w})) AS median_shift, quantile_cont(abs(k0 - k{w}), 0.95) AS p95_shift, max(abs(k0 - k{w})) AS max_shift FROM k" for w in SHARES))
def _(t):
    return stats.rank_shifts(blended(t), "blend_0_rank", {f"blend_{w}_rank": w for w in SHARES})


@query("x10_shortlist_summary", f"{CHOSEN}, {NEAR}, {APART} SELECT (SELECT round(min(nearest_m), 6) FROM near) AS min_spacing_m, (SELECT count(*) FROM near) AS n, (SELECT round(avg(d), 6) FROM apart) AS mean_m, (SELECT round(median(d), 6) FROM apart) AS median_m, (SELECT round(max(d), 6) FROM apart) AS max_m, (SELECT count(*) FROM apart) AS pairs, max(rank) AS worst_rank, round(median(m1 * 100), 6) AS median_score, round(min(m1 * 100), 6) AS minimum_score FROM chosen JOIN $candidate ON grid_id = point_id")
def _(t):
    picked = keep(chosen(t))
    scores = picked.join(simple(t).select(F.col("grid_id").alias("point_id"), "suitability_score"), "point_id").agg(F.max("rank").alias("worst_rank"), F.round(F.median("suitability_score"), 6).alias("median_score"), F.round(F.min("suitability_score"), 6).alias("minimum_score"))
    apart = selection.pairwise(picked).select(*[F.round(c, 6).alias(c) for c in ("mean_m", "median_m", "max_m")], "pairs")
    return selection.spacing(picked).agg(F.round(F.min("nearest_m"), 6).alias("min_spacing_m"), F.count("*").alias("n")).join(apart, F.lit(True)).join(scores, F.lit(True))


SUPPORT = f"p AS (SELECT *, {PERC} FROM $candidate WHERE target = 0), s AS (SELECT grid_id, m1 * 100 AS suitability_score, list_sort([p1, p2, p3])[2] AS consensus_median, list_sort([p1, p2, p3])[3] - list_sort([p1, p2, p3])[1] AS spread, CAST(p1 >= 80 AS INTEGER) + CAST(p2 >= 80 AS INTEGER) + CAST(p3 >= 80 AS INTEGER) AS k, CAST(p1 >= 90 AS INTEGER) + CAST(p2 >= 90 AS INTEGER) + CAST(p3 >= 90 AS INTEGER) AS k10 FROM p)"


@query("x11_support_metrics", f"WITH {SUPPORT}, m AS ({metric_sql('consensus_median', 'suitability_score', (), (1, 5, 10))}), b AS (SELECT * FROM s ORDER BY suitability_score DESC, grid_id LIMIT 20) SELECT m.*, (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM s WHERE k >= 2) AS two_plus, (SELECT count(*) FROM s WHERE k = 3) AS all_models, (SELECT round(median(spread), 6) FROM b) AS top_spread, (SELECT count(*) FROM b WHERE k >= 2) AS top_two_plus, (SELECT count(*) FROM b WHERE k = 3) AS top_all_models, (SELECT count(*) FROM b WHERE k10 >= 2) AS top_two_plus_10 FROM m")
def _(t):
    c = scoring.consensus(percentiles(t), ["p1", "p2", "p3"], ranked=False).withColumn("suitability_score", F.col("m1") * 100)
    c = keep(c.select("grid_id", "suitability_score", "consensus_median", "consensus_spread", "at_least_two", "all_models", "models_top_10"))
    m = rounded_metrics(stats.score_metrics(c, ["consensus_median"], "suitability_score", fractions=(0.01, 0.05, 0.1)))
    every = c.agg(F.count("*").alias("n"), F.sum(F.col("at_least_two").cast("long")).alias("two_plus"), F.sum(F.col("all_models").cast("long")).alias("all_models"))
    best = c.orderBy(F.desc("suitability_score"), "grid_id").limit(20).agg(F.round(F.median("consensus_spread"), 6).alias("top_spread"), F.sum(F.col("at_least_two").cast("long")).alias("top_two_plus"), F.sum(F.col("all_models").cast("long")).alias("top_all_models"), F.sum((F.col("models_top_10") >= 2).cast("long")).alias("top_two_plus_10"))
    return m.join(every, F.lit(True)).join(best, F.lit(True))


@query("a17_band_counts", f"WITH r AS (SELECT {BAND.format(p='m1 * 100')} AS band FROM $candidate) SELECT b.band, count(r.band) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(band) LEFT JOIN r ON b.band = r.band GROUP BY b.band")
def _(t):
    return scoring.band_counts(t("candidate"), scoring.band(F.col("m1") * 100))


@query("a18_histogram", "SELECT least(CAST(floor(m1 * 40) AS BIGINT), 39) AS bin, count(*) AS n, round((SELECT median(m1) FROM $candidate), 9) AS median FROM $candidate GROUP BY 1")
def _(t):
    return stats.histogram(t("candidate"), "m1", 0.0, 1.0).withColumn("median", F.round("median", 9))


@query("a19_distribution", f"WITH {LONG} SELECT feature, count(v) AS n, count(*) FILTER (WHERE v = 0) AS zeros, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99, max(v) AS max FROM l GROUP BY feature")
def _(t):
    out = features.distribution(t("candidate").select(*[F.col(f).cast("double").alias(f) for f in FEATURES]), FEATURES)
    return out.select("feature", "n", "zeros", *[F.round(c, 6).alias(c) for c in ("mean", "p90", "p99")], "max")


@query("a21_summary_statistics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS lowest, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(median({c}) AS DOUBLE) AS middle, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3, CAST(max({c}) AS DOUBLE) AS highest FROM $candidate" for c in MANY))
def _(t):
    return stats.summary(t("candidate"), MANY)


@query("v1_unique_keys", "SELECT l_orderkey * 10 + l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return checks.repeated(t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "k")


RULES = {
    "v2_missing": (lambda: checks.missing(["capacity", "x"]), "station", {"capacity is missing or not finite": "capacity IS NULL", "x is missing or not finite": "x IS NULL"}),
    "v3_counts": (lambda: {**checks.negative(["pop0"]), **checks.not_integer(["road_density_km_per_km2"])}, "candidate", {"pop0 is negative": "pop0 < 0", "road_density_km_per_km2 is no whole number": "road_density_km_per_km2 <> floor(road_density_km_per_km2)"}),
    "v4_nested_radii": (lambda: checks.nested("pop0", "pop1", "pop2"), "candidate", {"pop0 above pop1": "pop0 > pop1", "pop1 above pop2": "pop1 > pop2"}),
    "v5_ranges": (lambda: {**checks.between("m1", 0, 0.5), "density differs": F.abs(F.col("road_density_km_per_km2") * 8 - F.round(F.col("road_density_km_per_km2") * 8)) > 1e-9}, "candidate", {"m1 outside 0 to 0.5": "NOT m1 BETWEEN 0 AND 0.5", "density differs": "false"}),
}


def _rule(name, rules, table, sql):
    body = " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM ${table}" for k, c in sql.items())
    query(name, body)(lambda t: checks.report(t(table), rules()))


for _name, (_rules, _table, _sql) in RULES.items():
    _rule(_name, _rules, _table, _sql)


@query("v7_leakage_guard", "SELECT grid_id, pop0, target FROM $candidate")
def _(t):
    return checks.require(t("candidate").select("grid_id", "pop0", "target"), ["grid_id", "pop0"], forbidden=["has_existing_charging_station", "distance_to_nearest_charging_station_m"])


V9 = f"""{CHOSEN}, {NEAR}, b AS (SELECT c.*, nearest_m, ROW_NUMBER() OVER (ORDER BY rank) AS place FROM chosen c LEFT JOIN near n ON c.point_id = n.point_id)
SELECT unnest(['spacing below the minimum', 'x outside 0 to 30000', 'y outside 0 to 40000', 'place below 3', 'support is not 0 to 3', 'place is missing or not finite', 'x is missing or not finite', 'y is missing or not finite', 'support is missing or not finite', 'not 25 rows', 'ids repeat', 'ranks repeat', 'ranks do not run from 1']) AS rule,
  unnest([count(*) FILTER (WHERE nearest_m < 5000), count(*) FILTER (WHERE NOT x BETWEEN 0 AND 30000), count(*) FILTER (WHERE NOT y BETWEEN 0 AND 40000), count(*) FILTER (WHERE place < 3), count(*) FILTER (WHERE place % 5 NOT IN (0, 1, 2, 3)),
    count(*) FILTER (WHERE place IS NULL), count(*) FILTER (WHERE x IS NULL), count(*) FILTER (WHERE y IS NULL), count(*) FILTER (WHERE place IS NULL), abs(count(*) - 25), count(*) - count(DISTINCT point_id), count(*) - count(DISTINCT place), CAST(min(place) <> 1 OR max(place) <> count(*) AS BIGINT)]) AS violations FROM b"""


@query("v9_shortlist_rules", V9)
def _(t):
    """Rules that this shortlist breaks and others that it keeps."""
    picked = keep(ranks.numbered(chosen(t), [F.asc("rank")], "place"))
    both = picked.join(selection.spacing(picked), "point_id", "left").withColumn("support", F.col("place") % 5)
    return checks.shortlist(both, 25, 5000.0, {"x": (0, 30000), "y": (0, 40000)}, {"place": 3}, ["support"], rank="place")


V10 = """WITH own AS (SELECT station_id, count(*) FILTER (WHERE current IN ('AC', 'DC')) AS a, count(*) AS n FROM $socket GROUP BY 1),
st AS (SELECT s_suppkey AS station_id, CASE WHEN s_suppkey % 7 = 0 THEN coalesce(a, 0) - 1 ELSE coalesce(n, 0) END AS socket_count, coalesce(a, 0) AS a, coalesce(n, 0) AS n FROM supplier LEFT JOIN own ON station_id = s_suppkey WHERE s_suppkey % 10 <> 3)
SELECT 'socket without station' AS rule, count(*) AS violations FROM $socket WHERE station_id NOT IN (SELECT station_id FROM st)
UNION ALL SELECT 'AC and DC above the declared total', count(*) FILTER (WHERE a > socket_count) FROM st UNION ALL SELECT 'declared total differs', count(*) FILTER (WHERE n <> socket_count) FROM st
UNION ALL SELECT 'socket_count differ from the whole', CAST(abs((SELECT sum(socket_count) FROM st) - (SELECT count(*) FROM $socket)) AS BIGINT)"""


@query("v10_registry_integrity", V10)
def _(t):
    """A registry that lacks a tenth of its stations, and a seventh of whose totals are wrong."""
    own = t("socket").groupBy("station_id").agg(F.count_if(F.col("current").isin("AC", "DC")).alias("a"), F.count("*").alias("n"))
    stations = t("supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("station_id")).join(own, "station_id", "left").fillna(0)
    declared = F.when(F.col("station_id") % 7 == 0, F.col("a") - 1).otherwise(F.col("n"))
    return checks.registry(stations.select("station_id", declared.alias("socket_count")), t("socket"))


V6 = """WITH c AS (SELECT target, ac_station_count_within_1000m AS n FROM $candidate)
SELECT unnest(['target is not binary', 'flag differs', 'no row of class 0', 'no row of class 1']) AS rule,
  unnest([count(*) FILTER (WHERE target NOT IN (0, 1)), count(*) FILTER (WHERE (n > 0) <> (target = 1)), CAST(count(*) FILTER (WHERE target = 0) = 0 AS BIGINT), CAST(count(*) FILTER (WHERE target = 1) = 0 AS BIGINT)]) AS violations FROM c"""


@query("v6_target", V6)
def _(t):
    c = t("candidate")
    rules = {"target is not binary": ~F.col("target").isin(0, 1), "flag differs": (F.col("ac_station_count_within_1000m") > 0) != (F.col("target") == 1)}
    return checks.report(c, rules).unionByName(checks.classes(c, "target"))
