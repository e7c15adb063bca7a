"""Match-engine keys: each binds operators to the given tables and states its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import scalar as S
from waymark.operators import catalogue as C, fits, pairs as P, shortlist as L
from waymark.plans import bindings as B, oracle_match as O

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _shortlist(spark, sf):
    return L.shortlist(B.ready_profiles(spark, sf), B.ready_options(spark, sf))


def _catalogue(spark, sf):
    return B.ready_profiles(spark, sf), B.ready_options(spark, sf)


# ---- sources and scalar work ---------------------------------------------

@query("scan_options", O.with_(O.PROFILE, O.OPTION) + """
SELECT option_id, name, country, region, city, tuition, living_cost, scholarship_availability, aid_certainty, full_ride_possible,
  minimum_ielts, sat_policy, gpa_expectation, array_to_string(supported_majors, '|') AS supported_majors, application_deadline FROM v_option""")
def scan_options(spark, sf):
    return B.options(spark, sf).select(
        "option_id", "name", "country", "region", "city", "tuition", "living_cost", "scholarship_availability", "aid_certainty",
        "full_ride_possible", "minimum_ielts", "sat_policy", "gpa_expectation",
        F.array_join("supported_majors", "|").alias("supported_majors"), "application_deadline",
    )


@query("clamp_scale", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS copies,
  CAST(sum({O.rnd(O.scale('l_quantity - 25', '-20', '0', 15, 78))}) AS BIGINT) AS low_side, CAST(sum({O.rnd(O.scale('l_quantity', '250', '0', 25, 92))}) AS BIGINT) AS reversed_anchors,
  CAST(sum({O.rnd(O.scale('l_quantity', '5', '5', 0, 70))}) AS BIGINT) AS equal_anchors, CAST(sum(CAST({O.clamp('l_quantity * 3 - 20')} AS BIGINT)) AS BIGINT) AS clamped
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def clamp_scale(spark, sf):
    qty = F.col("l_quantity")
    return B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(S.js_round(S.scale(qty - 25, -20, 0, 15, 78))).alias("low_side"),
        F.sum(S.js_round(S.scale(qty, 250, 0, 25, 92))).alias("reversed_anchors"),
        F.sum(S.js_round(S.scale(qty, 5, 5, 0, 70))).alias("equal_anchors"),
        F.sum(S.clamp(qty * 3 - 20, 0.0, 100.0).cast("bigint")).alias("clamped"),
    )


@query("fit_label", f"SELECT o_orderkey, CAST(o_orderkey % 101 AS INTEGER) AS score, {O.label('o_orderkey % 101')} AS label FROM orders")
def fit_label(spark, sf):
    score = (F.col("o_orderkey") % 101).cast("int")
    return B.table(spark, sf, "orders").select("o_orderkey", score.alias("score"), S.fit_label(score).alias("label"))


@query("normalize_gpa", O.with_(O.PROFILE) + "SELECT profile_id, gpa_scale, gpa_value, gpa_norm FROM v_profile")
def normalize_gpa(spark, sf):
    return B.profiles(spark, sf).select(
        "profile_id", "gpa_scale", "gpa_value", S.normalize_gpa(F.col("gpa_value"), F.col("gpa_scale")).alias("gpa_norm"),
    )


@query("english_band", O.with_(O.PROFILE) + "SELECT profile_id, english_test, english_score, ielts_band FROM v_profile")
def english_band(spark, sf):
    return B.profiles(spark, sf).select(
        "profile_id", "english_test", "english_score", S.english_band(F.col("english_test"), F.col("english_score")).alias("ielts_band"),
    )


@query("format_usd", f"""SELECT o_orderkey, {O.usd("CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 0 ELSE CAST(floor(o_totalprice + 0.5e0) AS BIGINT) END")} AS price_text FROM orders""")
def format_usd(spark, sf):
    k = F.col("o_orderkey") % 10
    value = F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return B.table(spark, sf, "orders").select("o_orderkey", S.format_usd(value).alias("price_text"))


# ---- pairing and fits ----------------------------------------------------

@query("profile_option_pairs", O.PAIRS + "SELECT profile_id, option_id, country, region FROM v_pair")
def profile_option_pairs(spark, sf):
    return P.pair_grid(
        B.profiles(spark, sf).select("profile_id"), B.options(spark, sf).select("option_id", "country", "region"),
    ).select("profile_id", "option_id", "country", "region")


@query("major_match_join", O.PAIRS + """
SELECT profile_id, intended_major, match_kind, closest, count(*) AS options FROM (
  SELECT profile_id, intended_major, CASE WHEN major_exact THEN 'exact' WHEN adjacent_pos IS NOT NULL THEN 'adjacent' ELSE 'none' END AS match_kind,
    CASE WHEN NOT major_exact THEN supported_majors[adjacent_pos] END AS closest FROM v_pair) x GROUP BY ALL""")
def major_match_join(spark, sf):
    """How the options of the whole catalogue match a profile's major."""
    return C.major_summary(*_catalogue(spark, sf))


@query("region_fallback_join", O.with_(O.PROFILE, O.OPTION) + """
SELECT profile_id, region, count(*) AS options FROM (SELECT DISTINCT p.profile_id, o.option_id, o.region FROM v_profile p, v_option o WHERE p.wants_specific
 AND NOT list_contains(p.preferred_countries, o.country)
 AND EXISTS (SELECT 1 FROM v_country c WHERE list_contains(p.preferred_countries, c.country) AND c.region = o.region)) x GROUP BY ALL""")
def region_fallback_join(spark, sf):
    """How many options a profile's regions hold beyond its countries; countries are counted first, so no option is paired."""
    wishes = B.ready_profiles(spark, sf).where("wants_specific").select(
        "profile_id", "preferred_countries", F.explode("preferred_regions").alias("region"),
    )
    offers = B.options(spark, sf).groupBy("region", "country").agg(F.count(F.lit(1)).alias("n"))
    return P.salted_join(wishes, offers, "region", "profile_id").where(
        ~F.array_contains("preferred_countries", F.col("country"))
    ).groupBy("profile_id", "region").agg(F.sum("n").alias("options"))


@query("in_scope_flag", O.PAIRS + "SELECT profile_id, count(*) FILTER (WHERE NOT outside_preferred) AS inside, count(*) FILTER (WHERE outside_preferred) AS outside FROM v_scored GROUP BY profile_id")
def in_scope_flag(spark, sf):
    """Options inside and outside a profile's countries, from counts per country."""
    options = B.options(spark, sf)
    per_country = options.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    total = options.agg(F.count(F.lit(1))).scalar()
    profiles = B.ready_profiles(spark, sf).select("profile_id", "wants_specific", "preferred_countries")
    wanted = profiles.where("wants_specific").select("profile_id", F.explode(F.array_distinct("preferred_countries")).alias("country"))
    own = P.salted_join(wanted, per_country, "country", "profile_id").groupBy("profile_id").agg(F.sum("n").alias("own"))
    inside = F.when(F.col("wants_specific"), F.coalesce("own", F.lit(0).cast("bigint"))).otherwise(total)
    return profiles.join(own, "profile_id", "left").select("profile_id", inside.alias("inside"), (total - inside).alias("outside"))


def _pairs(spark, sf):
    """Every profile with every option; rows are scored where they arise, and nothing is kept of them."""
    return P.pair_grid(B.ready_profiles(spark, sf).select(*P.PROFILE_SCORING), B.ready_options(spark, sf).select(*P.OPTION_SCORING))


def _fit(key: str, name: str, label: str):
    """A fit over the whole catalogue, per profile and label; the statement scores every pair."""
    sql = f"SELECT profile_id, {label} AS {name}_label, count(*) AS options, CAST(sum({name}_score) AS BIGINT) AS score_sum FROM v_scored GROUP BY ALL"

    @query(key, O.PAIRS + sql)
    def run(spark, sf):
        return C.fit_summary(*_catalogue(spark, sf), name)
    return run


_fit("academic_fit", "academic", "academic_label")
_fit("scholarship_fit", "scholarship", O.label("scholarship_score"))
_fit("major_fit", "major", "CASE major_score WHEN 100 THEN 'excellent' WHEN 62 THEN 'moderate' ELSE 'weak' END")
_fit("geographic_fit", "geography", O.label("geography_score"))
_fit("test_fit", "tests", O.label("tests_score"))
_fit("preference_fit", "preference", O.label("preference_score"))


@query("financial_fit", O.PAIRS + f"SELECT profile_id, option_id, financial_score, verdict, CASE WHEN verdict = 'unknown' THEN 'unknown' ELSE {O.label('financial_score')} END AS financial_label, total_annual_cost, best_case_net_cost, funding_gap FROM v_scored")
def financial_fit(spark, sf):
    """What every option of the catalogue would cost each profile."""
    return fits.financial_fit(_pairs(spark, sf)).select(
        "profile_id", "option_id", "financial_score", "verdict", "financial_label", "total_annual_cost", "best_case_net_cost", "funding_gap",
    )


@query("overall_score", O.PAIRS + "SELECT profile_id, option_id, academic_score, financial_score, CAST(major_score AS INTEGER) AS major_score, geography_score, scholarship_score, tests_score, preference_score, outside_preferred, score, category FROM v_scored")
def overall_score(spark, sf):
    """All seven fits and the weighted score of each profile with each option of the catalogue."""
    return fits.score_pairs(_pairs(spark, sf)).select("profile_id", "option_id", *fits.SCORES, "outside_preferred", "score", "category")


@query("requires_aid", O.PAIRS + "SELECT profile_id, count(*) FILTER (WHERE verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS requires_aid FROM v_scored GROUP BY profile_id")
def requires_aid(spark, sf):
    """Options of the whole catalogue that a profile could only pay with aid, counted without pairs."""
    counts = L.verdict_counts(B.ready_profiles(spark, sf), B.ready_options(spark, sf))
    return counts.select("profile_id", F.col("aid_dependent_count").alias("requires_aid"))


@query("viable_filter", O.PAIRS + "SELECT profile_id, country, count(*) AS viable FROM v_scored WHERE NOT outside_preferred AND verdict <> 'above-budget' GROUP BY ALL")
def viable_filter(spark, sf):
    """Options of the whole catalogue that are in scope and not above the budget, counted without pairs."""
    return C.viable_counts(*_catalogue(spark, sf))


@query("rank_options", O.PAIRS + "SELECT * FROM (SELECT profile_id, option_id, score, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, name, option_id) AS INTEGER) AS rank FROM v_scored) r WHERE rank <= 8")
def rank_options(spark, sf):
    """The best options of each profile by score alone; rows are cut to the best before they leave their task."""
    scored = L.scored_candidates(B.ready_profiles(spark, sf), B.ready_options(spark, sf), min_results=2**31 - 1, best=fixed.RESULT_COUNT)
    return L.rank_options(scored).where(F.col("rank") <= fixed.RESULT_COUNT).select("profile_id", "option_id", "score", "rank")


@query("shortlist_relaxation", O.ALL + f"""
SELECT profile_id, option_id, CAST(rank AS INTEGER) AS rank, score, category, verdict, mode = 3 AS relaxed,
 CASE WHEN mode = 2 THEN {O.q(fixed.NOTICE_TIGHT)} WHEN mode = 3 AND open_to_any_country THEN {O.q(fixed.NOTICE_OPEN)}
  WHEN mode = 3 THEN {O.fill(fixed.NOTICE_WIDENED, noun="CASE WHEN len(preferred_countries) = 1 THEN 'country' ELSE 'countries' END", chosen="array_to_string(preferred_countries, ', ')")} END AS notice
FROM v_shortlist""")
def shortlist_relaxation(spark, sf):
    profiles = B.ready_profiles(spark, sf)
    listed = L.shortlist(profiles, B.ready_options(spark, sf))
    wish = profiles.select("profile_id", "preferred_countries", "open_to_any_country")
    return listed.join(wish, "profile_id").select(
        "profile_id", "option_id", "rank", "score", "category", "verdict", (F.col("mode") == 3).alias("relaxed"),
        L.notice(F.col("mode"), F.col("preferred_countries"), F.col("open_to_any_country")).alias("notice"),
    )


@query("verdict_counts", O.ALL + """
SELECT c.*, s.strong_count, s.shortlist_size FROM v_counts c JOIN (
  SELECT profile_id, count(*) FILTER (WHERE category = 'strong') AS strong_count, count(*) AS shortlist_size FROM v_shortlist GROUP BY profile_id) s USING (profile_id)""")
def verdict_counts(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    counts = L.verdict_counts(profiles, options)
    return counts.join(L.strong_matches(L.shortlist(profiles, options)), "profile_id")
