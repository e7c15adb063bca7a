"""The seven fits and the weighted score, as columns over profile-option pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.functions import scalar as S

NONE = fixed.NO_PREFERENCE


def _int(c: Column) -> Column:
    return c.cast("int")


def academic_raw() -> Column:
    delta = F.col("gpa_norm") - F.col("academic_bar")
    base = F.when(delta >= 0, S.scale(delta, 0, 8, 78, 100)).otherwise(S.scale(delta, -20, 0, 15, 78))
    return F.when(F.col("class_rank").isin("top-1", "top-5"), S.clamp(base + 6, 0.0, 100.0)).otherwise(base)


def academic_fit(pairs: DataFrame) -> DataFrame:
    raw = academic_raw()
    missing = F.col("gpa_norm").isNull()
    return pairs.withColumns({
        "academic_score": F.when(missing, F.lit(50)).otherwise(_int(S.js_round(raw))),
        "academic_label": F.when(missing, F.lit("unknown")).otherwise(S.fit_label(raw)),
    })


def verdict() -> Column:
    total, best, ceiling = F.col("total_annual_cost"), F.col("best_case_net_cost"), F.col("ceiling")
    return (
        F.when(total.isNull(), "unknown")
        .when(total <= ceiling, "strong-financial-fit")
        .when((best <= ceiling) & F.col("aid_dependable"), "potentially-affordable-with-aid")
        .when(best <= ceiling, "aid-dependent")
        .otherwise("above-budget")
    )


def financial_fit(pairs: DataFrame) -> DataFrame:
    total = F.col("total_annual_cost").cast("double")
    budget, ceiling = F.col("budget_annual_usd").cast("double"), F.col("ceiling").cast("double")
    best = F.col("best_case_net_cost")
    gap = F.greatest(F.lit(0).cast("bigint"), best - F.col("ceiling"))
    reliance = (total - ceiling) / F.nullif(total, F.lit(0.0))
    reliability = F.when(F.col("aid_certainty") == "competitive", F.lit(1.0)).otherwise(F.lit(0.5))
    score = (
        F.when(total.isNull(), F.lit(50).cast("bigint"))
        .when(total <= budget, F.lit(100).cast("bigint"))
        .when(total <= ceiling, S.js_round(S.scale(total, ceiling, budget, 78, 96)))
        .when((best <= F.col("ceiling")) & F.col("aid_dependable"),
              S.js_round(S.clamp(F.lit(58.0) + (F.lit(1.0) - reliance) * F.lit(22.0), 0.0, 100.0)))
        .when(best <= F.col("ceiling"),
              S.js_round(S.clamp(F.lit(30.0) + (F.lit(1.0) - reliance) * F.lit(14.0) + reliability * F.lit(8.0), 0.0, 100.0)))
        .otherwise(S.js_round(S.scale(gap.cast("double"), 0, F.greatest(total, F.lit(1.0)), 34, 2)))
    )
    return pairs.withColumns({
        "financial_score": _int(score),
        "verdict": verdict(),
        "funding_gap": F.when(total.isNotNull(), gap),
    }).withColumn(
        "financial_label",
        F.when(F.col("verdict") == "unknown", F.lit("unknown")).otherwise(S.fit_label(F.col("financial_score"))),
    )


def scholarship_fit(pairs: DataFrame) -> DataFrame:
    ride = F.coalesce("full_ride_possible", F.lit(False))
    tuition = F.coalesce("full_tuition_possible", F.lit(False))
    need = F.col("aid_need")
    score = (
        F.when(need == "none", 80)
        .when(need == "full-ride", F.when(ride, 96).when(tuition, 58).otherwise(14))
        .when(need == "full-tuition", F.when(ride | tuition, 90).otherwise(26))
        .otherwise(F.element_at(S.lit_map(fixed.PARTIAL_AID_SCORE), F.col("scholarship_availability")))
    )
    return pairs.withColumn("scholarship_score", _int(score)).withColumn("scholarship_label", S.fit_label(F.col("scholarship_score")))


def major_fit(pairs: DataFrame) -> DataFrame:
    score = F.element_at("major_ratings", F.col("major_index"))
    return pairs.withColumn("major_score", _int(score)).withColumn(
        "major_label", F.when(F.col("major_score") == 100, "excellent").when(F.col("major_score") == 62, "moderate").otherwise("weak"),
    )


def geographic_fit(pairs: DataFrame) -> DataFrame:
    base = (
        F.when(~F.col("wants_specific"), 78)
        .when(F.array_contains("preferred_countries", F.col("country")), 100)
        .when(F.array_contains("preferred_regions", F.col("region")), 58)
        .otherwise(20)
    )
    city = (
        F.when(F.col("city_size_preference") == NONE, base)
        .when(F.col("city_size_preference") == F.col("city_size"), S.clamp(base + 8))
        .otherwise(S.clamp(base - 5))
    )
    wanted_setting = (F.col("environment_preference") != NONE) & (F.col("environment_preference") == F.col("environment"))
    setting = F.when(wanted_setting, S.clamp(city + 5)).otherwise(city)
    language = F.when(F.col("english_taught_only") & ~F.col("teaches_english"), S.clamp(setting - 35)).otherwise(setting)
    return pairs.withColumn("geography_score", _int(language)).withColumn("geography_label", S.fit_label(F.col("geography_score")))


def english_part() -> Column:
    band, need = F.col("ielts_band"), F.col("ielts_need")
    return (
        F.when(band.isNull(), F.lit(45.0))
        .when(need.isNull(), F.lit(80.0))
        .when(band >= need + F.lit(0.5), F.lit(100.0))
        .when(band >= need, F.lit(88.0))
        .otherwise(S.scale(need - band, 2, 0, 10, 62))
    )


def sat_part() -> Column:
    sat, target, policy = F.col("sat_score"), F.col("sat_target"), F.col("sat_policy")
    return (
        F.when(policy == "not-used", F.lit(92.0))
        .when(sat.isNotNull() & target.isNull(), F.lit(80.0))
        .when(sat.isNotNull() & (sat >= target), F.lit(100.0))
        .when(sat.isNotNull(), S.scale((target - sat).cast("double"), 250, 0, 25, 92))
        .when(policy == "required", F.lit(30.0))
        .when(policy == "recommended", F.lit(58.0))
        .otherwise(F.lit(85.0))
    )


def test_fit(pairs: DataFrame) -> DataFrame:
    score = S.js_round((english_part() + sat_part()) / F.lit(2.0))
    return pairs.withColumn("tests_score", _int(score)).withColumn("tests_label", S.fit_label(F.col("tests_score")))


def preference_fit(pairs: DataFrame) -> DataFrame:
    research, prestige = F.col("preferences.research"), F.col("preferences.prestige")
    research_align = S.clamp(F.lit(100) - F.abs(research - (F.col("research_intensity") - 1) * 25))
    prestige_align = S.clamp(F.lit(100) - F.abs(prestige - (F.col("prestige_tier") - 1) * 25))
    size_align = F.when(F.col("size_preference") == NONE, 75).when(F.col("size_preference") == F.col("size"), 100).otherwise(45)
    w_research, w_prestige = F.greatest(research, F.lit(20)), F.greatest(prestige, F.lit(20))
    weighted = research_align * w_research + prestige_align * w_prestige + size_align * 40
    score = S.js_round(weighted.cast("double") / (w_research + w_prestige + 40).cast("double"))
    return pairs.withColumn("preference_score", _int(score)).withColumn("preference_label", S.fit_label(F.col("preference_score")))


def _weighted(scores: dict[str, Column], weights: dict) -> Column:
    """Left-to-right weighted sum."""
    total = None
    for name, weight in weights.items():
        term = scores[name].cast("double") * F.lit(weight)
        total = term if total is None else total + term
    return total


def most_score(known: list[str]) -> Column:
    """A score that no pair with these fits exceeds: the others count in full, and the sum is rounded step by step like that of the score."""
    scores = {name: F.col(f"{name}_score") if name in known else F.lit(100) for name in fixed.WEIGHTS}
    return _int(S.js_round(_weighted(scores, fixed.WEIGHTS)))


def overall_score(pairs: DataFrame, weights: dict | None = None) -> DataFrame:
    """Left-to-right weighted sum, the out-of-scope factor, half-up rounding, category."""
    weights = weights or fixed.WEIGHTS
    total = _weighted({name: F.col(f"{name}_score") for name in weights}, weights)
    outside = F.col("wants_specific") & ~F.array_contains("preferred_countries", F.col("country"))
    score = _int(S.js_round(F.when(outside, total * F.lit(fixed.OUT_OF_SCOPE_MULTIPLIER)).otherwise(total)))
    return pairs.withColumns({"outside_preferred": outside, "score": score}).withColumn(
        "category",
        F.when((F.col("score") >= fixed.STRONG_BOUND) & (F.col("academic_score") >= fixed.STRONG_MIN_ACADEMIC), "strong")
        .when(F.col("score") >= fixed.POSSIBLE_BOUND, "possible")
        .otherwise("ambitious"),
    )


FITS = [academic_fit, financial_fit, major_fit, geographic_fit, scholarship_fit, test_fit, preference_fit]
SCORES = [f"{n}_score" for n in ("academic", "financial", "major", "geography", "scholarship", "tests", "preference")]
SCORED = ["profile_id", "option_id", "name", "country", *SCORES, "verdict", "funding_gap", "outside_preferred", "score", "category"]


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Numeric result per pair; sentences are only built for rows that are kept."""
    for fit in FITS:
        pairs = fit(pairs)
    return overall_score(pairs).select(*SCORED)
