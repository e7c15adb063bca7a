"""Sentences for kept rows: reasons, concerns and flags per fit, the summary, card labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.fixed import SUMMARY, TEXT
from waymark.functions import scalar as S
from waymark.operators import pairs as P

PROFILE_EXTRA = [
    "profile_id", "intended_major", "gpa_norm", "class_rank", "ielts_band", "english_planned", "sat_score", "budget_annual_usd", "ceiling",
    "aid_need", "preferred_countries", "preferred_regions", "open_to_any_country", "wants_specific", "city_size_preference", "size_preference",
    "english_taught_only", "preferences",
]
OPTION_EXTRA = [
    "option_id", "short_name", "region", "city", "city_size", "size", "programs", "supported_majors", "research_intensity", "prestige_tier",
    "tuition", "living_cost", "tuition_confidence", "living_confidence", "total_annual_cost", "best_case_net_cost", "aid_certainty",
    "aid_dependable", "aid_note", "scholarship_availability", "full_ride_possible", "full_tuition_possible", "need_based_aid",
    "minimum_ielts", "recommended_ielts", "ielts_need", "sat_policy", "sat_target", "recommended_sat", "gpa_expectation", "academic_bar",
    "admission_selectivity", "selectivity_note", "application_deadline", "scholarship_deadline", "application_platform", "teaches_english",
]


def enrich(listed: DataFrame, profiles: DataFrame, options: DataFrame) -> DataFrame:
    """Kept rows with the profile and option columns the sentences need."""
    return listed.join(profiles.select(*PROFILE_EXTRA), "profile_id").join(
        P.checked_broadcast(options.select(*OPTION_EXTRA)), "option_id",
    )


def _t(key: str, **cols) -> Column:
    return S.fill(TEXT[key], **cols)


def academic_text() -> dict:
    missing = F.col("gpa_norm").isNull()
    delta = F.col("gpa_norm") - F.col("academic_bar")
    gpa = S.js_round(F.col("gpa_norm")).cast("string")
    bar = F.col("gpa_expectation").cast("string")
    top = F.col("class_rank").isin("top-1", "top-5")
    high = F.col("admission_selectivity") == "highly-selective"
    rank = F.when(F.col("class_rank") == "top-1", "top 1%").otherwise("top 5%")
    return {
        "reasons": S.texts(
            F.when(~missing & top, _t("class_rank", rank=rank)),
            F.when(~missing & (delta >= 4), _t("gpa_above", gpa=gpa, bar=bar))
            .when(~missing & (delta >= -3), _t("gpa_in_line", gpa=gpa, bar=bar)),
        ),
        "concerns": S.texts(
            F.when(missing, _t("gpa_missing")),
            F.when(~missing & (delta < -3), _t("gpa_below", gpa=gpa, bar=bar)),
            F.when(~missing & high, _t("highly_selective", note=F.col("selectivity_note"))),
        ),
        "flags": S.texts(
            F.when(missing, F.lit("gpa-missing")), F.when(~missing & (delta < -3), F.lit("academic-gap")),
            F.when(~missing & high, F.lit("highly-selective")),
        ),
    }


def financial_text() -> dict:
    v = F.col("verdict")
    total, net = S.format_usd(F.col("total_annual_cost")), S.format_usd(F.col("best_case_net_cost"))
    ceiling, budget = S.format_usd(F.col("ceiling")), S.format_usd(F.col("budget_annual_usd"))
    inside = (v == "strong-financial-fit") & (F.col("total_annual_cost") <= F.col("budget_annual_usd"))
    at_ceiling = (v == "strong-financial-fit") & ~inside
    dependable, contest, above = v == "potentially-affordable-with-aid", v == "aid-dependent", v == "above-budget"
    competitive = F.col("aid_certainty") == "competitive"
    estimated = (F.col("tuition_confidence") == "estimated") | (F.col("living_confidence") == "estimated")
    return {
        "reasons": S.texts(
            F.when(inside, _t("in_budget", total=total, budget=budget))
            .when(at_ceiling, _t("in_ceiling", total=total, ceiling=ceiling))
            .when(dependable & (F.col("aid_certainty") == "meets-full-need"), _t("full_need", total=total, short=F.col("short_name"), net=net))
            .when(dependable, _t("low_by_default", net=net))
            .when(contest, _t("award_reach", total=total, net=net, ceiling=ceiling)),
        ),
        "concerns": S.texts(
            F.when(v == "unknown", _t("cost_unknown"))
            .when(at_ceiling, _t("in_ceiling_concern"))
            .when(dependable, _t("conditional"))
            .when(contest & competitive, _t("contest"))
            .when(contest, _t("long_shot"))
            .when(above, _t("above", net=net, gap=S.format_usd(F.col("funding_gap")))),
        ),
        "flags": S.texts(
            F.when(v == "unknown", F.lit("cost-unknown")).when(inside, F.lit("affordable-without-aid"))
            .when(at_ceiling, F.lit("affordable-at-ceiling")).when(dependable | contest, F.lit("aid-dependent"))
            .when(above, F.lit("above-budget")),
            F.when(dependable, F.lit("aid-dependable")).when(contest, F.lit("aid-competitive")),
            F.when((v != "unknown") & estimated, F.lit("cost-estimated")),
        ),
    }


def scholarship_text() -> dict:
    need = F.col("aid_need")
    ride = F.coalesce("full_ride_possible", F.lit(False))
    tuition = F.coalesce("full_tuition_possible", F.lit(False))
    thick = F.col("scholarship_availability").isin("extensive", "moderate")
    partial = ~need.isin("none", "full-ride", "full-tuition")
    return {
        "reasons": S.texts(
            F.when(need == "none", _t("aid_not_needed"))
            .when((need == "full-ride") & ride, _t("full_ride", note=F.substring_index("aid_note", ".", 1)))
            .when((need == "full-tuition") & (ride | tuition), _t("tuition_yes"))
            .when(partial & thick, _t("partial_yes")),
            F.when((need != "none") & F.coalesce("need_based_aid", F.lit(False)), _t("need_based")),
        ),
        "concerns": S.texts(
            F.when((need == "full-ride") & ~ride & tuition, _t("ride_tuition_only"))
            .when((need == "full-ride") & ~ride, _t("ride_none"))
            .when((need == "full-tuition") & ~ride & ~tuition, _t("tuition_no"))
            .when(partial & ~thick, _t("partial_no")),
        ),
        "flags": S.texts(
            F.when(need == "full-ride", F.when(ride, F.lit("full-ride-available")).when(tuition, F.lit("living-costs-uncovered")).otherwise("no-full-ride"))
            .when(need == "full-tuition", F.when(ride | tuition, F.lit("full-tuition-available")).otherwise("no-full-tuition"))
            .when(partial & ~thick, F.lit("thin-scholarships")),
        ),
    }


def major_text() -> dict:
    label = F.element_at(S.lit_map(fixed.MAJOR_LABELS), F.col("intended_major"))
    named = F.array_join(F.slice("programs", 1, 2), ", ")
    example = F.when(named != "", F.concat(F.lit(" (e.g. "), named, F.lit(")"))).otherwise("")
    closest = F.element_at(S.lit_map(fixed.MAJOR_LABELS), P.closest_major(F.col("supported_majors"), F.col("intended_major")))
    score = F.col("major_score")
    return {
        "reasons": S.texts(F.when(score == 100, _t("major_yes", label=label, example=example))),
        "concerns": S.texts(
            F.when(score == 62, _t("major_adjacent", label=label, closest=closest)).when(score < 62, _t("major_no", label=label)),
        ),
        "flags": F.array(F.when(score == 100, "major-available").when(score == 62, "major-adjacent").otherwise("major-missing")),
    }


def geography_text() -> dict:
    wants, listed = F.col("wants_specific"), F.array_contains("preferred_countries", F.col("country"))
    in_region = F.array_contains("preferred_regions", F.col("region"))
    city = (F.col("city_size_preference") != fixed.NO_PREFERENCE) & (F.col("city_size_preference") == F.col("city_size"))
    language = F.col("english_taught_only") & ~F.col("teaches_english")
    country = F.col("country")
    return {
        "reasons": S.texts(
            F.when(~wants, _t("geo_open")).when(listed, _t("geo_yes", country=country)),
            F.when(city, _t("city_match", city=F.regexp_replace("city_size", "^([^-]*)-", "$1 "))),
        ),
        "concerns": S.texts(
            F.when(wants & ~listed & in_region, _t("geo_region", country=country, region=F.col("region")))
            .when(wants & ~listed, _t("geo_no", country=country)),
            F.when(language, _t("language")),
        ),
        "flags": S.texts(
            F.when(wants & listed, F.lit("preferred-country")).when(wants & in_region, F.lit("preferred-region-only"))
            .when(wants, F.lit("outside-preferred")),
            F.when(language, F.lit("language-mismatch")),
        ),
    }


def english_state() -> Column:
    band, need = F.col("ielts_band"), F.col("ielts_need")
    return (
        F.when(band.isNull(), "english-missing").when(need.isNull(), "english-any").when(band >= need + F.lit(0.5), "english-strong")
        .when(band >= need, "english-met").otherwise("english-below")
    )


def sat_state() -> Column:
    sat, target = F.col("sat_score"), F.col("sat_target")
    return (
        F.when(F.col("sat_policy") == "not-used", "sat-unused").when(sat.isNull(), "sat-missing").when(target.isNull(), "sat-any")
        .when(sat >= target, "sat-strong").otherwise("sat-below")
    )


def tests_text() -> dict:
    e, s, policy = english_state(), sat_state(), F.col("sat_policy")
    need = S.num_text(F.coalesce("ielts_need", F.lit(fixed.DEFAULT_IELTS)))
    band, short = S.num_text(F.col("ielts_band")), F.col("short_name")
    gap = S.js_round((F.col("ielts_need") - F.col("ielts_band")) * F.lit(10.0)).cast("double") / F.lit(10.0)
    suffix = F.when(gap == 0.5, "").otherwise("s")
    sat, target = F.col("sat_score"), F.col("sat_target")
    return {
        "reasons": S.texts(
            F.when(e == "english-any", _t("english_ok", band=band)).when(e == "english-strong", _t("english_strong", band=band, need=need))
            .when(e == "english-met", _t("english_met", band=band, need=need)),
            F.when(s == "sat-unused", _t("sat_not_used")).when(s == "sat-strong", _t("sat_strong", sat=sat, target=target))
            .when((s == "sat-missing") & ~policy.isin("required", "recommended"), _t("sat_optional")),
        ),
        "concerns": S.texts(
            F.when((e == "english-missing") & F.col("english_planned"), _t("english_planned", short=short, need=need))
            .when(e == "english-missing", _t("english_none", short=short, need=need))
            .when(e == "english-below", _t("english_gap", short=short, need=need, band=band, gap=S.num_text(gap), s=suffix)),
            F.when(s == "sat-below", _t("sat_below", sat=sat, target=target, gap=target - sat))
            .when((s == "sat-missing") & (policy == "required"), _t("sat_required", short=short))
            .when((s == "sat-missing") & (policy == "recommended"), _t("sat_recommended")),
        ),
        "flags": S.texts(F.when(e != "english-any", e), F.when(~s.isin("sat-unused", "sat-any"), s)),
    }


def preference_text() -> dict:
    research, prestige = F.col("preferences.research"), F.col("preferences.prestige")
    ri, tier = F.col("research_intensity"), F.col("prestige_tier")
    sized = (F.col("size_preference") != fixed.NO_PREFERENCE) & (F.col("size_preference") != F.col("size"))
    return {
        "reasons": S.texts(
            F.when((research >= 65) & (ri >= 4), _t("research_match")), F.when((research <= 35) & (ri <= 3), _t("practical_match")),
            F.when((prestige >= 70) & (tier >= 4), _t("prestige_match")),
        ),
        "concerns": S.texts(
            F.when((prestige >= 70) & (tier <= 2), _t("prestige_low")),
            F.when(sized, _t("size_mismatch", size=F.col("size"), wanted=F.col("size_preference"))),
        ),
        "flags": S.texts(F.when((research >= 65) & (ri >= 4), F.lit("research-match"))),
    }


REASON_ORDER = ["major", "financial", "scholarship", "geography", "academic", "tests", "preference"]
CONCERN_ORDER = ["financial", "scholarship", "tests", "academic", "major", "geography", "preference"]


def with_text(rows: DataFrame) -> DataFrame:
    """Ordered distinct reasons and concerns, and every fit's flags."""
    texts = {
        "academic": academic_text(), "financial": financial_text(), "major": major_text(), "geography": geography_text(),
        "scholarship": scholarship_text(), "tests": tests_text(), "preference": preference_text(),
    }
    return rows.withColumns({
        "reasons": F.array_distinct(F.concat(*[texts[d]["reasons"] for d in REASON_ORDER])),
        "concerns": F.array_distinct(F.concat(*[texts[d]["concerns"] for d in CONCERN_ORDER])),
        "flags": F.concat(*[texts[d]["flags"] for d in ("academic", "financial", "major", "geography", "scholarship", "tests", "preference")]),
    })


def summary(rows: DataFrame) -> DataFrame:
    """The full explanation sentence; needs ``concerns`` from ``with_text``."""
    major = F.element_at(S.lit_map(fixed.MAJOR_LABELS), F.col("intended_major"))
    total, net = S.format_usd(F.col("total_annual_cost")), S.format_usd(F.col("best_case_net_cost"))
    v, country = F.col("verdict"), F.col("country")

    def t(key, **cols):
        return S.fill(SUMMARY[key], **cols)

    opening = (
        F.when(F.col("major_score") >= 90, t("offers", major=major)).when(F.col("major_score") >= 50, t("adjacent", major=major))
        .otherwise(t("despite", major=major))
    )
    money = (
        F.when(v == "strong-financial-fit", t("inside", total=total))
        .when((v == "potentially-affordable-with-aid") & (F.col("aid_certainty") == "meets-full-need"), t("full_need", total=total, net=net))
        .when(v == "potentially-affordable-with-aid", t("default_low", net=net))
        .when(v == "aid-dependent", t("contest", total=total, net=net))
        .when(v == "above-budget", t("above", net=net))
        .otherwise(t("unknown"))
    )
    listed = F.col("wants_specific") & F.array_contains("preferred_countries", country)
    place = (
        F.when(F.col("outside_preferred"), t("outside", country=country)).when(listed, t("preferred", country=country))
        .when(F.col("open_to_any_country") & (F.col("geography_score") >= 85), t("setting", city=F.col("city")))
    )
    taste = (
        F.when((F.col("preferences.research") >= 65) & (F.col("research_intensity") >= 4), t("research"))
        .when((F.col("preferences.scholarship") >= 70) & (F.col("scholarship_availability") == "extensive"), t("aid"))
    )
    text = F.concat(F.concat_ws(", ", opening, money, place, taste), F.lit("."))
    for phrase in ("it matches", "scholarship"):
        text = F.regexp_replace(text, f"(?s)^(.*?), and {phrase}", f"$1 and {phrase}")
    concern = F.get("concerns", F.lit(0))
    lowered = F.concat(F.lower(F.substring(concern, 1, 1)), F.expr("substring(concerns[0], 2)"))
    caveat = F.when(F.size("concerns") > 0, t("however", concern=lowered)).otherwise("")
    return rows.withColumn("summary", F.concat(text, caveat))


def _labelled(labels) -> Column:
    return F.array(*[
        F.struct(F.col(f"{d}_score").alias("score"), F.lit(i).alias("ordinal"), F.lit(text).alias("label")) for i, (d, text) in enumerate(labels)
    ])


def main_advantage() -> Column:
    return F.array_max(F.transform(_labelled(fixed.ADVANTAGE_LABELS), lambda s: F.struct(s["score"], -s["ordinal"], s["label"].alias("label"))))["label"]


def main_concern() -> Column:
    weakest = F.array_min(_labelled(fixed.CONCERN_LABELS))
    return F.when(weakest["score"] >= fixed.NO_CONCERN_BOUND, F.lit(fixed.NO_CONCERN)).otherwise(weakest["label"])
