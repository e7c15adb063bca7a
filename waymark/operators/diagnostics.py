"""Diagnostics per profile: six dimensions, gaps with severity, ordered insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.fixed import DIAG, GAPS, INSIGHTS
from waymark.functions import scalar as S
from waymark.operators import explain as E, shortlist as L

PROFILE_FACTS = [
    "profile_id", "intended_major", "gpa_norm", "class_rank", "ielts_band", "english_planned", "sat_score", "budget_annual_usd", "ceiling",
    "aid_need", "preferred_countries", "open_to_any_country",
]


def shortlist_facts(rows: DataFrame) -> DataFrame:
    """One aggregate per profile over its (short) enriched shortlist."""
    e, s = E.english_state(), E.sat_state()
    needed = F.col("sat_policy").isin("required", "recommended")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    need = F.coalesce("ielts_need", F.lit(fixed.DEFAULT_IELTS))
    return rows.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("results"),
        F.max("mode").alias("mode"),
        n(e == "english-below").alias("english_below"),
        n(e.isin("english-met", "english-strong")).alias("english_ok"),
        F.max(F.when(e == "english-below", need)).alias("english_target"),
        F.greatest(F.max(need), F.lit(fixed.DEFAULT_IELTS)).alias("english_needed"),
        n(needed).alias("sat_needed"),
        n(F.col("sat_policy") == "required").alias("sat_required"),
        F.sort_array(F.collect_list(F.when(needed, F.struct("rank", "short_name")))).alias("sat_names"),
        n(s == "sat-below").alias("sat_below"),
        F.max(F.when(s == "sat-below", F.coalesce("recommended_sat", F.lit(0)))).alias("sat_goal"),
        n(F.col("verdict").isin(L.AID_VERDICTS)).alias("need_aid"),
        n(F.col("verdict") == "aid-dependent").alias("contested"),
        n(F.col("admission_selectivity") == "highly-selective").alias("selective"),
        F.min("application_deadline").alias("earliest_deadline"),
    ).withColumn("sat_names", F.array_join(F.transform(F.slice("sat_names", 1, 3), lambda x: x["short_name"]), ", "))


def profile_facts(profiles: DataFrame, rows: DataFrame, counts: DataFrame) -> DataFrame:
    return profiles.select(*PROFILE_FACTS).join(counts, "profile_id").join(shortlist_facts(rows), "profile_id")


def _dim(i: int, key: str, label: str, level: Column, value: Column, detail: Column) -> Column:
    return F.struct(F.lit(i).alias("ordinal"), F.lit(key).alias("dimension"), F.lit(label).alias("label"), level.alias("level"),
                    value.cast("int").alias("value"), detail.alias("detail"))


def dimensions(facts: DataFrame) -> DataFrame:
    gpa, band, sat = F.col("gpa_norm"), F.col("ielts_band"), F.col("sat_score")
    ranked = ~F.col("class_rank").isin("unknown", "other")
    rank_text = F.when(ranked, S.fill(DIAG["rank"], rank=F.regexp_replace("class_rank", "^top-", "top "))).otherwise("")
    level = F.lit("needs-improvement")
    for bound, name in reversed(fixed.GPA_LEVELS):
        level = F.when(gpa >= bound, F.lit(name)).otherwise(level)
    academics = _dim(
        0, "academics", "Academics", F.when(gpa.isNull(), "unknown").otherwise(level), F.when(gpa.isNull(), 40).otherwise(S.js_round(gpa)),
        F.when(gpa.isNull(), F.lit(DIAG["gpa_none"])).otherwise(S.fill(DIAG["gpa"], gpa=S.js_round(gpa), rank=rank_text)),
    )
    results, below = F.col("results"), F.col("english_below")
    english = _dim(
        1, "english", "English",
        F.when(band.isNull(), "needs-improvement").when(band >= 6.5, "ready").when(band >= 6.0, "moderate").otherwise("needs-improvement"),
        F.when(band.isNull(), 25).otherwise(S.js_round(band / F.lit(9.0) * F.lit(100.0))),
        F.when(band.isNull() & F.col("english_planned"), F.lit(DIAG["english_planned"])).when(band.isNull(), F.lit(DIAG["english_none"]))
        .when(below == 0, S.fill(DIAG["english_ok"], band=S.num_text(band)))
        .otherwise(S.fill(DIAG["english_short"], band=S.num_text(band), n=below, total=results)),
    )
    needed, low = F.col("sat_needed"), F.col("sat_below")
    testing = _dim(
        2, "testing", "Standardized Testing",
        F.when(sat.isNull(), F.when(needed > 0, "needs-improvement").otherwise("moderate")).when(low == 0, "strong").when(low <= 2, "competitive").otherwise("needs-improvement"),
        F.when(sat.isNull(), F.lit(30).cast("bigint")).otherwise(F.least(F.lit(100).cast("bigint"), S.js_round((sat - 800).cast("double") / F.lit(800.0) * F.lit(100.0)))),
        F.when(sat.isNull() & (needed > 0), S.fill(DIAG["sat_needed"], n=needed)).when(sat.isNull(), F.lit(DIAG["sat_free"]))
        .when(low == 0, S.fill(DIAG["sat_ok"], sat=sat)).otherwise(S.fill(DIAG["sat_short"], sat=sat, n=low)),
    )
    ceiling = F.col("ceiling")
    financial = _dim(
        3, "financial", "Financial Flexibility", F.when(ceiling >= 45000, "strong").when(ceiling >= 22000, "moderate").otherwise("limited"),
        F.least(F.lit(100).cast("bigint"), S.js_round(ceiling.cast("double") / F.lit(60000.0) * F.lit(100.0))),
        S.fill(DIAG["finance"], budget=S.format_usd(F.col("budget_annual_usd")), ceiling=S.format_usd(ceiling), n=F.col("affordable_count"), total=F.col("option_count")),
    )
    need = F.col("aid_need")
    scholarship = _dim(
        4, "scholarship", "Scholarship Dependence", F.element_at(S.lit_map(fixed.AID_NEED_LEVEL), need),
        F.element_at(S.lit_map(fixed.AID_NEED_VALUE), need), F.element_at(S.lit_map(fixed.AID_NEED_DETAIL), need),
    )
    ratio = F.col("selective").cast("double") / F.nullif(results, F.lit(0)).cast("double")
    selectivity = _dim(
        5, "selectivity", "Target Selectivity", F.when(ratio >= 0.6, "very-high").when(ratio >= 0.3, "competitive").otherwise("moderate"),
        F.coalesce(S.js_round(ratio * F.lit(100.0)), F.lit(0).cast("bigint")), S.fill(DIAG["selectivity"], n=F.col("selective"), total=results),
    )
    return facts.select("profile_id", F.inline(F.array(academics, english, testing, financial, scholarship, selectivity)))


def gap_items() -> Column:
    """The gap structs of one profile row, nulls removed, in emission order."""
    gpa, band, sat = F.col("gpa_norm"), F.col("ielts_band"), F.col("sat_score")
    below, needed, low = F.col("english_below"), F.col("sat_needed"), F.col("sat_below")

    def gap(i, cond, key, severity, **cols):
        title, detail = GAPS[key]
        return F.when(cond, F.struct(
            F.lit(i).alias("ordinal"), F.lit(key).alias("gap"), S.fill(title, **cols).alias("title"), S.fill(detail, **cols).alias("detail"),
            (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        ))

    return S.texts(
        gap(0, gpa.isNull(), "gpa-missing", "medium"),
        gap(1, band.isNull(), "english-missing", "high"),
        gap(2, band.isNotNull() & (below > 0), "english-below", "high", n=below, noun=S.plural(below, "university", "universities"),
            band=S.num_text(band), need=S.num_text(F.col("english_target"))),
        gap(3, sat.isNull() & (needed > 0), "sat-missing", F.when(F.col("sat_required") > 0, "high").otherwise("medium"), names=F.col("sat_names")),
        gap(4, sat.isNotNull() & (low >= 2), "sat-below", "medium", sat=sat, target=F.col("sat_goal"), n=low),
        gap(5, F.col("aid_need").isin("full-ride", "full-tuition"), "scholarship-dependence", "high", n=F.col("need_aid"), m=F.col("contested")),
        gap(6, ~F.col("open_to_any_country") & (F.size("preferred_countries") == 1), "narrow-geography", "low"),
    )


def gaps(facts: DataFrame) -> DataFrame:
    return facts.select("profile_id", F.inline(gap_items()))


def insights(facts: DataFrame) -> DataFrame:
    gpa, band, sat = F.col("gpa_norm"), F.col("ielts_band"), F.col("sat_score")
    items = S.texts(
        F.when((gpa >= 88) & (F.col("ceiling") < 15000), F.lit(INSIGHTS["strong_poor"])),
        F.when(band >= 6.5, S.fill(INSIGHTS["english"], n=F.col("english_ok"), total=F.col("results"))),
        F.when(sat.isNull() & (F.col("sat_needed") >= 2), S.fill(INSIGHTS["sat_missing"], n=F.col("sat_needed"))),
        F.when(sat < 1450, S.fill(INSIGHTS["sat_low"], target=F.greatest(F.lit(1450), sat + 60))),
        F.when(F.col("above_budget_count") * 2 > F.col("option_count"),
               S.fill(INSIGHTS["out_of_reach"], n=F.col("above_budget_count"), total=F.col("option_count"))),
        F.when(~F.col("open_to_any_country") & (F.size("preferred_countries") == 1), S.fill(INSIGHTS["single"], country=F.get("preferred_countries", F.lit(0)))),
        L.notice(F.col("mode"), F.col("preferred_countries"), F.col("open_to_any_country")),
    )
    return facts.select("profile_id", F.posexplode(F.slice(items, 1, 5)).alias("ordinal", "insight"))
