"""Untrusted stored JSON to valid rows: profiles, task maps, id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.functions import scalar as S

# fixed values: the defaults of an empty profile, and accepted ranges
DEFAULTS = {
    "current_country": "Kazakhstan", "grade_year": "Grade 11", "graduation_year": 2027.0, "curriculum": "National", "gpa_scale": "100",
    "class_rank": "unknown", "english_test": "none", "intended_major": "computer-science", "city_size": "no-preference",
    "environment": "no-preference", "size": "no-preference", "english_taught_only": True, "budget": 10000.0, "ceiling": 15000.0,
    "aid_need": "partial", "research": 50.0, "prestige": 50.0, "scholarship": 60.0, "location": 50.0, "campus_life": 50.0,
}
MAX_MONEY = 10_000_000.0
_STR, _NUM, _BOOL = "string", "double", "boolean"
PROFILE_SCHEMA = (
    "name string, currentCountry string, gradeYear string, graduationYear double, curriculum string, gpaValue double, gpaScale string, "
    "classRank string, englishTest string, englishScore double, englishPlanned boolean, satTaken boolean, satScore double, actTaken boolean, "
    "actScore double, strongestSubjects array<string>, academicInterests array<string>, intendedMajor string, preferredCountries array<string>, "
    "citySizePreference string, environmentPreference string, sizePreference string, englishTaughtOnly boolean, budgetAnnualUSD double, "
    "maxAffordableAnnualUSD double, aidNeed string, preferences struct<research:double,prestige:double,scholarship:double,location:double,campusLife:double>, "
    "completedAt string"
)


def _num(c: Column, fallback: float, low: float, high: float) -> Column:
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, S.clamp(c, low, high)).otherwise(F.lit(fallback))


def _maybe(c: Column, low: float, high: float) -> Column:
    return F.when(~F.isnan(c) & c.between(low, high), c)


def _one_of(c: Column, allowed, fallback: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(fallback))


def sanitize_profiles(raw: DataFrame, countries: Column | None = None) -> DataFrame:
    """Field-by-field coercion of ``raw(profile_id, json)``; never fails, always scorable."""
    allowed = countries if countries is not None else S.str_array(fixed.COUNTRIES)
    record = F.when(F.trim("json").startswith("{"), F.from_json("json", PROFILE_SCHEMA, {"mode": "PERMISSIVE"}))
    r = raw.withColumn("r", record).withColumn("_allowed", allowed)
    c, d = (lambda n: F.col(f"r.{n}")), DEFAULTS
    wish = F.coalesce(F.array_distinct(F.filter(c("preferredCountries"), lambda x: F.array_contains(F.col("_allowed"), x))), S.str_array([]))
    budget = _num(c("budgetAnnualUSD"), d["budget"], 0.0, MAX_MONEY)
    prefs = {"research": "research", "prestige": "prestige", "scholarship": "scholarship", "location": "location", "campus_life": "campusLife"}
    none = fixed.NO_PREFERENCE
    out = r.withColumns({"budget_annual_usd": budget, "preferred_countries": wish})
    return out.select(
        "profile_id",
        F.substring(F.coalesce(c("name"), F.lit("")), 1, 60).alias("name"),
        F.substring(F.coalesce(c("currentCountry"), F.lit(d["current_country"])), 1, 60).alias("current_country"),
        F.substring(F.coalesce(c("gradeYear"), F.lit(d["grade_year"])), 1, 40).alias("grade_year"),
        _num(c("graduationYear"), d["graduation_year"], 2000.0, 2100.0).alias("graduation_year"),
        _one_of(c("curriculum"), fixed.CURRICULA, d["curriculum"]).alias("curriculum"),
        _maybe(c("gpaValue"), 0, 100).alias("gpa_value"),
        _one_of(c("gpaScale"), fixed.GPA_SCALES, d["gpa_scale"]).alias("gpa_scale"),
        _one_of(c("classRank"), fixed.CLASS_RANKS, d["class_rank"]).alias("class_rank"),
        _one_of(c("englishTest"), fixed.ENGLISH_TESTS, d["english_test"]).alias("english_test"),
        _maybe(c("englishScore"), 0, 200).alias("english_score"),
        F.coalesce(c("englishPlanned"), F.lit(False)).alias("english_planned"),
        F.coalesce(c("satTaken"), F.lit(False)).alias("sat_taken"),
        _maybe(c("satScore"), 400, 1600).alias("sat_score"),
        F.coalesce(c("actTaken"), F.lit(False)).alias("act_taken"),
        _maybe(c("actScore"), 1, 36).alias("act_score"),
        F.coalesce(F.slice(F.filter(c("strongestSubjects"), lambda x: x.isNotNull()), 1, 10), S.str_array([])).alias("strongest_subjects"),
        F.coalesce(F.slice(F.filter(c("academicInterests"), lambda x: x.isNotNull()), 1, 10), S.str_array([])).alias("academic_interests"),
        _one_of(c("intendedMajor"), fixed.MAJORS, d["intended_major"]).alias("intended_major"),
        "preferred_countries", (F.size("preferred_countries") == 0).alias("open_to_any_country"),
        _one_of(c("citySizePreference"), [*fixed.CITY_SIZES, none], none).alias("city_size_preference"),
        _one_of(c("environmentPreference"), [*fixed.ENVIRONMENTS, none], none).alias("environment_preference"),
        _one_of(c("sizePreference"), [*fixed.SIZES, none], none).alias("size_preference"),
        F.coalesce(c("englishTaughtOnly"), F.lit(d["english_taught_only"])).alias("english_taught_only"),
        "budget_annual_usd",
        F.greatest("budget_annual_usd", _num(c("maxAffordableAnnualUSD"), d["ceiling"], 0.0, MAX_MONEY)).alias("max_affordable_annual_usd"),
        _one_of(c("aidNeed"), fixed.AID_NEEDS, d["aid_need"]).alias("aid_need"),
        F.struct(*[_num(c(f"preferences.{src}"), d[name], 0.0, 100.0).alias(name) for name, src in prefs.items()]).alias("preferences"),
        c("completedAt").alias("completed_at"),
    )


def sanitize_task_map(json: Column) -> Column:
    """Only keys of 1..199 characters whose value is JSON true."""
    parsed = F.when(F.trim(json).startswith("{"), F.from_json(json, "map<string,string>"))
    kept = F.map_filter(parsed, lambda k, v: F.length(k).between(1, 199) & F.coalesce(v == "true", F.lit(False)))
    return F.coalesce(F.array_sort(F.map_keys(kept)), S.str_array([]))


def sanitize_id_list(json: Column, limit: int) -> Column:
    """Url-safe ids, distinct, first ``limit``."""
    items = F.when(F.trim(json).startswith("["), F.from_json(json, "array<string>"))
    safe = F.filter(items, lambda x: F.coalesce(x.rlike("^[a-z0-9-]{1,60}$"), F.lit(False)))
    return F.coalesce(F.slice(F.array_distinct(safe), 1, limit), S.str_array([]))
