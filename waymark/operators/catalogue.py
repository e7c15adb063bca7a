"""What a profile finds in the whole catalogue, as aggregates that need few pairs or none.

A fit reads few columns of either side. Options are grouped by the columns that
the fit reads, profiles likewise, and the fit is evaluated once per pair of such
signatures, with counts; every profile then takes the result of its signature.
How many options a profile could pay for is counted in ranges of prices, without
any pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.operators import explain as E, fits, pairs as P, search, shortlist as L

#: What each fit reads of a profile and of an option.
READS = {
    "academic": (["gpa_norm", "class_rank"], ["academic_bar"]),
    "financial": (["budget_annual_usd", "ceiling"], ["total_annual_cost", "best_case_net_cost", "aid_dependable", "aid_certainty"]),
    "scholarship": (["aid_need"], ["full_ride_possible", "full_tuition_possible", "scholarship_availability"]),
    "major": (["major_index"], ["major_ratings"]),
    "geography": (
        ["wants_specific", "preferred_countries", "preferred_regions", "city_size_preference", "environment_preference", "english_taught_only"],
        ["country", "region", "city_size", "environment", "teaches_english"],
    ),
    "tests": (["ielts_band", "sat_score"], ["ielts_need", "sat_target", "sat_policy"]),
    "preference": (["preferences", "size_preference"], ["research_intensity", "prestige_tier", "size"]),
}
FITS = {
    "academic": fits.academic_fit, "financial": fits.financial_fit, "scholarship": fits.scholarship_fit, "major": fits.major_fit,
    "geography": fits.geographic_fit, "tests": fits.test_fit, "preference": fits.preference_fit,
}


def _signatures(df: DataFrame, reads: list[str], key: str) -> DataFrame:
    """Distinct values of the columns that are read, how many rows have them, and a number to spread them by."""
    return df.groupBy(*reads).agg(F.count(F.lit(1)).alias(f"_{key}s")).withColumn(f"{key}_id", F.xxhash64(*reads))


def by_signature(profiles: DataFrame, options: DataFrame, reads: tuple[list[str], list[str]], evaluate: Callable[[DataFrame], DataFrame], by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per profile and ``by``: options, and ``sums`` over them. ``evaluate`` adds columns to pairs of signatures.

    Pairs are summed where they arise; what moves is a row per signature and
    ``by``. Every profile meets every option, so a profile's counts add up to
    the catalogue.
    """
    left, right = reads
    pairs = P.pair_grid(_signatures(profiles, left, "profile").drop("_profiles"), _signatures(options, right, "option"))
    own = F.struct(*left).alias("_signature")
    found = evaluate(pairs).select(own, *by, "_options", *[c.alias(f"_{name}") for name, c in sums.items()])
    totals = [F.sum("_options").alias("options"), *[F.sum(F.col(f"_{name}") * F.col("_options")).cast("bigint").alias(name) for name in sums]]
    return profiles.select("profile_id", own).join(found.groupBy("_signature", *by).agg(*totals), "_signature").select("profile_id", *by, "options", *sums)


def fit_summary(profiles: DataFrame, options: DataFrame, name: str) -> DataFrame:
    """Per profile and label of one fit: how many options of the catalogue have it, and the sum of their scores."""
    if name == "preference":
        profiles = profiles.withColumn("preferences", F.struct("preferences.research", "preferences.prestige"))
    by, sums = [f"{name}_label"], {"score_sum": F.col(f"{name}_score")}
    if name == "financial":
        by, sums = ["verdict", *by], {**sums, "gap_sum": F.col("funding_gap")}
    return by_signature(profiles, options, READS[name], FITS[name], by, sums)


def _per_profile(profiles: DataFrame, options: DataFrame, by: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """As ``by_signature`` for what reads all fits: profiles stand for themselves, options that score alike count together."""
    reads = [c for c in P.OPTION_SCORING if c not in ("option_id", "name")]
    pairs = P.pair_grid(profiles.select(*P.PROFILE_SCORING), _signatures(options, reads, "option"))
    for fit in fits.FITS:
        pairs = fit(pairs)
    found = fits.overall_score(pairs).select("profile_id", "_options", *[c.alias(n) for n, c in by.items()], *[c.alias(f"_{n}") for n, c in sums.items()])
    totals = [F.sum(F.col(f"_{n}") * F.col("_options")).cast("bigint").alias(n) for n in sums]
    return found.groupBy("profile_id", *by).agg(F.sum("_options").alias("options"), *totals)


def advantage_summary(profiles: DataFrame, options: DataFrame) -> DataFrame:
    """Per profile, how many options of the whole catalogue have which main advantage and main concern."""
    if L.searchable(options):
        found = search.best_and_worst(profiles, options, [d for d, _ in fixed.ADVANTAGE_LABELS], [d for d, _ in fixed.CONCERN_LABELS], L.search_parts(profiles))
        named = found.select("profile_id", E.main_advantage().alias("advantage"), E.main_concern().alias("concern"), "_options")
        return named.groupBy("profile_id", "advantage", "concern").agg(F.sum("_options").alias("options"))
    return _per_profile(profiles, options, {"advantage": E.main_advantage(), "concern": E.main_concern()}, {})


def major_summary(profiles: DataFrame, options: DataFrame) -> DataFrame:
    """Per profile, match kind and closest supported major: options of the whole catalogue."""
    rating = F.element_at("major_ratings", F.col("major_index"))
    kinds = lambda pairs: pairs.withColumns({
        "match_kind": F.when(rating == 100, "exact").when(rating == 62, "adjacent").otherwise("none"),
        "closest": F.when(rating != 100, P.closest_major(F.col("supported_majors"), F.col("intended_major"))),
    })
    return by_signature(profiles, options, (["intended_major", "major_index"], ["supported_majors", "major_ratings"]), kinds, ["intended_major", "match_kind", "closest"], {})


def viable_counts(profiles: DataFrame, options: DataFrame) -> DataFrame:
    """Per profile and country in its scope: options that aren't above its budget, those of unknown cost included.

    Prices are counted per country in the ranges of every power of two; each
    distinct (country, ceiling) that is asked for meets the few ranges that
    make it up. Countries without such an option are left out.
    """
    unpriced = options.where(F.col("total_annual_cost").isNull()).groupBy("country").agg(F.count(F.lit(1)).alias("unpriced"))
    prices = options.where(F.col("total_annual_cost").isNotNull()).groupBy("country", F.col("best_case_net_cost").cast("bigint").alias("cost")).agg(F.count(F.lit(1)).alias("n"))
    countries = options.agg(F.collect_set("country")).scalar()
    own = F.when(F.col("wants_specific"), F.array_distinct("preferred_countries")).otherwise(F.col("_all"))
    wishes = profiles.select("profile_id", "ceiling", "wants_specific", "preferred_countries").withColumn("_all", countries).select("profile_id", "ceiling", F.explode(own).alias("country"))
    within = L.counts_up_to(prices, wishes.select("country", "ceiling").distinct(), ["country"], ["n"])
    joined = wishes.join(within, ["country", "ceiling"], "left").join(F.broadcast(unpriced), "country", "left")
    none = F.lit(0).cast("bigint")
    viable = F.coalesce("n", none) + F.coalesce("unpriced", none)
    return joined.select("profile_id", "country", viable.alias("viable")).where("viable > 0")
