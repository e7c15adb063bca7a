"""Profile x option pairing without an unbounded broadcast or a theta join.

The catalogue of options is cut into blocks of rows; a profile meets a block
through an equi-join. Where the catalogue's measured size is below the
broadcast bound, the option side is broadcast; beyond it, profiles are salted
and blocks replicated per salt, so no single join key holds every profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.functions import scalar as S
from waymark.session import spread

BLOCK_ROWS = 512
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """Row count and an upper estimate of the bytes a relation occupies, taken anew each time: a table grows.

    Catalyst multiplies the sizes of joined inputs, which overstates a joined
    dimension by orders of magnitude, so the rows are counted and their texts
    and lists measured. Anything else is taken as 16 bytes.
    """
    long = [f for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    plain = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.length(F.to_json(F.struct(f.name))) * 2 for f in long]
    widths = [F.coalesce(F.sum(w), F.lit(0)) for w in plain]
    rows, *sums = df.agg(F.count(F.lit(1)), *widths).first()
    return rows, rows * 16 * (len(df.columns) + 1) + sum(sums)


def checked_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast only behind a size check; otherwise leave the join to Catalyst."""
    return F.broadcast(df) if measured_bytes(df)[1] <= limit_bytes else df


def country_regions(country_dim: DataFrame) -> Column:
    """Country -> region map as a scalar subquery; a country list has a fixed, small domain."""
    return country_dim.agg(F.map_from_entries(F.collect_list(F.struct("country", "region"))).alias("m")).scalar()


def prepare_profiles(profiles: DataFrame, country_dim: DataFrame) -> DataFrame:
    """Everything a fit needs that depends on the profile alone."""
    regions = country_regions(country_dim)
    return (
        profiles.withColumn("region_map", regions)
        .withColumn(
            "preferred_regions",
            F.array_distinct(F.transform("preferred_countries", lambda c: F.coalesce(F.element_at(F.col("region_map"), c), F.lit("Unknown")))),
        )
        .drop("region_map")
        .withColumn("wants_specific", ~F.col("open_to_any_country") & (F.size("preferred_countries") > 0))
        .withColumn("ceiling", F.greatest("max_affordable_annual_usd", "budget_annual_usd"))
        .withColumn("gpa_norm", S.normalize_gpa(F.col("gpa_value"), F.col("gpa_scale")))
        .withColumn("ielts_band", S.english_band(F.col("english_test"), F.col("english_score")))
        .withColumn("major_index", F.array_position(S.str_array(fixed.MAJORS), F.col("intended_major")).cast("int"))
    )


ADJACENT = {m: sorted({x for c in fixed.MAJOR_CLUSTERS if m in c for x in c} - {m}) for m in fixed.MAJORS}


def major_ratings(supported: str) -> Column:
    """Per option: one 100 / 62 / 18 rating for each major, so a pair only looks one up."""
    return F.expr("array(" + ", ".join(
        f"CASE WHEN array_contains({supported}, '{m}') THEN 100 WHEN arrays_overlap({supported}, {S.sql_array(ADJACENT[m])}) THEN 62 ELSE 18 END"
        for m in fixed.MAJORS
    ) + ")")


def closest_major(supported: Column, target: Column) -> Column:
    """The first adjacent major in the option's own order."""
    table = F.expr("map(" + ", ".join(f"'{m}', {S.sql_array(ADJACENT[m])}" for m in fixed.MAJORS) + ")")
    neighbours = F.element_at(table, target)
    return F.get(F.filter(supported, lambda m: F.array_contains(neighbours, m)), F.lit(0))


def prepare_options(options: DataFrame) -> DataFrame:
    """Everything a fit needs that depends on the option alone."""
    total = F.col("tuition") + F.col("living_cost")
    factor = F.coalesce(F.element_at(S.lit_map(fixed.NET_COST_FACTOR), F.col("scholarship_availability")), F.lit(0.9))
    best = (
        F.when(F.coalesce("full_ride_possible", F.lit(False)), F.lit(0).cast("bigint"))
        .when(F.coalesce("full_tuition_possible", F.lit(False)), F.col("living_cost"))
        .otherwise(S.js_round(total.cast("double") * factor))
    )
    return (
        options.withColumn("total_annual_cost", total)
        .withColumn("best_case_net_cost", F.when(total.isNotNull(), F.least(best, total)))
        .withColumn("aid_dependable", F.col("aid_certainty").isin("meets-full-need", "structural"))
        .withColumn("academic_bar", F.col("gpa_expectation") + F.element_at(S.lit_map(fixed.SELECTIVITY_PRESSURE), F.col("admission_selectivity")))
        .withColumn("ielts_need", F.coalesce("minimum_ielts", "recommended_ielts"))
        .withColumn("sat_target", F.coalesce("recommended_sat", "minimum_sat"))
        .withColumn("teaches_english", F.array_contains("languages_of_instruction", "English"))
        .withColumn("major_ratings", major_ratings("supported_majors"))
    )


PROFILE_SCORING = [
    "profile_id", "intended_major", "major_index", "gpa_norm", "class_rank", "ielts_band", "sat_score",
    "budget_annual_usd", "ceiling", "aid_need", "preferred_countries", "preferred_regions", "wants_specific",
    "city_size_preference", "environment_preference", "size_preference", "english_taught_only", "preferences",
]
OPTION_SCORING = [
    "option_id", "name", "country", "region", "city_size", "environment", "size", "research_intensity", "prestige_tier",
    "total_annual_cost", "best_case_net_cost", "aid_certainty", "aid_dependable", "scholarship_availability",
    "full_ride_possible", "full_tuition_possible", "academic_bar", "ielts_need", "sat_policy", "sat_target",
    "teaches_english", "major_ratings",
]


def pair_grid(profiles: DataFrame, options: DataFrame, block_rows: int = BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """Every profile with every option, as a block equi-join."""
    rows, size = measured_bytes(options)
    blocks, small = max(1, -(-rows // block_rows)), size <= BROADCAST_BYTES
    right = options.withColumn("_block", F.pmod(F.xxhash64("option_id"), F.lit(blocks)).cast("int"))
    left = spread(profiles, "profile_id", parts=parts).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if small:
        return left.join(F.broadcast(right), "_block").drop("_block")
    left = left.withColumn("_salt", F.pmod(F.xxhash64("profile_id"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["_block", "_salt"]).drop("_block", "_salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, limit_bytes: int | None = None) -> DataFrame:
    """An equi-join on a key of few values: broadcast behind a size check, else one copy of the right side per salt of the left."""
    if measured_bytes(right)[1] <= (BROADCAST_BYTES if limit_bytes is None else limit_bytes):
        return left.join(F.broadcast(right), key)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def country_pairs(profiles: DataFrame, options: DataFrame, limit_bytes: int | None = None, parts: int | None = None) -> DataFrame:
    """Only the options in a profile's own countries: an equi-join on country."""
    wanted = spread(profiles, "profile_id", parts=parts).withColumn("country", F.explode("preferred_countries"))
    return salted_join(wanted, options, "country", "profile_id", limit_bytes)
