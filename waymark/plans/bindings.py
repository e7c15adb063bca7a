"""Views that bind the operators' inputs to the given tables.

Every row of the underlying table is used; values come from integer arithmetic
on its columns so that a SQL engine can state the same view independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark import fixed
from waymark.functions import scalar as S
from waymark.operators import pairs as P

AS_OF = "2026-09-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def country_dim(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
    )


def _names(spark, sf):
    return table(spark, sf, "nation").agg(
        F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m")
    ).scalar()


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "k"}).withColumn("names", _names(spark, sf))
    staged = c.selectExpr(
        "k", "c_name", "c_mktsegment", "names[c_nationkey] AS n1", "names[(c_nationkey + 7) % 25] AS n2", "names[(c_nationkey + 13) % 25] AS n3",
        "cast(floor(greatest(c_acctbal, 0D) * 4D) AS bigint) AS budget",
        f"{S.sql_pick(fixed.GPA_SCALES, 'k % 5')} AS gpa_scale", f"{S.sql_pick(fixed.ENGLISH_TESTS, 'k % 4')} AS english_test",
    )
    return staged.selectExpr(
        "k AS profile_id", "c_name AS profile_name", "n1 AS current_country", f"{S.sql_pick(fixed.MAJORS, 'k % 17')} AS intended_major",
        "budget AS budget_annual_usd", "(budget * element_at(array(4, 5, 8), cast(k % 3 + 1 AS int))) div 4 AS max_affordable_annual_usd",
        "gpa_scale",
        """CASE WHEN k % 29 = 0 THEN NULL WHEN gpa_scale = '4.0' THEN 2D + cast(k % 21 AS double) / 10D WHEN gpa_scale = '5.0' THEN 3D + cast(k % 21 AS double) / 10D
             WHEN gpa_scale = 'IB45' THEN cast(20 + k % 26 AS double) ELSE cast(60 + k % 41 AS double) END AS gpa_value""",
        f"{S.sql_pick(fixed.CLASS_RANKS, 'k % 6')} AS class_rank", "english_test",
        """CASE WHEN k % 31 = 0 OR english_test = 'none' THEN NULL WHEN english_test = 'IELTS' THEN 5D + cast(k % 9 AS double) / 2D
             WHEN english_test = 'TOEFL' THEN cast(40 + k % 81 AS double) ELSE cast(80 + k % 71 AS double) END AS english_score""",
        "k % 2 = 0 AS english_planned", "CASE WHEN k % 3 <> 0 THEN cast(900 + (k * 37) % 701 AS int) END AS sat_score",
        "CASE WHEN k % 4 = 0 THEN cast(array() AS array<string>) ELSE slice(array(n1, n2, n3), 1, cast(1 + k % 3 AS int)) END AS preferred_countries",
        "k % 4 = 0 AS open_to_any_country",
        f"{S.sql_pick([*fixed.CITY_SIZES, fixed.NO_PREFERENCE], 'k % 5')} AS city_size_preference",
        f"{S.sql_pick([*fixed.ENVIRONMENTS, fixed.NO_PREFERENCE], 'k % 4')} AS environment_preference",
        f"{S.sql_pick([*fixed.SIZES, fixed.NO_PREFERENCE], '(k % 7) % 4')} AS size_preference", "k % 7 < 2 AS english_taught_only",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'full-ride' WHEN 'BUILDING' THEN 'full-tuition' WHEN 'MACHINERY' THEN 'none' ELSE 'partial' END AS aid_need",
        """named_struct('research', cast((k * 13) % 101 AS int), 'prestige', cast((k * 29) % 101 AS int), 'scholarship', cast((k * 7) % 101 AS int),
             'location', cast((k * 11) % 101 AS int), 'campus_life', cast((k * 17) % 101 AS int)) AS preferences""",
    )


def options(spark: SparkSession, sf: str) -> DataFrame:
    dim = country_dim(spark, sf)
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "k")
    majors = ", ".join(S.sql_pick(fixed.MAJORS, f"(k + {4 * i}) % 17") for i in range(5))
    return s.join(F.broadcast(dim), s.s_nationkey == dim.nation_key).selectExpr(
        "k AS option_id", "s_name AS name", "concat('S', k) AS short_name", "country", "region", "concat('City ', k % 50) AS city",
        f"{S.sql_pick(fixed.CITY_SIZES, 'k % 4')} AS city_size", f"{S.sql_pick(fixed.ENVIRONMENTS, 'k % 3')} AS environment",
        f"{S.sql_pick(fixed.CLIMATES, 'k % 4')} AS climate", f"{S.sql_pick(fixed.SIZES, '(k div 2) % 3')} AS size",
        "CASE k % 3 WHEN 0 THEN array('English') WHEN 1 THEN array('German', 'English') ELSE array('German') END AS languages_of_instruction",
        "CASE WHEN k % 11 = 0 THEN cast(array() AS array<string>) ELSE array(concat('Programme ', k % 17), concat('Programme ', (k + 3) % 17)) END AS programs",
        f"slice(array({majors}), 1, cast(3 + k % 3 AS int)) AS supported_majors",
        "cast(1 + k % 5 AS int) AS research_intensity", "cast(1 + (k div 5) % 5 AS int) AS prestige_tier",
        "CASE WHEN k % 23 <> 0 THEN (k * 7919) % 60000 END AS tuition", "CASE WHEN k % 19 <> 0 THEN (k * 104729) % 25000 END AS living_cost",
        f"{S.sql_pick(fixed.CONFIDENCES, 'k % 3')} AS tuition_confidence", f"{S.sql_pick(fixed.CONFIDENCES, '(k div 3) % 3')} AS living_confidence",
        f"{S.sql_pick(fixed.AVAILABILITIES, 'k % 5')} AS scholarship_availability", f"{S.sql_pick(fixed.AID_CERTAINTIES, '(k div 2) % 4')} AS aid_certainty",
        "CASE k % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS full_ride_possible",
        "CASE k % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS full_tuition_possible",
        "CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS need_based_aid", "concat('Aid note ', k, '. Details follow.') AS aid_note",
        "CASE WHEN k % 6 <> 0 THEN 5.5D + cast(k % 5 AS double) / 2D END AS minimum_ielts",
        "CASE WHEN k % 9 <> 0 THEN 6D + cast(k % 5 AS double) / 2D END AS recommended_ielts", f"{S.sql_pick(fixed.SAT_POLICIES, 'k % 5')} AS sat_policy",
        "CASE WHEN k % 4 <> 0 THEN cast(1000 + (k % 5) * 50 AS int) END AS minimum_sat",
        "CASE WHEN k % 3 <> 0 THEN cast(1200 + (k % 9) * 40 AS int) END AS recommended_sat", "cast(70 + k % 26 AS int) AS gpa_expectation",
        f"{S.sql_pick(fixed.SELECTIVITIES, '(k div 3) % 4')} AS admission_selectivity", "concat('Selectivity note ', k) AS selectivity_note",
        "CASE WHEN k % 13 <> 0 THEN date_add(DATE'2026-09-01', cast((k * 17) % 200 AS int)) END AS application_deadline",
        "CASE WHEN k % 10 <> 0 THEN date_add(DATE'2026-08-15', cast((k * 11) % 150 AS int)) END AS scholarship_deadline",
        f"{S.sql_pick(['Common App', 'Direct', 'UCAS'], 'k % 3')} AS application_platform", "concat('https://www.uni', k, '.edu/') AS official_url",
    )


def ready_profiles(spark, sf) -> DataFrame:
    return P.prepare_profiles(profiles(spark, sf), country_dim(spark, sf))


def ready_options(spark, sf) -> DataFrame:
    return P.prepare_options(options(spark, sf))


TASK_IDS = [
    "shortlist-review", "shortlist-compare", "english-register", "english-prep", "english-send", "sat-register", "sat-prep",
    "doc-statement", "doc-recommendations", "doc-transcript", "doc-financial", "apply-0",
]


def toggles(spark: SparkSession, sf: str) -> DataFrame:
    """Click events as task toggles."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").where(F.col("event_type") == "click").select(
        "event_id", F.col("user_id").alias("profile_id"), S.pick(TASK_IDS, k % 12).alias("task_id"), "ts",
    )


def profile_complete(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") % 5 != 0).alias("profile_complete"))


def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Four requested option ids per customer, some of them unknown."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("set_id"), F.array(k % 97, F.lit(100) + (k * 7) % 50, (k * 13 + 1) % 89, (k * 5 + 2) % 300).alias("ids"),
    )


def changed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The 'after' side of a what-if: a preset by key, and one country only for every third profile."""
    p = profiles(spark, sf)
    preset = F.element_at(F.array(*[
        F.struct(F.lit(v).cast("bigint").alias("v"), F.lit(need).alias("n")) for _, _, v, need, _ in fixed.BUDGET_PRESETS
    ]), (F.col("profile_id") % 5 + 1).cast("int"))
    out = p.withColumn("_p", preset).withColumns({
        "budget_annual_usd": F.col("_p.v"), "max_affordable_annual_usd": F.col("_p.v"), "aid_need": F.col("_p.n"),
        "preferred_countries": F.when(F.col("profile_id") % 3 == 0, F.slice("preferred_countries", 1, 1)).otherwise(F.col("preferred_countries")),
    }).drop("_p")
    return P.prepare_profiles(out, country_dim(spark, sf))
