"""The search of a large catalogue gives the lists that scoring every pair gives."""

import pytest
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators import fits, pairs as P, search, shortlist as L
from waymark.plans import bindings as B

SHOWN = ["profile_id", "option_id", "rank", "score", *fits.SCORES, "verdict", "funding_gap", "outside_preferred", "category"]


def _gaps(df, columns, key, every):
    """Each column is missing in other rows."""
    x = F.xxhash64(*key)
    return df.withColumns({c: F.when(F.pmod(x, F.lit(every)) != n, F.col(c)) for n, c in enumerate(columns)})


@pytest.fixture(scope="module")
def catalogue(spark, sf):
    """Options with ties, missing values and repeated rows, and profiles with those, too, with odd ceilings and odd wishes."""
    options = B.ready_options(spark, sf).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("option_id", F.col("option_id") + F.col("_c") * 1009).drop("_c")
    # new costs and bars, so that copies differ
    x = F.xxhash64("option_id")
    options = options.withColumns({"total_annual_cost": F.pmod(x, F.lit(70000)), "academic_bar": F.col("academic_bar") + F.pmod(x, F.lit(9)).cast("int")})
    options = options.withColumn("best_case_net_cost", F.floor(F.col("total_annual_cost") * F.pmod(F.xxhash64("option_id", "name"), F.lit(11)) / 10).cast("bigint"))
    options = _gaps(options, ["name", "region", "city_size", "environment", "size", "research_intensity", "prestige_tier", "total_annual_cost", "aid_certainty", "aid_dependable", "scholarship_availability", "full_ride_possible",
                              "full_tuition_possible", "academic_bar", "ielts_need", "sat_policy", "sat_target", "teaches_english", "major_ratings"], ["option_id"], 67)
    options = options.withColumn("best_case_net_cost", F.when(F.col("total_annual_cost").isNotNull(), F.col("best_case_net_cost")))
    options = options.unionByName(options.where("option_id % 6 = 0"))

    p = B.ready_profiles(spark, sf)
    p = p.unionByName(p.where("profile_id % 5 = 0")).unionByName(p.where("profile_id % 7 = 0").withColumn("profile_id", F.lit(None).cast("bigint")))
    key = ["profile_id", "budget_annual_usd"]
    p = _gaps(p, ["class_rank", "ielts_band", "sat_score", "gpa_norm", "aid_need", "city_size_preference", "environment_preference", "size_preference", "english_taught_only", "preferences", "budget_annual_usd", "ceiling",
                  "preferred_regions", "major_index"], key, 41)
    x = F.xxhash64(*key, F.lit(1))
    name = options.agg(F.min("country")).first()[0]
    odd = F.when(F.pmod(x, F.lit(17)) == 0, F.array(F.lit(None).cast("string"), F.lit(name))).when(F.pmod(x, F.lit(17)) == 1, F.array(F.lit(name), F.lit(name))).when(F.pmod(x, F.lit(17)) == 2, F.array(F.lit("Nowhere")))
    p = p.withColumns({
        "ceiling": F.when(F.pmod(x, F.lit(9)) == 1, F.lit(0)).when(F.pmod(x, F.lit(9)) == 2, F.lit(-5)).otherwise(F.col("ceiling")).cast("bigint"),
        "preferred_countries": odd.when(F.pmod(x, F.lit(17)) == 3, F.lit(None).cast("array<string>")).otherwise(F.col("preferred_countries")),
    }).withColumn("wants_specific", F.when(F.pmod(x, F.lit(23)) != 0, ~F.col("open_to_any_country") & (F.size("preferred_countries") > 0)))
    options, p = options.cache(), p.cache()
    yield p, options
    options.unpersist(), p.unpersist()


def _rows(df, columns):
    # among equal names without a score nothing tells options apart
    return sorted(map(str, map(tuple, df.where("score IS NOT NULL").select(*columns).collect())))


@pytest.mark.parametrize(("first", "small"), [(64, 8192), (4, 16)])
def test_searched_lists_equal_lists_of_all_pairs(catalogue, monkeypatch, first, small):
    profiles, options = catalogue
    monkeypatch.setattr(L, "_seeds", lambda rows: [])
    want = L.shortlist(profiles, options)
    best = L.rank_options(L.scored_candidates(profiles, options, 2**31 - 1)).where(F.col("rank") <= fixed.RESULT_COUNT)
    wanted, wanted_best = _rows(want, [*SHOWN, "mode"]), _rows(best, SHOWN)
    monkeypatch.setattr(L, "_seeds", lambda rows: [8])
    monkeypatch.setattr(search, "FIRST", first)
    monkeypatch.setattr(search, "SMALL", small)
    assert len(wanted) > 500 and _rows(L.shortlist(profiles, options), [*SHOWN, "mode"]) == wanted
    found = L.scored_candidates(profiles, options, 2**31 - 1, best=fixed.RESULT_COUNT)
    assert found.count() < L.scored_candidates(profiles, options, 2**31 - 1).count() / 20
    assert _rows(L.rank_options(found).where(F.col("rank") <= fixed.RESULT_COUNT), SHOWN) == wanted_best


def test_scenarios_of_a_profile_are_searched_apart(spark, sf, monkeypatch):
    from waymark.operators import whatif
    profiles = P.prepare_profiles(whatif.budget_scenarios(B.profiles(spark, sf)), B.country_dim(spark, sf))
    options = B.ready_options(spark, sf)
    columns = ["scenario_id", *SHOWN, "mode"]
    monkeypatch.setattr(L, "_seeds", lambda rows: [])
    want = _rows(L.shortlist(profiles, options), columns)
    monkeypatch.setattr(L, "_seeds", lambda rows: [8])
    assert _rows(L.shortlist(profiles, options), columns) == want


def test_a_large_catalogue_makes_few_rows_a_profile(spark, sf):
    """No pair but those that can be listed leaves the search, and an empty side gives no rows."""
    options = B.ready_options(spark, sf).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(499)))).withColumn("option_id", F.col("option_id") + F.col("_c") * 1009).drop("_c")
    profiles = B.ready_profiles(spark, sf)
    assert L._seeds(options.count())
    plan = L.shortlist(profiles, options)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "_block" not in plan
    own = profiles.select(*P.PROFILE_SCORING, (F.size("preferred_countries") > 0).alias("_focused"))
    found = search.best_pairs(own, options, 8)
    assert found.groupBy("profile_id").count().agg(F.max("count")).first()[0] <= 3 * 8
    assert search.best_pairs(own, options.limit(0), 8).count() == 0 and search.best_pairs(own.limit(0), options, 8).count() == 0


def test_a_catalogue_that_workers_cannot_hold_is_not_searched(spark, sf, monkeypatch):
    profiles, options = B.ready_profiles(spark, sf).limit(30), B.ready_options(spark, sf)
    want = _rows(L.shortlist(profiles, options), SHOWN)
    monkeypatch.setattr(L, "_seeds", lambda rows: [2])
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    assert not search.fits_memory(options)
    assert _rows(L.shortlist(profiles, options), SHOWN) == want


def test_searched_advantages_equal_those_of_all_pairs(catalogue, monkeypatch):
    """Counts per main advantage and concern, over missing scores, ties and repeated rows."""
    from waymark.operators import catalogue as C
    profiles, options = catalogue
    rows = lambda: sorted(map(str, C.advantage_summary(profiles, options).select("profile_id", "advantage", "concern", "options").collect()))
    monkeypatch.setattr(L, "_seeds", lambda rows: [])
    want = rows()
    monkeypatch.setattr(L, "_seeds", lambda rows: [8])
    assert "MapInArrow" in C.advantage_summary(profiles, options)._jdf.queryExecution().executedPlan().toString()
    assert len(want) > 500 and rows() == want
