"""Properties of the match engine on the given tables and on small hand-made profiles."""

from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import scalar as S
from waymark.operators import catalogue as C, fits, pairs as P, shortlist as L, whatif as W
from waymark.plans import bindings as B


def test_rounding_is_half_up(spark):
    row = spark.sql("select -2.5D a, 2.5D b, 0.49D c").select(*[S.js_round(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == (-2, 3, 0)


def test_scale_handles_reversed_and_equal_anchors(spark):
    row = spark.range(1).select(
        S.scale(F.lit(125.0), 250, 0, 25, 92).alias("a"), S.scale(F.lit(5.0), 3, 3, 0, 70).alias("b"), S.scale(F.lit(999.0), 250, 0, 25, 92).alias("c"),
    ).first()
    assert tuple(row) == (58.5, 70.0, 25.0)


def _scored(spark, sf, profiles):
    ready = P.prepare_profiles(profiles, B.country_dim(spark, sf))
    return fits.score_pairs(P.pair_grid(ready.select(*P.PROFILE_SCORING), B.ready_options(spark, sf).select(*P.OPTION_SCORING)))


def test_raising_the_budget_never_lowers_the_financial_score(spark, sf):
    scenarios = W.budget_scenarios(B.profiles(spark, sf))
    low = _scored(spark, sf, scenarios.where("scenario_id = 0")).select("profile_id", "option_id", F.col("financial_score").alias("lo"))
    high = _scored(spark, sf, scenarios.where("scenario_id = 4")).select("profile_id", "option_id", F.col("financial_score").alias("hi"))
    joined = low.join(high, ["profile_id", "option_id"])
    assert joined.count() > 0 and joined.where("hi < lo").count() == 0


def test_missing_sat_is_unknown_not_zero(spark, sf):
    p = B.profiles(spark, sf)
    missing = _scored(spark, sf, p.withColumn("sat_score", F.lit(None).cast("int")))
    lowest = _scored(spark, sf, p.withColumn("sat_score", F.lit(400)))
    m = missing.agg(F.avg("tests_score")).first()[0]
    assert m > lowest.agg(F.avg("tests_score")).first()[0]


def test_pruned_shortlist_equals_the_rule_over_all_pairs(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    got = {(r.profile_id, r.rank): r.option_id for r in L.shortlist(profiles, options).collect()}
    rows = _scored(spark, sf, B.profiles(spark, sf)).collect()
    by_profile = {}
    for r in rows:
        by_profile.setdefault(r.profile_id, []).append(r)
    want = {}
    for pid, items in by_profile.items():
        items.sort(key=lambda r: (-r.score, r.name, r.option_id))
        inside = [r for r in items if not r.outside_preferred]
        viable = [r for r in inside if r.verdict != "above-budget"]
        if len(viable) >= 3:
            chosen = viable[:8] + [r for r in inside if r not in viable][: max(0, 8 - len(viable))]
        elif len(inside) >= 3:
            chosen = inside[:8]
        else:
            chosen = items[:8]
        want.update({(pid, i + 1): r.option_id for i, r in enumerate(chosen)})
    assert got == want


def test_verdict_counts_match_pairwise_counts(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    got = {r.profile_id: (r.affordable_count, r.aid_dependent_count, r.above_budget_count) for r in L.verdict_counts(profiles, options).collect()}
    pairs = P.pair_grid(profiles.select(*P.PROFILE_SCORING), options.select(*P.OPTION_SCORING)).withColumn("v", fits.verdict())
    n = lambda c: F.count(F.when(c, 1))
    want = pairs.groupBy("profile_id").agg(n(F.col("v") == "strong-financial-fit"), n(F.col("v").isin(L.AID_VERDICTS)), n(F.col("v") == "above-budget"))
    assert got == {r[0]: tuple(r[1:]) for r in want.collect()}


def test_salted_grid_gives_the_same_pairs(spark, sf, monkeypatch):
    profiles, options = B.profiles(spark, sf).select("profile_id"), B.options(spark, sf).select("option_id")
    small = P.pair_grid(profiles, options).count()
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    salted = P.pair_grid(profiles, options, block_rows=3)
    assert salted.count() == small and salted.distinct().count() == small


def test_one_absurd_price_costs_nothing(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    dear = options.withColumns({c: F.when(F.col("option_id") == 1, F.lit(10**12)).otherwise(F.col(c)) for c in ("total_annual_cost", "best_case_net_cost")})
    counted = L.verdict_counts(profiles, dear)
    plan = counted._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("Subquery")[0]
    ceilings, prices = {r.profile_id: r.ceiling for r in profiles.collect()}, [r.total_annual_cost for r in dear.collect() if r.total_annual_cost is not None]
    assert all(r.affordable_count == sum(p <= ceilings[r.profile_id] for p in prices) for r in counted.collect())


def test_salted_country_join_gives_the_same_pairs(spark, sf):
    profiles, options = B.ready_profiles(spark, sf).select("profile_id", "preferred_countries"), B.options(spark, sf).select("option_id", "country")
    small = P.country_pairs(profiles, options)
    salted = P.country_pairs(profiles, options, limit_bytes=0)
    assert sorted(map(str, small.select("profile_id", "option_id").collect())) == sorted(map(str, salted.select("profile_id", "option_id").collect()))
    assert "_salt" in salted._jdf.queryExecution().toString()


def test_shortlist_plan_limits_groups_early_and_stays_out_of_python(spark, sf):
    plan = L.shortlist(B.ready_profiles(spark, sf), B.ready_options(spark, sf))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_weights_sum_to_one():
    assert abs(sum(fixed.WEIGHTS.values()) - 1) < 1e-9


def _all_pairs(spark, sf):
    ready = P.prepare_profiles(B.profiles(spark, sf), B.country_dim(spark, sf))
    pairs = P.pair_grid(ready.select(*P.PROFILE_SCORING), B.ready_options(spark, sf).select(*P.OPTION_SCORING))
    for fit in fits.FITS:
        pairs = fit(pairs)
    return fits.overall_score(pairs)


def test_fits_by_signature_equal_fits_over_all_pairs(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    every = _all_pairs(spark, sf).cache()
    for name in C.READS:
        want = every.groupBy("profile_id", f"{name}_label").agg(F.count(F.lit(1)).alias("options"), F.sum(f"{name}_score").alias("score_sum"))
        got = C.fit_summary(profiles, options, name).groupBy("profile_id", f"{name}_label").agg(F.sum("options").alias("options"), F.sum("score_sum").alias("score_sum"))
        assert got.count() > 0 and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
    every.unpersist()


def test_equal_profiles_and_options_are_evaluated_once(spark, sf):
    """A thousand copies of each profile and option: no more pairs than without, and counts a thousand times as large."""
    profiles, options = B.ready_profiles(spark, sf).limit(20), B.ready_options(spark, sf)
    many = lambda df, key: df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn(key, F.col(key) + F.col("_c") * 1_000_000).drop("_c")
    pairs = P.pair_grid(C._signatures(many(profiles, "profile_id"), *_reads("tests", 0)), C._signatures(many(options, "option_id"), *_reads("tests", 1)))
    assert pairs.count() <= profiles.count() * options.count()
    one, all_ = (C.fit_summary(p, o, "tests") for p, o in ((profiles, options), (many(profiles, "profile_id"), many(options, "option_id"))))
    found = {(r.profile_id % 1_000_000, r.tests_label): (r.options, r.score_sum) for r in all_.collect()}
    assert found == {(r.profile_id, r.tests_label): (1000 * r.options, 1000 * r.score_sum) for r in one.collect()}


def _reads(name, side):
    return C.READS[name][side], ("profile", "option")[side]


def test_viable_counts_need_no_pairs(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    want = _all_pairs(spark, sf).where("NOT outside_preferred AND verdict <> 'above-budget'").groupBy("profile_id", "country").agg(F.count(F.lit(1)).alias("viable"))
    got = C.viable_counts(profiles, options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "option_id" not in plan.split("Relation")[0] and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    dearest = profiles.withColumn("ceiling", F.lit(2).cast("bigint") ** 40)
    assert C.viable_counts(dearest.withColumn("ceiling", F.col("ceiling").cast("bigint")), options).where("viable = 0").count() == 0


def test_financial_fit_and_overall_score_have_a_row_per_pair(spark, sf):
    from waymark.plans import match_queries as M
    pairs = B.table(spark, sf, "customer").count() * B.table(spark, sf, "supplier").count()
    every = {(r.profile_id, r.option_id): r for r in _all_pairs(spark, sf).collect()}
    for name in ("financial_fit", "overall_score"):
        got = M.QUERIES[name](spark, sf)
        rows = got.collect()
        assert len(rows) == pairs == len(every)
        assert all(getattr(r, c) == getattr(every[r.profile_id, r.option_id], c) for r in rows for c in got.columns)


def test_bounds_change_no_shortlist(spark, sf, monkeypatch):
    """Ties, repeated profiles, missing ids and scores included: bounds from shares of the options give the list that no bounds give."""
    options = B.ready_options(spark, sf).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("option_id", F.col("option_id") + F.col("_c") * 1000).drop("_c")
    p = B.ready_profiles(spark, sf).limit(60)
    p = p.unionByName(p.where("profile_id % 5 = 0")).unionByName(p.where("profile_id % 7 = 0").withColumn("profile_id", F.lit(None).cast("bigint")))
    p = p.withColumn("major_index", F.when(F.col("profile_id") % 11 != 0, F.col("major_index")))
    rows = lambda: sorted(map(tuple, L.shortlist(p, options).select("profile_id", "option_id", "rank", "score", "mode", "verdict").collect()), key=str)
    want = rows()
    monkeypatch.setattr(L, "SEED_ROWS", 5)
    monkeypatch.setattr(L, "SEED_STEP", 3)
    assert len(L._seeds(options.count())) == 2 and L._seeds(4) == []
    assert rows() == want


def test_option_bytes_are_measured(spark):
    rows = spark.createDataFrame([("x" * 1000, [1, 2, 3], 5), (None, None, None)], "t string, l array<int>, n int")
    n, size = P.measured_bytes(rows)
    assert n == 2 and 1000 < size < 1300 and P.measured_bytes(rows.limit(0)) == (0, 0)


def test_pairs_that_cannot_reach_a_bound_go_before_all_fits_are_asked(spark, sf):
    """No pair that reaches the bound is lost, no score exceeds what its first fits allow, and profiles without a bound keep all."""
    pairs = P.pair_grid(B.ready_profiles(spark, sf).select(*P.PROFILE_SCORING).limit(40), B.ready_options(spark, sf).select(*P.OPTION_SCORING))
    pairs = pairs.withColumn("_bound", F.when(F.col("profile_id") % 3 != 0, 70 + F.col("profile_id") % 9).cast("int"))
    every = L._scored(pairs, ["_bound"])
    for n in range(len(fits.FITS) + 1):
        known = ["major", "financial", "academic", "geography", "scholarship", "tests", "preference"][:n]
        assert every.where(fits.most_score(known) < F.col("score")).count() == 0
    got, reached = L._scored(pairs, ["_bound"], "_bound"), F.col("_bound").isNull() | (F.col("score") >= F.col("_bound"))
    assert sorted(map(tuple, got.where(reached).collect()), key=str) == sorted(map(tuple, every.where(reached).collect()), key=str)
    assert every.where(reached).count() <= got.count() < every.count() / 2 + every.where("_bound IS NULL").count()
