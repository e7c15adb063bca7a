"""Ranked shortlist per profile, its relaxation rule, and catalogue-wide verdict counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import fixed
from waymark.functions import scalar as S
from waymark.operators import fits, pairs as P, search
from waymark.session import materialize

AID_VERDICTS = ["potentially-affordable-with-aid", "aid-dependent"]
#: Costs and ceilings are below two to the power of one more than this.
COST_BITS = 50


def best_first(profile_key=("profile_id",)):
    return [F.col("score").desc(), F.col("name").asc(), F.col("option_id").asc()]


def rank_options(scored: DataFrame, key=("profile_id",)) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*best_first())))


def _branches(profiles: DataFrame, options: DataFrame, min_results: int) -> list[tuple[DataFrame, Callable[..., DataFrame]]]:
    """Profiles with the pairing each needs.

    A profile with chosen countries and at least ``min_results`` options there
    never looks outside them, so it meets its options by country; open or short
    profiles meet the whole catalogue.
    """
    marked, focused = _marked(profiles, options, min_results)
    left = P.PROFILE_SCORING + _scenario(profiles)
    return [(marked.where(focused).select(*left), P.country_pairs), (marked.where(~focused).select(*left), P.pair_grid)]


def _marked(profiles: DataFrame, options: DataFrame, min_results: int) -> tuple[DataFrame, Column]:
    """Profiles, and whether only their own countries count."""
    per_country = options.groupBy("country").count()
    counts = per_country.agg(F.map_from_entries(F.collect_list(F.struct("country", "count"))).alias("m")).scalar()
    reach = F.aggregate(
        F.transform("preferred_countries", lambda c: F.coalesce(F.element_at(F.col("_counts"), c), F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda a, b: a + b,
    )
    marked = profiles.withColumn("_counts", counts).withColumn("_reach", reach).drop("_counts")
    return marked, F.col("wants_specific") & (F.col("_reach") >= min_results)


def _scenario(df: DataFrame) -> list[str]:
    return [c for c in ("scenario_id",) if c in df.columns]


#: Fits that are cheap to tell or weigh much; under a bound they are asked first.
FIRST = {"major": fits.major_fit, "financial": fits.financial_fit, "academic": fits.academic_fit}


def _scored(pairs: DataFrame, keep: list[str], bound: str | None = None) -> DataFrame:
    """Pairs with all fits and the score. Those that can't reach ``bound`` by the fits asked so far go before the others are."""
    if bound is not None:
        for n, fit in enumerate(FIRST.values(), 1):
            pairs = fit(pairs).where(F.col(bound).isNull() | (fits.most_score([*FIRST][:n]) >= F.col(bound)))
    for fit in fits.FITS:
        if bound is None or fit not in FIRST.values():
            pairs = fit(pairs)
    return fits.overall_score(pairs).select(*keep, *fits.SCORED)


def _searched(profiles: DataFrame, options: DataFrame, min_results: int, keep: int, tiers: bool) -> DataFrame:
    """Of a large catalogue that workers can hold, the scored pairs among which are the best ``keep`` of each tier that counts, or of all."""
    marked, focused = _marked(profiles, options, min_results)
    left = P.PROFILE_SCORING + _scenario(profiles)
    return _scored(search.best_pairs(marked.select(*left, focused.alias("_focused")), options, keep, tiers, search_parts(profiles)), _scenario(profiles))


def searchable(options: DataFrame) -> bool:
    """Whether the options are so many that a search is worth it, and workers can hold them."""
    return bool(_seeds(options.count())) and search.fits_memory(options)


def search_parts(profiles: DataFrame) -> int:
    return max(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-profiles.count() // TASK_PROFILES))


def scored_candidates(profiles: DataFrame, options: DataFrame, min_results: int = fixed.MIN_RESULTS, best: int | None = None) -> DataFrame:
    """Score only the pairs the shortlist rule can reach; with ``best``, those that can't be among so many best of a profile by score may be left out."""
    if best is not None and searchable(options):
        return _searched(profiles, options, min_results, best, tiers=False)
    left, right = P.PROFILE_SCORING + _scenario(profiles), P.OPTION_SCORING
    near, wide = [pair(some, options.select(*right)).select(*left, *right) for some, pair in _branches(profiles, options, min_results)]
    return _scored(near.unionByName(wide), _scenario(profiles))


def _tiered(scored: DataFrame) -> DataFrame:
    return scored.withColumn("tier", F.when(F.col("outside_preferred"), 3).when(F.col("verdict") != "above-budget", 1).otherwise(2))


def _within(bounds: list[str]) -> Column:
    """Whether a pair may still be listed: it isn't behind the bound of its tier, nor in a tier that the full one before it makes useless."""
    one, two, three = (F.col(b) for b in bounds)
    bound = F.when(F.col("tier") == 1, one).when(F.col("tier") == 2, two).otherwise(three)
    useless = ((F.col("tier") > 1) & one.isNotNull()) | ((F.col("tier") > 2) & two.isNotNull())
    return ~useless & (bound.isNull() | F.coalesce(F.col("score") >= bound, F.lit(False)))


def _best_of_tiers(pair: Callable[..., DataFrame], profiles: DataFrame, options: DataFrame, keep: int, parts: int | None, seeds: list[int]) -> DataFrame:
    """The best ``keep`` rows of each (profile, tier).

    Every pair is scored, but few are sorted: the options of a hash share,
    ranked first, give each tier of a profile a score that ``keep`` options
    reach, and no option below it can be among the best of all. Each share is
    ranked under the bounds of the one before it. Profiles without an id, and
    tiers with fewer options in the share, have no bound.
    """
    extra = _scenario(profiles)
    key, right, bounds = [*extra, "profile_id"], P.OPTION_SCORING, [f"_bound{t}" for t in (1, 2, 3)]
    own = P.PROFILE_SCORING + extra
    per_tier = Window.partitionBy(*key, "tier").orderBy(*best_first())
    bounded = profiles.withColumns({b: F.lit(None).cast("int") for b in bounds}) if seeds else profiles
    for n, share in enumerate([*seeds, 1]):
        some = options.where(F.pmod(F.xxhash64("option_id"), F.lit(share)) == 0) if share > 1 else options
        carried = bounds if n else []
        pairs = pair(bounded.select(*own, *carried), some.select(*right), parts=parts).select(*own, *carried, *right)
        # where the first tier has a bound, the others are useless
        rows = _tiered(_scored(pairs, [*extra, *carried], bounds[0] if carried else None))
        rows = (rows.where(_within(bounds)) if carried else rows).drop(*bounds)
        ranked = rows.withColumn("_n", F.row_number().over(per_tier)).where(F.col("_n") <= keep)
        if share == 1:
            return ranked.drop("_n")
        reached = ranked.where(F.col("_n") == keep).groupBy(*key).agg(*[F.max(F.when(F.col("tier") == t, F.col("score"))).alias(b) for t, b in enumerate(bounds, 1)])
        bounded = profiles.join(materialize(reached, "bounds").hint("merge"), key, "left")


#: Fewest options whose ranking is worth a bound, how much larger each further share is, and profiles in a task that has bounds.
SEED_ROWS, SEED_STEP, TASK_PROFILES = 512, 8, 4096


def _seeds(rows: int) -> list[int]:
    """Shares of the options that are ranked before all are, the smallest first: 1/64, 1/8."""
    shares, share = [], SEED_STEP
    while rows // share >= SEED_ROWS:
        shares.insert(0, share)
        share *= SEED_STEP
    return shares


def shortlist(profiles: DataFrame, options: DataFrame, limit: int = fixed.RESULT_COUNT,
              min_results: int = fixed.MIN_RESULTS) -> DataFrame:
    """Top rows per profile under the three-way relaxation rule.

    Rows are first cut to the best few per (profile, tier); those survivors are
    enough both to pick the mode and to fill the list, so only they travel to
    the final ranking. A large catalogue is searched under bounds by workers
    that hold it; where they can't, bounds spare most pairs the sort.
    """
    key = [*_scenario(profiles), "profile_id"]
    keep = max(limit, min_results)
    seeds = _seeds(options.count())
    if seeds and search.fits_memory(options):
        kept = _tiered(_searched(profiles, options, min_results, keep, tiers=True))
    elif seeds:
        # read once per share and branch; as a table they keep plans short
        profiles = materialize(profiles.select(*P.PROFILE_SCORING, *_scenario(profiles)), "profiles")
        parts = max(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-profiles.count() // TASK_PROFILES))
        near, wide = [_best_of_tiers(pair, some, options, keep, parts, seeds) for some, pair in _branches(profiles, options, min_results)]
        kept = near.unionByName(wide)
    else:
        per_tier = Window.partitionBy(*key, "tier").orderBy(*best_first())
        kept = _tiered(scored_candidates(profiles, options, min_results)).withColumn("_n", F.row_number().over(per_tier)).where(F.col("_n") <= keep).drop("_n")
    whole = Window.partitionBy(*key)
    viable = F.sum(F.when(F.col("tier") == 1, 1).otherwise(0)).over(whole)
    in_scope = F.sum(F.when(F.col("tier") <= 2, 1).otherwise(0)).over(whole)
    moded = kept.withColumn("mode", F.when(viable >= min_results, 1).when(in_scope >= min_results, 2).otherwise(3))
    usable = moded.where((F.col("mode") == 3) | (F.col("tier") <= 2))
    order = Window.partitionBy(*key).orderBy(
        F.when((F.col("mode") == 1) & (F.col("tier") != 1), 1).otherwise(0), *best_first(),
    )
    return usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("tier")


def notice(mode, preferred, is_open):
    """Why the list was relaxed, or null."""
    chosen = F.array_join(preferred, ", ")
    noun = F.when(F.size(preferred) == 1, "country").otherwise("countries")
    widened = S.fill(fixed.NOTICE_WIDENED, noun=noun, chosen=chosen)
    return (
        F.when(mode == 2, F.lit(fixed.NOTICE_TIGHT))
        .when((mode == 3) & is_open, F.lit(fixed.NOTICE_OPEN))
        .when(mode == 3, widened)
    )


def counts_up_to(prices: DataFrame, asked: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """``asked`` (key, ceiling, distinct) with the sums of ``counts`` over ``prices`` (key, cost) up to the ceiling; none where there is nothing.

    Whole-dollar costs are counted in the ranges of every power of two; the
    numbers up to a ceiling are the union of one such range per set bit of it,
    so each ceiling meets its few ranges by an equi-join. No list is built up
    to the dearest option.
    """
    sums = [F.sum(c).alias(c) for c in counts]
    ranges = prices.select(*key, *counts, F.explode(F.sequence(F.lit(0), F.lit(COST_BITS))).alias("bit"), "cost").select(
        *key, "bit", F.expr("shiftright(cost, bit)").alias("range"), *counts,
    ).groupBy(*key, "bit", "range").agg(*sums)
    above = F.greatest(F.floor("ceiling").cast("bigint") + 1, F.lit(0).cast("bigint"))
    ceilings = asked.where(F.col("ceiling").isNotNull()).select(*key, "ceiling", F.least(above, F.lit(2 ** (COST_BITS + 1) - 1)).alias("above"))
    bits = ceilings.select(*key, "ceiling", "above", F.explode(F.sequence(F.lit(0), F.lit(COST_BITS))).alias("bit")).where(F.expr("shiftright(above, bit) % 2 = 1"))
    return bits.select(*key, "ceiling", "bit", F.expr("shiftright(above, bit) - 1").alias("range")).join(ranges, [*key, "bit", "range"]).groupBy(*key, "ceiling").agg(*sums)


def verdict_counts(profiles: DataFrame, options: DataFrame, key=("profile_id",)) -> DataFrame:
    """Affordable / aid-dependent / above-budget counts over the whole catalogue, without pairing.

    A verdict group depends only on how a profile's ceiling compares with an
    option's total and best-case cost.
    """
    priced = options.where(F.col("total_annual_cost").isNotNull())
    prices = priced.select(F.inline(F.array(
        F.struct(F.col("total_annual_cost").cast("bigint").alias("cost"), F.lit(1).alias("affordable"), F.lit(0).alias("within_best")),
        F.struct(F.col("best_case_net_cost").cast("bigint").alias("cost"), F.lit(0).alias("affordable"), F.lit(1).alias("within_best")),
    ))).groupBy("cost").agg(F.sum("affordable").alias("affordable"), F.sum("within_best").alias("within_best"))
    reached = counts_up_to(prices, profiles.select("ceiling").distinct(), [], ["affordable", "within_best"])
    totals = options.agg(
        F.struct(
            F.count(F.lit(1)).alias("options"),
            F.count(F.when(F.col("total_annual_cost").isNotNull(), 1)).alias("priced"),
        ).alias("t")
    ).scalar()
    none = F.lit(0).cast("bigint")
    counted = profiles.select(*key, "ceiling").join(reached, "ceiling", "left").withColumn("t", totals).select(
        *key, F.col("t.options").alias("option_count"), F.col("t.priced").alias("priced"), F.coalesce("affordable", none).alias("affordable_count"), F.coalesce("within_best", none).alias("within_best"),
    )
    return counted.select(
        *key, "option_count", "affordable_count",
        (F.col("within_best") - F.col("affordable_count")).alias("aid_dependent_count"),
        (F.col("priced") - F.col("within_best")).alias("above_budget_count"),
    )


def strong_matches(listed: DataFrame, key=("profile_id",)) -> DataFrame:
    return listed.groupBy(*key).agg(
        F.count(F.when(F.col("category") == "strong", 1)).alias("strong_count"),
        F.count(F.lit(1)).alias("shortlist_size"),
    )
