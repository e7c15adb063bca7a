"""Side-by-side comparison of small option sets: metric rows, winners, relative leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import fixed
from waymark.fixed import COMPARE_TEXT
from waymark.functions import scalar as S
from waymark.operators import explain as E, pairs as P

DIMENSIONS = [d for d, _ in fixed.DIMENSION_LABELS]


def lookup_ids(lists: DataFrame, options: DataFrame, columns) -> DataFrame:
    """Ids to records: unknown ids drop out, list order is kept in ``position``."""
    wanted = lists.select("set_id", F.posexplode("ids").alias("position", "option_id"))
    return wanted.join(P.checked_broadcast(options.select("option_id", *columns)), "option_id")


def relative_leads(rows: DataFrame) -> DataFrame:
    """Own score against the best rival in the set, per dimension, without a self join.

    The best rival is the set maximum, unless this row alone holds it, in which
    case it is the next lower score. All windows share one partitioning.
    """
    whole = Window.partitionBy("set_id")
    out = rows.withColumns({f"_max_{d}": F.max(f"{d}_score").over(whole) for d in DIMENSIONS} | {"set_size": F.count(F.lit(1)).over(whole)})
    out = out.withColumns({
        f"_ties_{d}": F.sum((F.col(f"{d}_score") == F.col(f"_max_{d}")).cast("int")).over(whole) for d in DIMENSIONS
    } | {
        f"_next_{d}": F.max(F.when(F.col(f"{d}_score") < F.col(f"_max_{d}"), F.col(f"{d}_score"))).over(whole) for d in DIMENSIONS
    })

    def lead(d: str) -> Column:
        own, top = F.col(f"{d}_score"), F.col(f"_max_{d}")
        rival = F.when((own == top) & (F.col(f"_ties_{d}") == 1), F.col(f"_next_{d}")).otherwise(top)
        return own - rival

    best = F.array_max(F.array(*[
        F.struct(lead(d).alias("lead"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (d, label) in enumerate(fixed.DIMENSION_LABELS)
    ]))
    worst = F.array_min(F.array(*[
        F.struct(lead(d).alias("lead"), F.lit(i).alias("o"), F.lit(label).alias("label")) for i, (d, label) in enumerate(fixed.DIMENSION_LABELS)
    ]))
    out = out.withColumns({"_best": best, "_worst": worst, "_own_best": E.main_advantage(), "_own_worst": E.main_concern()})
    alone = F.col("set_size") == 1
    advantage = (
        F.when(alone, F.col("_own_best"))
        .when(F.col("_best.lead") <= 0, S.fill(COMPARE_TEXT["tie"], own=F.col("_own_best")))
        .otherwise(S.fill(COMPARE_TEXT["lead"], label=F.col("_best.label"), n=F.col("_best.lead")))
    )
    concern = (
        F.when(alone, F.col("_own_worst"))
        .when((F.col("_worst.lead") >= 0) & (F.col("_own_worst") == fixed.NO_CONCERN), F.lit(COMPARE_TEXT["nothing_weaker"]))
        .when(F.col("_worst.lead") >= 0, F.col("_own_worst"))
        .otherwise(S.fill(COMPARE_TEXT["deficit"], label=F.col("_worst.label"), n=F.col("_worst.lead")))
    )
    named = out.withColumns({"advantage": advantage, "concern": concern})
    return named.drop(*[c for c in named.columns if c.startswith("_")])


def compare_rows(rows: DataFrame) -> DataFrame:
    """Fifteen metric rows per option; ``rows`` carries scores, option columns and ``advantage``/``concern``."""
    policy = F.col("sat_policy")
    sat = F.when(policy == "not-used", "Not used").otherwise(F.concat(
        F.upper(F.substring(policy, 1, 1)), F.expr("substring(sat_policy, 2)"),
        F.when(F.coalesce(F.col("recommended_sat"), F.lit(0)) != 0, F.concat(F.lit(" (~"), F.col("recommended_sat").cast("string"), F.lit(")"))).otherwise(""),
    ))
    availability = F.col("scholarship_availability")
    none = F.lit(None).cast("double")
    shown = {
        "country": (F.concat_ws(" — ", "country", "city"), none),
        "match": (F.concat(F.col("score").cast("string"), F.lit("%")), F.col("score")),
        "program": (
            F.when(F.col("major_score") >= 90, F.coalesce(F.get("programs", F.lit(0)), F.lit("Available")))
            .when(F.col("major_score") >= 50, "Related programme only").otherwise("Not offered"), F.col("major_score"),
        ),
        "tuition": (S.format_usd(F.col("tuition")), F.col("tuition")),
        "living": (S.format_usd(F.col("living_cost")), F.col("living_cost")),
        "netcost": (S.format_usd(F.col("best_case_net_cost")), F.col("best_case_net_cost")),
        "financial": (F.element_at(S.lit_map(fixed.VERDICT_LABELS), F.col("verdict")), F.element_at(S.lit_map(fixed.VERDICT_RANKS), F.col("verdict"))),
        "scholarship": (
            F.when(F.col("full_ride_possible"), "Full cost possible").when(F.col("full_tuition_possible"), "Full tuition possible")
            .when(availability == "extensive", "Extensive partial aid").when(availability == "moderate", "Moderate partial aid").otherwise("Limited"),
            F.col("scholarship_score"),
        ),
        "ielts": (
            F.when(F.col("minimum_ielts").isNotNull(), F.concat(F.lit("IELTS "), S.num_text(F.col("minimum_ielts"))))
            .when(F.col("recommended_ielts").isNotNull(), F.concat(F.lit("IELTS ~"), S.num_text(F.col("recommended_ielts")), F.lit(" (recommended)")))
            .otherwise("Not published"), F.coalesce("minimum_ielts", "recommended_ielts"),
        ),
        "sat": (sat, none),
        "selectivity": (F.regexp_replace("admission_selectivity", "^([^-]*)-", "$1 "), none),
        "deadline": (S.short_date(F.col("application_deadline")), none),
        "scholarship-deadline": (S.short_date(F.col("scholarship_deadline")), none),
        "advantage": (F.col("advantage"), none),
        "concern": (F.col("concern"), none),
    }
    metrics = F.array(*[
        F.struct(
            F.lit(i).alias("metric_ordinal"), F.lit(key).alias("metric"), F.lit(label).alias("label"), F.lit(better).cast("string").alias("better"),
            shown[key][0].alias("display"), shown[key][1].cast("double").alias("numeric"),
            F.lit(fixed.COMPARE_NOTES.get(key)).cast("string").alias("note"),
        ) for i, (key, label, better) in enumerate(fixed.COMPARE_METRICS)
    ])
    return rows.select("set_id", "position", "option_id", "short_name", F.inline(metrics))


def metric_winners(long_rows: DataFrame) -> DataFrame:
    """Winner per set and metric; none below two values or on a full tie, first on a partial tie."""
    valued = long_rows.where(F.col("better").isNotNull() & F.col("numeric").isNotNull())
    signed = F.when(F.col("better") == "high", -F.col("numeric")).otherwise(F.col("numeric"))
    return (
        valued.groupBy("set_id", "metric_ordinal", "metric", "label")
        .agg(
            F.min_by("option_id", F.struct(signed, F.col("position"))).alias("winner"),
            F.min_by("position", F.struct(signed, F.col("position"))).alias("winner_position"),
            F.count(F.lit(1)).alias("_n"), F.min("numeric").alias("_lo"), F.max("numeric").alias("_hi"),
        )
        .where((F.col("_n") >= 2) & (F.col("_lo") != F.col("_hi"))).drop("_n", "_lo", "_hi")
    )


def takeaways(rows: DataFrame, long_rows: DataFrame) -> DataFrame:
    """The first three metrics an option wins, or the balanced sentence."""
    wins = metric_winners(long_rows).groupBy("set_id", F.col("winner").alias("option_id")).agg(
        F.sort_array(F.collect_list(F.struct("metric_ordinal", F.lower("label").alias("label")))).alias("wins"),
    )
    joined = rows.select("set_id", "option_id", "short_name").join(wins, ["set_id", "option_id"], "left")
    names = F.array_join(F.transform(F.slice("wins", 1, 3), lambda w: w["label"]), ", ")
    return joined.select(
        "set_id", "option_id",
        F.when(F.col("wins").isNull(), S.fill(COMPARE_TEXT["balanced"], short=F.col("short_name")))
        .otherwise(S.fill(COMPARE_TEXT["best_on"], short=F.col("short_name"), wins=names)).alias("takeaway"),
    )
