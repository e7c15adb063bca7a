"""Scenario profiles and the difference between two shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark import fixed
from waymark.fixed import WHATIF
from waymark.functions import scalar as S
from waymark.operators.shortlist import AID_VERDICTS


def _presets() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("scenario_id"), F.lit(label).alias("preset_label"), F.lit(v).cast("bigint").alias("preset_value"),
                 F.lit(need).alias("preset_need"), F.lit(hint).alias("preset_hint")) for i, label, v, need, hint in fixed.BUDGET_PRESETS
    ])


def apply_preset(profiles: DataFrame) -> DataFrame:
    """Budget, ceiling and funding requirement move together."""
    return profiles.withColumns({
        "budget_annual_usd": F.col("preset_value"), "max_affordable_annual_usd": F.col("preset_value"), "aid_need": F.col("preset_need"),
    })


def budget_scenarios(profiles: DataFrame) -> DataFrame:
    """Every profile under every budget preset (five fixed rows per profile)."""
    return apply_preset(profiles.select("*", F.inline(_presets())))


def nearest_preset(profiles: DataFrame) -> DataFrame:
    target = F.greatest("max_affordable_annual_usd", "budget_annual_usd")
    nearest = F.array_min(F.transform(_presets(), lambda p: F.struct(F.abs(p["preset_value"] - target), p["scenario_id"], p["preset_label"].alias("label"), p["preset_value"].alias("value"))))
    return profiles.withColumn("_n", nearest).withColumns({"preset_label": F.col("_n.label"), "preset_value": F.col("_n.value")}).drop("_n")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two shortlists: entered, left or stayed."""
    b = before.select("profile_id", "option_id", F.col("rank").alias("rank_before"), F.col("score").alias("score_before"))
    a = after.select("profile_id", "option_id", F.col("rank").alias("rank_after"), F.col("score").alias("score_after"))
    return b.join(a, ["profile_id", "option_id"], "full_outer").withColumn(
        "movement", F.when(F.col("rank_before").isNull(), "entered").when(F.col("rank_after").isNull(), "left").otherwise("stayed"),
    )


def entered_left(before: DataFrame, after: DataFrame) -> DataFrame:
    """after \\ before and before \\ after, as anti joins."""
    key = ["profile_id", "option_id"]
    gone = before.join(after.select(*key), key, "left_anti").select(*key, "rank", F.lit("left").alias("movement"))
    new = after.join(before.select(*key), key, "left_anti").select(*key, "rank", F.lit("entered").alias("movement"))
    return new.unionByName(gone)


def top_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rank-one option and aid dependence of each side, per profile."""
    def side(listed, tag):
        needs = F.col("verdict").isin(AID_VERDICTS)
        return listed.groupBy("profile_id").agg(
            F.min_by("option_id", "rank").alias(f"top_{tag}"), F.count(F.when(needs, 1)).alias(f"aid_{tag}"), F.count(F.lit(1)).alias(f"size_{tag}"),
        )
    return side(before, "before").join(side(after, "after"), "profile_id").withColumn("top_changed", F.col("top_before") != F.col("top_after"))


def _signed(n: Column) -> Column:
    return F.when(n > 0, "+").otherwise("−")


def _effect(condition: Column, direction, text: Column) -> Column:
    direction = direction if isinstance(direction, Column) else F.lit(direction)
    return F.when(condition, F.struct(direction.alias("direction"), text.alias("text")))


def _delta_effect(key: str, delta: Column, one: str, many: str, good_when_up: bool = True) -> Column:
    text = S.fill(WHATIF[key], sign=_signed(delta), n=F.abs(delta), noun=S.plural(F.abs(delta), one, many))
    return _effect(delta != 0, F.when((delta > 0) == F.lit(good_when_up), "up").otherwise("down"), text)


def _names(items: Column) -> Column:
    return F.array_join(F.transform(F.slice(items, 1, 4), lambda x: x["short_name"]), ", ")


def _more(items: Column) -> Column:
    return F.when(F.size(items) > 4, F.concat(F.lit(", +"), (F.size(items) - 4).cast("string"), F.lit(" more"))).otherwise("")


def effects(before: DataFrame, after: DataFrame, counts_before: DataFrame, counts_after: DataFrame,
            profiles_before: DataFrame, profiles_after: DataFrame) -> DataFrame:
    """Headline and ordered effects of a parameter change, one row per profile.

    Each side holds at most a shortlist, so the grouped lists have a fixed
    maximum length.
    """
    def side(listed, tag):
        return listed.select("profile_id", F.lit(tag).alias("side"), "rank", "option_id", "short_name", F.col("verdict").isin(AID_VERDICTS).alias("aid"))

    rows = side(before, 0).unionByName(side(after, 1)).groupBy("profile_id").agg(
        F.sort_array(F.collect_list(F.struct("side", "rank", "option_id", "short_name", "aid"))).alias("all"),
    )
    old, new = F.filter("all", lambda x: x["side"] == 0), F.filter("all", lambda x: x["side"] == 1)
    rows = rows.withColumns({"old": old, "new": new})
    rows = rows.withColumns({
        "old_ids": F.transform("old", lambda x: x["option_id"]), "new_ids": F.transform("new", lambda x: x["option_id"]),
    }).withColumns({
        "entered": F.filter("new", lambda x: ~F.array_contains(F.col("old_ids"), x["option_id"])),
        "left": F.filter("old", lambda x: ~F.array_contains(F.col("new_ids"), x["option_id"])),
        "aid_before": F.size(F.filter("old", lambda x: x["aid"])), "aid_after": F.size(F.filter("new", lambda x: x["aid"])),
        "top_before": F.get("old", F.lit(0))["short_name"], "top_after": F.get("new", F.lit(0))["short_name"],
    })

    def renamed(df, columns, tag):
        return df.select("profile_id", *[F.col(c).alias(f"{c}_{tag}") for c in columns])

    count_cols = ["affordable_count", "aid_dependent_count", "above_budget_count"]
    profile_cols = ["max_affordable_annual_usd", "preferred_countries", "open_to_any_country", "aid_need"]
    joined = rows
    for df, cols, tag in ((counts_before, count_cols, "b"), (counts_after, count_cols, "a"), (profiles_before, profile_cols, "b"), (profiles_after, profile_cols, "a")):
        joined = joined.join(renamed(df, cols, tag), "profile_id")

    def where(tag):
        return F.when(F.col(f"open_to_any_country_{tag}"), F.array(F.lit("Open to any"))).otherwise(F.col(f"preferred_countries_{tag}"))

    def shown(tag):
        return F.when(F.size(where(tag)) > 0, F.array_join(where(tag), " + ")).otherwise("nothing selected")

    def spaced(c):
        return F.regexp_replace(c, "^([^-]*)-", "$1 ")

    b0, b1 = F.col("max_affordable_annual_usd_b"), F.col("max_affordable_annual_usd_a")
    headline = F.concat_ws(
        " ",
        F.when(b0 != b1, S.fill(WHATIF["budget"], before=S.format_usd(b0), after=S.format_usd(b1))),
        F.when(F.array_join(where("b"), ",") != F.array_join(where("a"), ","), S.fill(WHATIF["countries"], before=shown("b"), after=shown("a"))),
        F.when(F.col("aid_need_b") != F.col("aid_need_a"), S.fill(WHATIF["need"], before=spaced("aid_need_b"), after=spaced("aid_need_a"))),
    )

    def delta(c):
        return F.col(f"{c}_a") - F.col(f"{c}_b")

    n_in, n_out = F.size("entered"), F.size("left")
    dep0, dep1 = F.col("aid_before"), F.col("aid_after")
    items = S.texts(
        _delta_effect("affordable", delta("affordable_count"), "university is", "universities are"),
        _delta_effect("aid", delta("aid_dependent_count"), "university", "universities"),
        _delta_effect("over", delta("above_budget_count"), "university", "universities", good_when_up=False),
        _effect(n_in > 0, "up", S.fill(WHATIF["entered"], n=n_in, s=S.plural(n_in, "", "s"), names=_names(F.col("entered")), more=_more(F.col("entered")))),
        _effect(n_out > 0, "down", S.fill(WHATIF["left"], n=n_out, s=S.plural(n_out, "", "s"), names=_names(F.col("left")), more=_more(F.col("left")))),
        _effect(F.col("top_before") != F.col("top_after"), "neutral", S.fill(WHATIF["top"], before=F.col("top_before"), after=F.col("top_after"))),
        _effect(dep0 != dep1, F.when(dep1 < dep0, "up").otherwise("down"), S.fill(
            WHATIF["dependence"], verb=F.when(dep1 < dep0, "decreased").otherwise("increased"), before=dep0, after=dep1, n=F.size("new"))),
    )
    return joined.withColumn("effects", items).select(
        "profile_id", F.when(headline == "", F.lit(WHATIF["default"])).otherwise(headline).alias("headline"), "effects",
        (F.size("effects") == 0).alias("no_change"),
    )
