"""Dated tasks per profile, their completion, progress, next action and deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import fixed
from waymark.fixed import TASKS
from waymark.functions import scalar as S
from waymark.operators import diagnostics as D


def _as_date(as_of: str) -> Column:
    return F.to_date(F.lit(as_of))


def _task(i, task_id, category, due, priority, title, description, rationale, option_id=None) -> Column:
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        c(i).cast("int").alias("ordinal"), c(task_id).alias("task_id"), c(title).alias("title"), c(description).alias("description"),
        c(category).alias("category"), c(due).alias("due_date"), c(priority).alias("priority"), c(rationale).alias("rationale"),
        c(option_id).cast("bigint").alias("option_id"),
    )


def profile_tasks(facts: DataFrame, as_of: str) -> DataFrame:
    """Tasks that depend on the profile and its shortlist aggregate."""
    today = _as_date(as_of)
    earliest = F.col("earliest_deadline")
    anchor = F.coalesce(earliest, F.date_add(today, 120))

    def ahead(days):
        return F.date_add(today, days)

    def before(days):
        due = F.date_sub(anchor, days)
        return F.when(due < today, F.date_add(today, 3)).otherwise(due)

    def deadline_or(text):
        return F.coalesce(S.long_date(earliest), F.lit(text))

    def t(key, i, category, due, priority, rationale=None, task_id=None, **cols):
        title, description, why = TASKS[key]
        return _task(i, task_id or key, category, due, priority, S.fill(title, **cols), S.fill(description, **cols),
                     rationale if rationale is not None else S.fill(why, **cols))

    band = F.col("ielts_band")
    facts = facts.withColumn("_gaps", D.gap_items())
    english_gap = F.get(F.filter("_gaps", lambda g: g["gap"].isin("english-below", "english-missing")), F.lit(0))["detail"]
    sat_gap = F.get(F.filter("_gaps", lambda g: g["gap"].isin("sat-missing", "sat-below")), F.lit(0))["detail"]
    has_english, has_sat = english_gap.isNotNull(), sat_gap.isNotNull() & (F.col("sat_needed") > 0)
    n_sat = F.col("sat_needed")
    more = F.when(n_sat > 3, F.concat(F.lit("and "), (n_sat - 3).cast("string"), F.lit(" more "))).otherwise("")
    major = F.element_at(S.lit_map(fixed.MAJOR_LABELS), F.col("intended_major"))
    need_text = F.element_at(S.lit_map(fixed.AID_NEED_TASK_TEXT), F.col("aid_need"))
    items = S.texts(
        t("shortlist-review", 0, "shortlist", ahead(7), "critical", n=F.col("results")),
        t("shortlist-compare", 1, "shortlist", ahead(12), "high"),
        F.when(has_english & band.isNull(), t("english-register-new", 2, "tests", ahead(10), "critical", english_gap, "english-register",
                                              deadline=deadline_or("your first deadline"))),
        F.when(has_english & band.isNotNull(), t("english-register-retake", 2, "tests", ahead(10), "critical", english_gap, "english-register",
                                                 need=S.num_text(F.col("english_needed")), band=S.num_text(band))),
        F.when(has_english, t("english-prep", 3, "tests", ahead(38), "high", english_gap)),
        F.when(~has_english & band.isNotNull(), t("english-send", 4, "documents", before(21), "high", band=S.num_text(band), deadline=deadline_or("coming up"))),
        F.when(has_sat, t("sat-register", 5, "tests", ahead(21), F.when(F.col("sat_required") > 0, "critical").otherwise("high"), sat_gap,
                          kind=F.when(F.col("sat_score").isNull(), "sitting").otherwise("retake"), names=F.col("sat_names"), more=more,
                          deadline=deadline_or("your earliest deadline"))),
        F.when(has_sat, t("sat-prep", 6, "tests", ahead(40), "normal", sat_gap)),
        t("doc-statement", 7, "documents", before(45), "high", major=major),
        t("doc-recommendations", 8, "documents", before(40), "high"),
        t("doc-transcript", 9, "documents", before(30), "normal"),
        F.when(F.col("aid_need") != "none", t("doc-financial", 10, "scholarships", before(35), "critical", need=need_text, budget=S.format_usd(F.col("budget_annual_usd")))),
    )
    return facts.withColumn("_items", items).select("profile_id", F.inline("_items"))


def first_by_deadline(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The recommendations whose deadline comes first; no deadline sorts last."""
    order = Window.partitionBy("profile_id").orderBy(F.coalesce("application_deadline", F.to_date(F.lit("9999-12-31"))), "rank")
    return rows.withColumn("deadline_rank", F.row_number().over(order)).where(F.col("deadline_rank") <= limit)


def option_tasks(rows: DataFrame, as_of: str) -> DataFrame:
    """Application and scholarship tasks of the first recommendations by deadline."""
    today = _as_date(as_of)
    short, deadline, scholarship = F.col("short_name"), F.col("application_deadline"), F.col("scholarship_deadline")
    days, sdays = S.days_between(today, deadline), S.days_between(today, scholarship)
    title, description, why = TASKS["apply"]
    slot = F.lit(20) + F.col("deadline_rank") * 2
    apply = F.when(deadline.isNotNull(), _task(
        slot, F.concat(F.lit("apply-"), F.col("option_id").cast("string")), "applications", deadline,
        F.when(days <= 45, "critical").when(days <= 90, "high").otherwise("normal"), S.fill(title, short=short),
        S.fill(description, platform=F.col("application_platform"), deadline=S.long_date(deadline)),
        S.fill(why, short=short, category=F.col("category"), score=F.col("score")), F.col("option_id"),
    ))
    wording = fixed.SCHOLARSHIP_RATIONALE
    rationale = (
        F.when(F.col("verdict") == "aid-dependent", S.fill(wording["aid-dependent"], short=short))
        .when(F.col("verdict") == "potentially-affordable-with-aid", S.fill(wording["potentially-affordable-with-aid"], short=short))
        .otherwise(S.fill(wording["other"], budget=S.format_usd(F.col("budget_annual_usd"))))
    )
    aid = F.when(
        scholarship.isNotNull() & (F.col("aid_need") != "none") & (F.col("scholarship_availability") != "rare-for-international"),
        _task(slot + 1, F.concat(F.lit("scholarship-"), F.col("option_id").cast("string")), "scholarships", scholarship,
              F.when(sdays <= 60, "critical").otherwise("high"), S.fill(TASKS["scholarship"][0], short=short), F.col("aid_note"), rationale, F.col("option_id")),
    )
    return first_by_deadline(rows).select("profile_id", F.inline(S.texts(apply, aid)))


def build_roadmap(facts: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """All tasks; ids are unique per profile by construction, ``position`` is due-date order."""
    tasks = profile_tasks(facts, as_of).unionByName(option_tasks(rows, as_of))
    order = Window.partitionBy("profile_id").orderBy("due_date", "ordinal")
    return tasks.withColumns({"position": F.row_number().over(order), "month_key": F.date_format("due_date", "yyyy-MM")})


def completed_tasks(toggles: DataFrame) -> DataFrame:
    """A task is done when it was toggled an odd number of times."""
    return toggles.groupBy("profile_id", "task_id").agg((F.count(F.lit(1)) % 2 == 1).alias("done"))


def with_completion(tasks: DataFrame, done: DataFrame) -> DataFrame:
    return tasks.join(done, ["profile_id", "task_id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def task_filter(tasks: DataFrame, category: str | None = None, hide_done: bool = False) -> DataFrame:
    out = tasks if category is None else tasks.where(F.col("category") == category)
    return out.where(~F.col("done")) if hide_done else out


def month_buckets(tasks: DataFrame) -> DataFrame:
    """Tasks per month in due order, with done and per-category counts."""
    def n(cond):
        return F.count(F.when(cond, 1))
    first = F.to_date(F.concat(F.col("month_key"), F.lit("-01")))
    return tasks.groupBy("profile_id", "month_key").agg(
        F.sort_array(F.collect_list(F.struct("due_date", "position", "task_id"))).alias("items"),
        F.count(F.lit(1)).alias("task_count"), n(F.col("done")).alias("done_count"),
        *[n(F.col("category") == c).alias(f"{c}_count") for c in fixed.TRACKS[1:]],
    ).withColumns({
        "label": F.date_format(first, "MMMM yyyy"), "task_ids": F.array_join(F.transform("items", lambda x: x["task_id"]), ","),
    }).drop("items")


def progress(tasks: DataFrame, profile_complete: DataFrame) -> DataFrame:
    """Per profile: one row per non-empty track, the profile track, and the overall row, in one grouping-sets pass."""
    done = F.count(F.when(F.col("done"), 1)).alias("completed")
    grouped = (
        tasks.groupingSets([[F.col("profile_id"), F.col("category")], [F.col("profile_id")]], F.col("profile_id"), F.col("category"))
        .agg(done, F.count(F.lit(1)).alias("total"))
    )
    flag = F.col("profile_complete").cast("bigint")
    joined = grouped.join(profile_complete, "profile_id")
    overall = F.col("category").isNull()
    tracks = joined.select(
        "profile_id", F.coalesce("category", F.lit("overall")).alias("track"),
        F.when(overall, F.col("completed") + flag).otherwise(F.col("completed")).alias("completed"),
        F.when(overall, F.col("total") + 1).otherwise(F.col("total")).alias("total"),
    )
    own = profile_complete.select("profile_id", F.lit("profile").alias("track"), flag.alias("completed"), F.lit(1).cast("bigint").alias("total"))
    share = F.col("completed").cast("double") / F.col("total").cast("double") * F.lit(100.0)
    return tracks.unionByName(own).withColumn("percent", S.js_round(share).cast("int"))


def soon_deadlines(rows: DataFrame, as_of: str, days: int = 35) -> DataFrame:
    """Recommendations whose scholarship deadline falls within the window: count and the first three names."""
    left = S.days_between(_as_date(as_of), F.col("scholarship_deadline"))
    return rows.where(left.between(0, days)).groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("soon_count"), F.sort_array(F.collect_list(F.struct("rank", "short_name"))).alias("_s"),
    ).select("profile_id", "soon_count", F.array_join(F.transform(F.slice("_s", 1, 3), lambda x: x["short_name"]), ", ").alias("soon_names"))


def next_action(tasks: DataFrame, soon: DataFrame, as_of: str) -> DataFrame:
    """The first open task by priority, then due date, with its reason and call to action."""
    rank = F.element_at(S.lit_map(fixed.PRIORITY_RANK), F.col("priority"))
    order = Window.partitionBy("profile_id").orderBy(rank, "due_date", "position")
    first = tasks.where(~F.col("done")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).join(soon, "profile_id", "left")
    days = S.days_between(_as_date(as_of), F.col("due_date"))
    n = F.col("soon_count")
    noun = S.plural(n, "university has a scholarship deadline", "universities have scholarship deadlines")
    why = (
        F.when((F.col("category") == "shortlist") & (n > 0), S.fill(fixed.NEXT_ACTION["soon"], n=n, noun=noun, names=F.col("soon_names")))
        .when(days.between(0, 30), S.fill(fixed.NEXT_ACTION["due"], rationale=F.col("rationale"), days=days, s=S.plural(days, "", "s")))
        .otherwise(F.col("rationale"))
    )
    cta = S.lit_map({k: v[0] for k, v in fixed.CALL_TO_ACTION.items()})
    href = S.lit_map({k: v[1] for k, v in fixed.CALL_TO_ACTION.items()})
    return first.select("profile_id", "task_id", "priority", "due_date", why.alias("why"), F.element_at(cta, F.col("category")).alias("cta_label"), F.element_at(href, F.col("category")).alias("cta_href"))


def upcoming_deadlines(tasks: DataFrame, limit: int = 4) -> DataFrame:
    wanted = F.col("category").isin("applications", "scholarships") | (F.col("priority") == "critical")
    order = Window.partitionBy("profile_id").orderBy("position")
    return tasks.where(~F.col("done") & wanted).withColumn("upcoming_rank", F.row_number().over(order)).where(F.col("upcoming_rank") <= limit)
