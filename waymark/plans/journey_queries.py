"""Keys built on the shortlist: sentences, comparison, what-if, diagnostics, roadmap, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators import catalogue, compare as C, diagnostics as D, explain as E, fits, pairs as P, roadmap as R, shortlist as L, whatif as W
from waymark.plans import bindings as B, match_queries as M, oracle_match as O
from waymark.session import materialize

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _rows(spark, sf):
    """Enriched shortlist rows."""
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    return E.enrich(L.shortlist(profiles, options), profiles, options)


def _joined(column):
    return F.array_join(column, " | ")


# ---- sentences -----------------------------------------------------------

@query("reason_union", O.TEXT_ALL + "SELECT profile_id, option_id, array_to_string(reasons, ' | ') AS reasons, array_to_string(concerns, ' | ') AS concerns FROM v_text")
def reason_union(spark, sf):
    return E.with_text(_rows(spark, sf)).select("profile_id", "option_id", _joined("reasons").alias("reasons"), _joined("concerns").alias("concerns"))


@query("summary_text", O.TEXT_ALL + f"SELECT profile_id, option_id, {O.SUMMARY} AS summary FROM v_text")
def summary_text(spark, sf):
    return E.summary(E.with_text(_rows(spark, sf))).select("profile_id", "option_id", "summary")


@query("card_top_reasons", O.TEXT_ALL + "SELECT profile_id, option_id, array_to_string(list_slice(reasons, 1, 3), ' | ') AS top_reasons, array_to_string(list_slice(concerns, 1, 2), ' | ') AS top_concerns FROM v_text")
def card_top_reasons(spark, sf):
    return E.with_text(_rows(spark, sf)).select(
        "profile_id", "option_id", _joined(F.slice("reasons", 1, 3)).alias("top_reasons"), _joined(F.slice("concerns", 1, 2)).alias("top_concerns"),
    )


@query("main_advantage_concern", O.PAIRS + f"SELECT profile_id, advantage, concern, count(*) AS options FROM (SELECT profile_id, {O.ADVANTAGE} AS advantage, {O.CONCERN} AS concern FROM v_scored) x GROUP BY ALL")
def main_advantage_concern(spark, sf):
    """Main advantages and concerns over the whole catalogue."""
    return catalogue.advantage_summary(B.ready_profiles(spark, sf), B.ready_options(spark, sf))


# ---- comparison ----------------------------------------------------------

@query("id_lookup_join", O.with_(O.PROFILE, O.OPTION) + """
SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY pos) AS INTEGER) AS slot, option_id, name, country FROM (
  SELECT set_id, id, min(pos) AS pos FROM (SELECT c_custkey AS set_id, unnest([c_custkey % 97, 100 + (c_custkey * 7) % 50, (c_custkey * 13 + 1) % 89, (c_custkey * 5 + 2) % 300]) AS id, unnest([1, 2, 3, 4]) AS pos FROM customer) x GROUP BY ALL
) y JOIN v_option ON option_id = id""")
def id_lookup_join(spark, sf):
    from pyspark.sql import Window
    lists = B.id_lists(spark, sf).withColumn("ids", F.array_distinct("ids"))
    found = C.lookup_ids(lists, B.options(spark, sf), ["name", "country"])
    slot = F.row_number().over(Window.partitionBy("set_id").orderBy("position"))
    return found.select("set_id", slot.alias("slot"), "option_id", "name", "country")


def _compare_set(spark, sf):
    rows = _rows(spark, sf).where(F.col("rank") <= 4)
    return materialize(C.relative_leads(rows.withColumns({"set_id": F.col("profile_id"), "position": F.col("rank") - 1})), "compared")


@query("compare_rows", O.COMPARE_ALL + "SELECT set_id, position, option_id, metric, label, better, display, numeric_value AS numeric, note FROM v_metric")
def compare_rows(spark, sf):
    return C.compare_rows(_compare_set(spark, sf)).select("set_id", "position", "option_id", "metric", "label", "better", "display", "numeric", "note")


@query("metric_winners", O.COMPARE_ALL + "SELECT set_id, metric, winner FROM v_winner")
def metric_winners(spark, sf):
    return C.metric_winners(C.compare_rows(_compare_set(spark, sf))).select("set_id", "metric", "winner")


@query("relative_lead", O.COMPARE_ALL + "SELECT set_id, option_id, advantage, concern FROM v_named")
def relative_lead(spark, sf):
    return _compare_set(spark, sf).select("set_id", "option_id", "advantage", "concern")


@query("excluded_vs_other", O.COMPARE_ALL + "SELECT a.set_id, a.option_id, CAST(a.score - max(b.score) AS INTEGER) AS score_lead FROM v_set a JOIN v_set b ON a.set_id = b.set_id AND a.option_id <> b.option_id GROUP BY a.set_id, a.option_id, a.score")
def excluded_vs_other(spark, sf):
    from pyspark.sql import Window
    rows = _rows(spark, sf).where(F.col("rank") <= 4)
    whole = Window.partitionBy("profile_id")
    out = rows.withColumns({"_max": F.max("score").over(whole), "_size": F.count(F.lit(1)).over(whole)})
    out = out.withColumns({
        "_ties": F.sum((F.col("score") == F.col("_max")).cast("int")).over(whole),
        "_next": F.max(F.when(F.col("score") < F.col("_max"), F.col("score"))).over(whole),
    })
    rival = F.when((F.col("score") == F.col("_max")) & (F.col("_ties") == 1), F.col("_next")).otherwise(F.col("_max"))
    return out.where(F.col("_size") > 1).select(F.col("profile_id").alias("set_id"), "option_id", (F.col("score") - rival).cast("int").alias("score_lead"))


@query("takeaways", O.COMPARE_ALL + f"""
, w AS (SELECT set_id, winner, list(lower(label) ORDER BY metric_ordinal) AS wins FROM v_winner GROUP BY ALL)
SELECT n.set_id, n.option_id, CASE WHEN wins IS NULL THEN {O.fill(fixed.COMPARE_TEXT['balanced'], short='short_name')} ELSE {O.fill(fixed.COMPARE_TEXT['best_on'], short='short_name', wins="array_to_string(list_slice(wins, 1, 3), ', ')")} END AS takeaway
FROM v_named n LEFT JOIN w ON w.set_id = n.set_id AND w.winner = n.option_id""")
def takeaways(spark, sf):
    rows = _compare_set(spark, sf)
    return C.takeaways(rows, C.compare_rows(rows))


# ---- what-if -------------------------------------------------------------

def _sides(spark, sf):
    options = B.ready_options(spark, sf)
    before, after = B.ready_profiles(spark, sf), B.changed_profiles(spark, sf)
    listed = [materialize(L.shortlist(p, options), "listed") for p in (before, after)]
    return before, after, *listed, options


@query("budget_presets", O.with_(O.PROFILE, O.OPTION, f"""
v_scen AS (SELECT p.* REPLACE (CAST(s.v AS BIGINT) AS budget_annual_usd, CAST(s.v AS BIGINT) AS max_affordable_annual_usd, CAST(s.v AS BIGINT) AS ceiling, s.n AS aid_need), s.scenario_id
  FROM v_profile p CROSS JOIN (VALUES {', '.join(f"({i}, {v}, {O.q(n)})" for i, _, v, n, _ in fixed.BUDGET_PRESETS)}) s(scenario_id, v, n))""",
    O.scored_sql("v_scen", "", "p.scenario_id,"), O.shortlist_sql("", "profile_id, scenario_id"))
    + "SELECT profile_id, CAST(scenario_id AS INTEGER) AS scenario_id, option_id, CAST(rank AS INTEGER) AS rank, score, verdict FROM v_shortlist")
def budget_presets(spark, sf):
    scenarios = P.prepare_profiles(W.budget_scenarios(B.profiles(spark, sf)), B.country_dim(spark, sf))
    return L.shortlist(scenarios, B.ready_options(spark, sf)).select("profile_id", "scenario_id", "option_id", "rank", "score", "verdict")


@query("nearest_budget_preset", O.with_(O.PROFILE) + f"""
SELECT profile_id, arg_min(label, abs(v - ceiling) * 10 + i) AS preset_label, CAST(arg_min(v, abs(v - ceiling) * 10 + i) AS BIGINT) AS preset_value
FROM v_profile CROSS JOIN (VALUES {', '.join(f"({i}, {O.q(lab)}, {v})" for i, lab, v, _, _ in fixed.BUDGET_PRESETS)}) s(i, label, v) GROUP BY profile_id""")
def nearest_budget_preset(spark, sf):
    return W.nearest_preset(B.profiles(spark, sf)).select("profile_id", "preset_label", "preset_value")


@query("snapshot_before_after", O.BOTH_SIDES + """
SELECT coalesce(b.profile_id, a.profile_id) AS profile_id, coalesce(b.option_id, a.option_id) AS option_id, CAST(b.rank AS INTEGER) AS rank_before, b.score AS score_before, CAST(a.rank AS INTEGER) AS rank_after, a.score AS score_after,
 CASE WHEN b.rank IS NULL THEN 'entered' WHEN a.rank IS NULL THEN 'left' ELSE 'stayed' END AS movement FROM v_shortlist b FULL JOIN v_shortlist_a a ON a.profile_id = b.profile_id AND a.option_id = b.option_id""")
def snapshot_before_after(spark, sf):
    _, _, before, after, _ = _sides(spark, sf)
    return W.before_after(before, after)


@query("entered_left", O.BOTH_SIDES + """
, m AS (SELECT coalesce(b.profile_id, a.profile_id) AS profile_id, coalesce(b.option_id, a.option_id) AS option_id, b.rank AS rank_before, a.rank AS rank_after FROM v_shortlist b FULL JOIN v_shortlist_a a ON a.profile_id = b.profile_id AND a.option_id = b.option_id)
SELECT profile_id, option_id, CAST(coalesce(rank_after, rank_before) AS INTEGER) AS rank, CASE WHEN rank_before IS NULL THEN 'entered' ELSE 'left' END AS movement FROM m WHERE rank_before IS NULL OR rank_after IS NULL""")
def entered_left(spark, sf):
    _, _, before, after, _ = _sides(spark, sf)
    return W.entered_left(before, after)


@query("top_change", O.BOTH_SIDES + """
, b AS (SELECT profile_id, arg_min(option_id, rank) AS top_before, count(*) FILTER (WHERE verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS aid_before, count(*) AS size_before FROM v_shortlist GROUP BY 1),
a AS (SELECT profile_id, arg_min(option_id, rank) AS top_after, count(*) FILTER (WHERE verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS aid_after, count(*) AS size_after FROM v_shortlist_a GROUP BY 1)
SELECT *, top_before <> top_after AS top_changed FROM b JOIN a USING (profile_id)""")
def top_change(spark, sf):
    _, _, before, after, _ = _sides(spark, sf)
    return W.top_change(before, after)


@query("whatif_effects", O.WHATIF_SQL)
def whatif_effects(spark, sf):
    before, after, listed0, listed1, options = _sides(spark, sf)
    names = P.checked_broadcast(options.select("option_id", "short_name"))
    out = W.effects(
        listed0.join(names, "option_id"), listed1.join(names, "option_id"),
        L.verdict_counts(before, options), L.verdict_counts(after, options), before, after,
    )
    lines = F.transform("effects", lambda e: F.concat(e["direction"], F.lit(": "), e["text"]))
    return out.select("profile_id", "headline", _joined(lines).alias("effects"), "no_change")


# ---- diagnostics ---------------------------------------------------------

def _facts(spark, sf):
    profiles, options = B.ready_profiles(spark, sf), B.ready_options(spark, sf)
    rows = materialize(E.enrich(L.shortlist(profiles, options), profiles, options), "shortlist")
    return D.profile_facts(profiles, rows, L.verdict_counts(profiles, options)), rows


@query("diagnostic_dimensions", O.FACTS_ALL + f"SELECT profile_id, dimension, label, level, value, detail FROM ({O.DIMENSIONS}) x")
def diagnostic_dimensions(spark, sf):
    return D.dimensions(_facts(spark, sf)[0]).select("profile_id", "dimension", "label", "level", "value", "detail")


@query("diagnostic_gaps", O.FACTS_ALL + f"SELECT profile_id, gap, title, detail, severity FROM ({O.GAPS}) x")
def diagnostic_gaps(spark, sf):
    return D.gaps(_facts(spark, sf)[0]).select("profile_id", "gap", "title", "detail", "severity")


@query("diagnostic_insights", O.FACTS_ALL + O.INSIGHTS)
def diagnostic_insights(spark, sf):
    return D.insights(_facts(spark, sf)[0])


# ---- roadmap and progress ------------------------------------------------

def _tasks(spark, sf):
    facts, rows = _facts(spark, sf)
    return R.build_roadmap(facts, rows, B.AS_OF)


def _tracked(spark, sf):
    return R.with_completion(_tasks(spark, sf), R.completed_tasks(B.toggles(spark, sf)))


TASK_COLUMNS = ["profile_id", "position", "task_id", "title", "description", "category", "due_date", "priority", "rationale", "option_id", "month_key"]


@query("roadmap_tasks", O.ROADMAP_ALL + f"SELECT {', '.join(TASK_COLUMNS)} FROM v_task1")
def roadmap_tasks(spark, sf):
    return _tasks(spark, sf).select(*TASK_COLUMNS)


@query("task_completion_join", O.ROADMAP_ALL + "SELECT profile_id, task_id, position, done FROM v_task")
def task_completion_join(spark, sf):
    return _tracked(spark, sf).select("profile_id", "task_id", "position", "done")


@query("task_filter", O.ROADMAP_ALL + "SELECT profile_id, task_id, due_date FROM v_task WHERE category = 'documents' AND NOT done")
def task_filter(spark, sf):
    return R.task_filter(_tracked(spark, sf), "documents", hide_done=True).select("profile_id", "task_id", "due_date")


@query("month_buckets", O.ROADMAP_ALL + """
SELECT profile_id, month_key, count(*) AS task_count, count(*) FILTER (WHERE done) AS done_count, count(*) FILTER (WHERE category = 'shortlist') AS shortlist_count, count(*) FILTER (WHERE category = 'tests') AS tests_count,
 count(*) FILTER (WHERE category = 'documents') AS documents_count, count(*) FILTER (WHERE category = 'scholarships') AS scholarships_count, count(*) FILTER (WHERE category = 'applications') AS applications_count,
 strftime(CAST(month_key || '-01' AS DATE), '%B %Y') AS label, string_agg(task_id, ',' ORDER BY due_date, position) AS task_ids FROM v_task GROUP BY profile_id, month_key""")
def month_buckets(spark, sf):
    return R.month_buckets(_tracked(spark, sf))


@query("progress_tracks", O.ROADMAP_ALL + f"""
, c AS (SELECT c_custkey AS profile_id, CAST(c_custkey % 5 <> 0 AS BIGINT) AS f FROM customer),
r AS (SELECT profile_id, category AS track, count(*) FILTER (WHERE done) AS completed, count(*) AS total FROM v_task GROUP BY ALL
 UNION ALL SELECT profile_id, 'overall', count(*) FILTER (WHERE done) + any_value(f), count(*) + 1 FROM v_task JOIN c USING (profile_id) GROUP BY profile_id
 UNION ALL SELECT profile_id, 'profile', f, 1 FROM c)
SELECT profile_id, track, completed, total, CAST({O.rnd('CAST(completed AS DOUBLE) / CAST(total AS DOUBLE) * 100e0')} AS INTEGER) AS percent FROM r""")
def progress_tracks(spark, sf):
    return R.progress(_tracked(spark, sf), B.profile_complete(spark, sf))


SOON = """soon AS (SELECT profile_id, count(*) AS soon_count, array_to_string(list_slice(list(short_name ORDER BY rank), 1, 3), ', ') AS soon_names FROM v_shortlist
 WHERE scholarship_deadline - DATE '2026-09-01' BETWEEN 0 AND 35 GROUP BY profile_id)"""


@query("soon_deadlines", O.ALL + ", " + SOON + " SELECT * FROM soon")
def soon_deadlines(spark, sf):
    return R.soon_deadlines(_rows(spark, sf), B.AS_OF)


@query("next_action", O.ROADMAP_ALL + ", " + SOON + f"""
, f AS (SELECT * FROM v_task WHERE NOT done QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, due_date, position) = 1),
g AS (SELECT f.*, soon_count, soon_names, due_date - DATE '2026-09-01' AS days FROM f LEFT JOIN soon USING (profile_id))
SELECT profile_id, task_id, priority, due_date, CASE WHEN category = 'shortlist' AND soon_count > 0 THEN {O.fill(fixed.NEXT_ACTION['soon'], n='soon_count', noun="CASE WHEN soon_count = 1 THEN 'university has a scholarship deadline' ELSE 'universities have scholarship deadlines' END", names='soon_names')}
 WHEN days BETWEEN 0 AND 30 THEN {O.fill(fixed.NEXT_ACTION['due'], rationale='rationale', days='days', s="CASE WHEN days = 1 THEN '' ELSE 's' END")} ELSE rationale END AS why,
 {O.case_map('category', {k: v[0] for k, v in fixed.CALL_TO_ACTION.items()})} AS cta_label, {O.case_map('category', {k: v[1] for k, v in fixed.CALL_TO_ACTION.items()})} AS cta_href FROM g""")
def next_action(spark, sf):
    facts, rows = _facts(spark, sf)
    tasks = R.with_completion(R.build_roadmap(facts, rows, B.AS_OF), R.completed_tasks(B.toggles(spark, sf)))
    return R.next_action(tasks, R.soon_deadlines(rows, B.AS_OF), B.AS_OF)


@query("upcoming_deadlines", O.ROADMAP_ALL + """
SELECT profile_id, task_id, due_date, CAST(n AS INTEGER) AS upcoming_rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY position) AS n FROM v_task
 WHERE NOT done AND (category IN ('applications', 'scholarships') OR priority = 'critical')) x WHERE n <= 4""")
def upcoming_deadlines(spark, sf):
    return R.upcoming_deadlines(_tracked(spark, sf)).select("profile_id", "task_id", "due_date", "upcoming_rank")


@query("apply_top5", O.TEXT_ALL + """
SELECT profile_id, option_id, CAST(n AS INTEGER) AS deadline_rank, application_deadline FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY coalesce(application_deadline, DATE '9999-12-31'), rank) AS n FROM v_shortlist) x WHERE n <= 5""")
def apply_top5(spark, sf):
    return R.first_by_deadline(_rows(spark, sf)).select("profile_id", "option_id", "deadline_rank", "application_deadline")
