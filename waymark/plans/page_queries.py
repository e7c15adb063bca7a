"""Keys for fetched pages: content, structure, scope, kinds, selection, extraction, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import signals
from waymark.functions import html as H, scalar as S, urls as U
from waymark.operators import extract as X, pages as G, registry as R
from waymark.plans import bindings as B, oracle_match as O, oracle_pages as P, page_bindings as V
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


TRUTH = O.with_(V.RENDERED_SQL)


def _text(spark, sf):
    """The content stage, written once."""
    return materialize(G.with_content(V.rendered(spark, sf)), "content")


def _content(spark, sf, pages=None):
    """Content and scope as one written stage."""
    return materialize(G.with_scope(G.with_content(V.rendered(spark, sf) if pages is None else pages)), "scoped")


def _temporal(spark, sf):
    """Content, scope and dates as one written stage."""
    return materialize(G.with_temporal(G.with_scope(G.with_content(V.rendered(spark, sf))), B.AS_OF), "dated")


def _scored(spark, sf):
    return G.kind_scores(_temporal(spark, sf))


# ---- content and structure ------------------------------------------------

@query("html_text", "SELECT p_partkey AS k, 'Name & ' || p_name || chr(10) || 'Price ' || p_size || ' <b> é ' || chr(10) || 'end' AS text FROM part")
def html_text(spark, sf):
    html = B.table(spark, sf, "part").selectExpr("p_partkey AS k", "concat('<style>x{}</style><p>Name &amp;   ', p_name, '</p><script>var a = 1;</script><!-- no -->Price&nbsp;', p_size, ' &lt;b&gt; &#233; <br/>end<br>') AS html")
    text = F.regexp_replace(H.text_of(F.col("html")), " *\n *", "\n")
    return html.select("k", F.regexp_replace(text, "(?<=é)\n", " \n").alias("text"))


@query("main_content", TRUTH + "SELECT k AS page_id, true AS used_main, false AS has_chrome, true AS has_costs FROM v_r")
def main_content(spark, sf):
    m = V.rendered(spark, sf).select("page_id", H.main_content(F.col("html")).alias("m"))
    text = F.col("m.html")
    return m.select("page_id", F.col("m.used_main").alias("used_main"), text.rlike("99,999|Scholarship links|88,888|How to apply").alias("has_chrome"), text.contains("<h2>Costs</h2>").alias("has_costs"))


@query("page_main_content", r"SELECT page_id, CAST(length(html) AS INTEGER) AS before, CAST(length(regexp_extract(html, '(?s)<article\b.*?</article>', 0)) AS INTEGER) AS after, true AS used_main FROM pages")
def page_main_content(spark, sf):
    m = B.table(spark, sf, "pages").select("page_id", F.length("html").alias("before"), H.main_content(F.col("html")).alias("m"))
    return m.select("page_id", "before", F.length("m.html").alias("after"), F.col("m.used_main").alias("used_main"))


@query("page_structure", TRUTH + "SELECT k AS page_id, title, title || '|Dates|Costs|English|Testing|Aid' AS headings, 6 AS sections, CASE WHEN has_table THEN 1 ELSE 0 END AS tables, CASE WHEN has_table THEN 9 ELSE 0 END AS cells FROM v_r")
def page_structure(spark, sf):
    c = _text(spark, sf)
    tables = H.tables_of(F.col("main_html"))
    return c.select(
        "page_id", "title", F.array_join("headings", "|").alias("headings"), F.size(H.sections_of(F.col("main_html"))).alias("sections"),
        F.size(tables).alias("tables"), F.size(F.flatten(F.flatten(tables))).alias("cells"),
    )


@query("applicant_scope", TRUTH + """SELECT k AS page_id, scope, CASE WHEN scope IN ('first_year', 'international_first_year') THEN 'first_year' WHEN scope = 'general_undergraduate' THEN 'all_undergraduate' WHEN scope <> 'unknown' THEN scope
 WHEN k % 12 IN (1, 5) THEN 'international' ELSE 'unknown' END AS audience FROM v_r""")
def applicant_scope(spark, sf):
    return _content(spark, sf).select("page_id", "scope", "audience")


@query("academic_year", TRUTH + "SELECT k AS page_id, CASE WHEN has_table THEN '2025-26,2026-27' ELSE prose_year END AS years, has_table AS ambiguous FROM v_r")
def academic_year(spark, sf):
    years = G.academic_years(F.col("text"))
    return _text(spark, sf).select("page_id", F.array_join(years, ",").alias("years"), (F.size(years) > 1).alias("ambiguous"))


@query("page_dates", TRUTH + "SELECT k AS page_id, CASE k % 5 WHEN 1 THEN DATE '2026-06-15' WHEN 2 THEN DATE '2025-03-01' WHEN 3 THEN DATE '2023-01-10' END AS updated, CASE WHEN k % 10 = 9 THEN DATE '2019-03-01' END AS published FROM v_r")
def page_dates(spark, sf):
    p = V.rendered(spark, sf)
    return p.select("page_id", G.first_date(F.col("html"), F.col("url"), signals.UPDATED).alias("updated"), G.first_date(F.col("html"), F.col("url"), signals.PUBLISHED).alias("published"))


_STATUS = "CASE WHEN k % 10 = 9 OR k % 5 = 3 THEN 'historical' WHEN k % 7 <> 0 THEN 'current' WHEN k % 5 = 1 THEN 'current' ELSE 'dated' END"


@query("temporal_status", TRUTH + f"SELECT k AS page_id, {_STATUS} AS temporal_status, k % 10 = 9 AS blog_like FROM v_r")
def temporal_status(spark, sf):
    return _temporal(spark, sf).select("page_id", "temporal_status", "blog_like")


@query("co_occurrence", "WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS hay FROM documents) SELECT doc_id, (contains(hay, ' the ') OR contains(hay, ' la ')) AND (contains(hay, ' and ') OR contains(hay, ' que ')) AS together FROM d")
def co_occurrence(spark, sf):
    d = B.table(spark, sf, "documents").withColumn("sections", F.array(F.struct(F.lit("").alias("heading"), F.col("text").alias("body"))))
    return d.select("doc_id", G.together(["the", "la"], ["and", "que"], F.lit("  "), G.places(F.col("sections"), F.col("text"))).alias("together"))


# ---- kinds and selection --------------------------------------------------

_CANON = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {
    "admissions": 2, "international_admissions": 4, "tuition": 2, "cost_of_attendance": 4, "financial_aid": 2, "international_financial_aid": 4, "scholarships": 2,
    "testing_policy": 2, "english_requirements": 2, "deadlines": 2, "programs": 4, "common_data_set": 2}.items())
_ADJ = "CASE WHEN kind IN ('admissions', 'international_admissions', 'testing_policy', 'english_requirements', 'deadlines', 'programs') THEN CASE WHEN scope IN ('first_year', 'international_first_year') THEN 2 WHEN scope = 'general_undergraduate' THEN 1 WHEN k % 12 IN (1, 5) THEN 1 ELSE 0 END ELSE 0 END"


@query("authority_score", TRUTH + f"""SELECT k AS page_id, CAST(CASE WHEN k % 10 = 9 THEN -6 ELSE CASE kind {_CANON} END END + CASE {_STATUS} WHEN 'current' THEN 2 WHEN 'dated' THEN -2 ELSE -4 END + {_ADJ} AS DOUBLE) AS authority,
 CASE WHEN k % 10 = 9 THEN 'historical' ELSE 'canonical' END AS role FROM v_served""")
def authority_score(spark, sf):
    """Authority of each page for the kind it was rendered for."""
    scored = G.kind_scores(_temporal(spark, sf).withColumnRenamed("kind", "own_kind"))
    return scored.where((F.col("kind") == F.col("own_kind")) & F.col("failed").isNull()).select("page_id", "authority", "role")


def _listed_scores(spark, sf):
    """Kind scores of pages that carry the context of the sitemap they were found in."""
    pages = G.with_temporal(G.with_scope(G.with_content(V.rendered(spark, sf, listed=True))), B.AS_OF)
    return G.kind_scores(materialize(pages, "dated").drop("kind"), "context")


@query("page_kind_score", P.KIND_SCORE)
def page_kind_score(spark, sf):
    return _listed_scores(spark, sf).select("page_id", "kind", "failed", "content", "relevance", "authority", "score", "role", "accepted")


def _ranked(spark, sf):
    return G.ranked_pages(_listed_scores(spark, sf))


@query("best_page_per_kind", P.BEST)
def best_page_per_kind(spark, sf):
    return _ranked(spark, sf).where("page_rank = 1").select("institution_id", "kind", "page_url", "role", "scope", "score")


@query("runner_up", P.RUNNER_UP)
def runner_up(spark, sf):
    return G.best_pages(_ranked(spark, sf)).select("institution_id", "kind", "page_url", F.col("runner_up.page_url").alias("runner_up_url"), "why_it_won")


def _gated(spark, sf):
    institutions = V.rendered(spark, sf).select("institution_id").distinct()
    return G.quality_gate(G.best_pages(_ranked(spark, sf)), institutions)


@query("quality_gate", P.QUALITY_GATE)
def quality_gate(spark, sf):
    return _gated(spark, sf).select("institution_id", "kind", "page_url", "outcome", "reason")


@query("not_found_kinds", P.NOT_FOUND)
def not_found_kinds(spark, sf):
    return G.run_status(_gated(spark, sf))


@query("run_counters", TRUTH + "SELECT 'scope' AS decision, count(*) AS n FROM v_r WHERE k NOT IN (SELECT k FROM v_served) UNION ALL SELECT 'classified', count(*) FROM v_served")
def run_counters(spark, sf):
    decision = F.when(F.col("scope").isin(*signals.FIRST_YEAR_SCOPES), "classified").otherwise("scope")
    return _content(spark, sf).groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


# ---- extraction -----------------------------------------------------------

@query("money_tokens", TRUTH + """SELECT k AS page_id, unnest(CASE WHEN has_table THEN [tuition - 1000, tuition, housing - 500, housing, tuition, housing, 75000] ELSE [tuition, housing, 75000] END)::DOUBLE AS value,
 unnest(CASE WHEN has_table THEN ['per-year', 'per-year', 'per-year', 'per-year', 'per-year', 'per-year', 'unqualified'] ELSE ['per-year', 'per-year', 'unqualified'] END) AS unit, 'USD' AS currency FROM v_r""")
def money_tokens(spark, sf):
    tokens = X.money_tokens(_text(spark, sf).select("page_id", "text"), "text")
    return tokens.select("page_id", F.col("value").cast("double").alias("value"), "unit", "currency")


@query("money_exclusions", TRUTH + "SELECT k AS page_id, 75000e0 AS value, 'an income threshold, not a price' AS reason FROM v_r")
def money_exclusions(spark, sf):
    tokens = X.money_tokens(_text(spark, sf).select("page_id", "text"), "text").withColumn("reason", X.not_a_price(F.col("sentence")))
    return tokens.where(F.col("reason").isNotNull()).select("page_id", F.col("value").cast("double").alias("value"), "reason")


def _money(spark, sf):
    return X.money_scoped(X.routed(_content(spark, sf), "money"))


@query("money_scoped", TRUTH + "SELECT page_id, field, CAST(value AS DOUBLE) AS value, academic_year, year_source, excluded FROM v_money")
def money_scoped(spark, sf):
    return _money(spark, sf).select("page_id", "field", F.col("value").cast("double").alias("value"), "academic_year", "year_source", "excluded")


@query("table_header_year", TRUTH + """SELECT k AS page_id, cell, years FROM (SELECT k, unnest(['Tuition per year', '$' || format('{:,}', tuition - 1000), '$' || format('{:,}', tuition), 'Housing per year', '$' || format('{:,}', housing - 500), '$' || format('{:,}', housing)]) AS cell,
 unnest(['', '2025-26', '2026-27', '', '2025-26', '2026-27']) AS years FROM v_r WHERE has_table) t""")
def table_header_year(spark, sf):
    cells = X.header_years(X.table_cells(_text(spark, sf)))
    return cells.select("page_id", "cell", F.array_join("column_years", ",").alias("years"))


_IELTS = "CASE k % 3 WHEN 0 THEN 6 + (k % 5) // 2 + (k % 2) * 0.5e0 WHEN 1 THEN 6e0 ELSE 7e0 END"


@query("ielts_toefl", TRUTH + f"SELECT k AS page_id, 'IELTS' AS test, CAST({_IELTS} AS DOUBLE) AS score, ['overall', 'section', 'unqualified'][k % 3 + 1] AS score_kind FROM v_r UNION ALL SELECT k, 'TOEFL', CAST(80 + k % 40 AS DOUBLE), NULL FROM v_r")
def ielts_toefl(spark, sf):
    c = _text(spark, sf)
    ielts = X.ielts_scores(c).select("page_id", F.lit("IELTS").alias("test"), "score", "score_kind")
    return ielts.unionByName(X.toefl_scores(c).select("page_id", F.lit("TOEFL").alias("test"), "score", F.lit(None).cast("string").alias("score_kind")))


@query("testing_policy", TRUTH + "SELECT k AS page_id, ['optional', 'required', 'not-used', NULL][k % 4 + 1] AS policy, k % 4 = 3 AS ambiguous FROM v_r")
def testing_policy(spark, sf):
    p = X.testing_policy(F.col("text"))
    return _text(spark, sf).select("page_id", F.when(F.size(p) == 1, F.get(p, F.lit(0))).alias("policy"), (F.size(p) > 1).alias("ambiguous"))


@query("aid_signals", TRUTH + "SELECT k AS page_id, k % 6 = 0 AS meets_full_need, k % 6 = 3 AS full_ride, k % 6 = 1 AS competitive_award, k % 6 IN (0, 1, 3) AS international_eligible, k % 6 = 2 AS international_excluded FROM v_r")
def aid_signals(spark, sf):
    return X.aid_signals(_text(spark, sf)).select("page_id", "meets_full_need", "full_ride", "competitive_award", "international_eligible", "international_excluded")


_AID = """SELECT k AS page_id, institution_id, f AS field, CASE WHEN k % 6 = 2 THEN CASE WHEN f = 'aidCertainty' THEN 'SUPPORTED' ELSE 'CONTRADICTED' END
 WHEN (k % 6 = 0 AND f IN ('meetsFullNeedForInternationals', 'needBasedAidForInternationals', 'aidCertainty')) OR (k % 6 = 1 AND f = 'aidCertainty') OR (k % 6 = 3 AND f IN ('fullRidePossible', 'fullTuitionPossible')) THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS state
 FROM v_r CROSS JOIN (SELECT unnest(['meetsFullNeedForInternationals', 'fullRidePossible', 'fullTuitionPossible', 'needBasedAidForInternationals', 'aidCertainty']) AS f) t"""


@query("aid_flags", TRUTH + f"SELECT page_id, field, state, CASE WHEN state = 'UNKNOWN' THEN NULL WHEN field = 'aidCertainty' THEN CASE page_id % 6 WHEN 2 THEN 'minimal' WHEN 0 THEN 'meets-full-need' ELSE 'competitive' END WHEN state = 'CONTRADICTED' THEN 'false' ELSE 'true' END AS value FROM ({_AID}) a")
def aid_flags(spark, sf):
    return X.aid_flags(X.aid_signals(_text(spark, sf))).select("page_id", "field", "state", "value")


@query("deadline_tokens", TRUTH + "SELECT k AS page_id, due AS date, 'application' AS date_kind FROM v_r")
def deadline_tokens(spark, sf):
    return X.deadline_tokens(_text(spark, sf)).select("page_id", "date", "date_kind")


@query("cds_fields", """SELECT p_partkey AS page_id, '2026-27' AS academic_year, unnest(['sat25', 'sat75', 'satPolicy', 'tuition', 'admitRate']) AS field,
 unnest([CAST(1200 + p_size AS VARCHAR), CAST(1400 + p_size AS VARCHAR), 'optional', CAST(30000 + p_partkey AS VARCHAR), CAST(CAST(floor(CAST(2500 + p_size AS DOUBLE) / (10000 + p_partkey) * 1000e0 + 0.5e0) AS DOUBLE) / 10e0 AS VARCHAR)]) AS value FROM part""")
def cds_fields(spark, sf):
    return X.common_data_set(V.cds_pages(spark, sf)).select("page_id", "academic_year", "field", "value")


# ---- validation and outcomes ---------------------------------------------

def _kept(spark, sf):
    return _money(spark, sf).where(F.col("excluded").isNull()).withColumns({"confidence": F.when(F.col("is_annual"), 0.85).otherwise(0.5), "from_cds": F.lit(False)})


_BEST = "v_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institution_id, field ORDER BY academic_year DESC, page_id, o) AS n FROM v_money WHERE excluded IS NULL) t WHERE n = 1)"


@query("best_money_candidate", TRUTH.rstrip() + ", " + _BEST + " SELECT institution_id, field, page_id, CAST(value AS DOUBLE) AS value, academic_year FROM v_best")
def best_money_candidate(spark, sf):
    return X.best_money(_kept(spark, sf)).select("institution_id", "field", "page_id", F.col("value").cast("double").alias("value"), "academic_year")


@query("validate_money", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS copies, CAST(sum(CASE WHEN l_extendedprice * 2 > 120000 THEN 1 ELSE 0 END + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN l_linenumber IN (4, 5) THEN 1 ELSE 0 END + CASE WHEN l_linenumber = 5 THEN 0 ELSE 0 END) AS BIGINT) AS warnings
 FROM lineitem GROUP BY ALL""")
def validate_money(spark, sf):
    rows = B.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_extendedprice * 2 AS decimal(18,2)) AS value", "'USD' AS currency",
        "CASE l_linenumber WHEN 3 THEN 'per-month' WHEN 4 THEN 'per-semester' WHEN 5 THEN 'unqualified' ELSE 'per-year' END AS unit", "'2026-27' AS academic_year", "false AS year_ambiguous")
    judged = X.money_issues(rows)
    return judged.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.size("errors")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"))


_ENGLISH = "kind IN ('english_requirements', 'international_admissions', 'admissions')"


@query("validate_scores", TRUTH + f"""SELECT institution_id, CASE WHEN n = 0 THEN NULL WHEN lo = hi THEN {O.num('lo')} END AS value, n = 0 OR lo <> hi AS failed FROM (SELECT institution_id, count(*) FILTER (WHERE k % 3 <> 1) AS n,
 CASE WHEN count(*) FILTER (WHERE k % 3 = 0) > 0 THEN min({_IELTS}) FILTER (WHERE k % 3 = 0) ELSE min({_IELTS}) FILTER (WHERE k % 3 = 2) END AS lo, CASE WHEN count(*) FILTER (WHERE k % 3 = 0) > 0 THEN max({_IELTS}) FILTER (WHERE k % 3 = 0) ELSE max({_IELTS}) FILTER (WHERE k % 3 = 2) END AS hi
 FROM v_served WHERE {_ENGLISH} GROUP BY institution_id) t""")
def validate_scores(spark, sf):
    out = X.score_outcome(X.ielts_scores(X.routed(_content(spark, sf), "english")), "minimumIELTS")
    return out.select("institution_id", "value", (F.size("errors") > 0).alias("failed"))


@query("validate_deadline", TRUTH + """SELECT institution_id, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) END AS value, lo IS NULL OR lo <> hi AS failed FROM (SELECT institution_id, min(due) FILTER (WHERE due BETWEEN DATE '2026-08-01' AND DATE '2027-12-31') AS lo,
 max(due) FILTER (WHERE due BETWEEN DATE '2026-08-01' AND DATE '2027-12-31') AS hi FROM v_served WHERE kind IN ('deadlines', 'admissions', 'scholarships') GROUP BY institution_id) t""")
def validate_deadline(spark, sf):
    out = X.deadline_outcome(X.deadline_tokens(X.routed(_content(spark, sf), "deadlines")), "applicationDeadline")
    return out.select("institution_id", "value", (F.size("errors") > 0).alias("failed"))


@query("record_consistency", """SELECT p_partkey AS record_id, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['fullTuitionPossible'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN p_partkey % 4 = 0 THEN ['totalCostOfAttendance'] ELSE CAST([] AS VARCHAR[]) END
 || CASE WHEN p_partkey % 5 = 0 THEN ['aidCertainty'] ELSE CAST([] AS VARCHAR[]) END) AS field FROM part""")
def record_consistency(spark, sf):
    p = B.table(spark, sf, "part").selectExpr("p_partkey AS record_id", """inline(array(named_struct('field', 'fullRidePossible', 'value', 'true'), named_struct('field', 'fullTuitionPossible', 'value', CASE WHEN p_partkey % 3 = 0 THEN 'false' ELSE 'true' END),
        named_struct('field', 'tuition', 'value', '40000'), named_struct('field', 'totalCostOfAttendance', 'value', CASE WHEN p_partkey % 4 = 0 THEN '9000' ELSE '60000' END),
        named_struct('field', 'aidCertainty', 'value', CASE WHEN p_partkey % 5 = 0 THEN 'minimal' ELSE 'competitive' END)))""")
    return X.consistency_issues(p, "record_id").select("record_id", "field")


def _evidence_pages(spark, sf):
    """The rendered pages and Common Data Sets of every second institution."""
    return _content(spark, sf, V.rendered(spark, sf).unionByName(V.cds_rendered(spark, sf)))


def _candidates(content):
    return materialize(X.extract_candidates(content), "candidates")


@query("extract_candidates", V.OUTCOMES.replace("WITH", TRUTH.rstrip() + ",", 1) + """
SELECT page_id, field, value, unit, academic_year, year_source, cand_kind, confidence, from_cds, CASE WHEN from_cds THEN 'common_data_set' ELSE 'official_web' END AS source_type, true AS sourced FROM v_candidate""")
def extract_candidates(spark, sf):
    found = X.extract_candidates(_evidence_pages(spark, sf))
    sourced = F.col("url").isNotNull() & F.col("title").isNotNull() & (F.length("content_hash") == 64) & (F.length("excerpt") > 3)
    return found.select("page_id", "field", "value", "unit", "academic_year", "year_source", "cand_kind", "confidence", "from_cds", "source_type", sourced.alias("sourced"))


@query("proposals", V.OUTCOMES.replace("WITH", TRUTH.rstrip() + ",", 1) + " SELECT institution_id, field, value, verdict, errors, warnings, source_type FROM v_proposal")
def proposals(spark, sf):
    out = X.proposals(_candidates(_evidence_pages(spark, sf)))
    return out.select("institution_id", "field", "value", "verdict", F.array_join("errors", " | ").alias("errors"), F.array_join("warnings", " | ").alias("warnings"), F.col("evidence_source_type").alias("source_type"))


@query("outcome_union", V.OUTCOMES.replace("WITH", TRUTH.rstrip() + ",", 1) + V.REVIEW)
def outcome_union(spark, sf):
    content = _evidence_pages(spark, sf)
    candidates = _candidates(content)
    flags = X.aid_flags(X.aid_signals(X.routed(content, "aid")))
    return X.review_table(X.proposals(candidates), candidates, X.money_scoped(X.routed(content, "money")), flags, X.scope_refusals(content))
