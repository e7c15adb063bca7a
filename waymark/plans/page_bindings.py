"""Policy pages rendered from the part table, with the SQL that states what each page says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark import signals
from waymark.functions import scalar as S
from waymark.operators import registry as R
from waymark.plans.bindings import table
from waymark.plans.oracle_match import lst, q
from waymark.session import spread
from waymark.sources import files as SRC

TITLES = ["Admissions", "International Admissions", "Tuition and Fees", "Cost of Attendance", "Financial Aid", "Financial Aid for International Students",
          "Scholarships", "Standardized Testing", "English Proficiency", "Application Deadlines", "Majors and Programs", "Common Data Set"]
PATHS = ["/admissions", "/admissions/international", "/tuition-and-fees", "/cost-of-attendance", "/financial-aid", "/financial-aid/international", "/scholarships",
         "/testing", "/english-proficiency", "/deadlines", "/academics/programs", "/common-data-set"]
PREFIXES = ["", "", "", "", "", "Visiting ", "First Year ", "Transfer ", "Graduate "]
MODIFIED = ["", "2026-06-15", "2025-03-01", "2023-01-10", ""]
TESTING = ["Applicants are test-optional.", "The SAT is required.", "We are test-blind.", "We are test-optional. The SAT is required."]
AID = ["The university meets full demonstrated need. International students are eligible to apply.",
       "Scholarships are competitive. International applicants are eligible.",
       "This aid is not available to international applicants.",
       "A full-ride award exists. International applicants are eligible.",
       "Write to the office for details.", "Scholarships are available."]
FILLER = "Read this page in full before you send anything to us. Our office answers questions by letter and by phone on every weekday, and it keeps a record of each answer that it gives to a visitor or to a school."

_PATH = f"CASE WHEN k % 10 = 9 THEN concat('/blog/2019/03/p', k) ELSE concat({S.sql_pick(PATHS, 'k % 12')}, '/p', k) END"


def sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap entries of three pages in four: one document per kind and institution."""
    kind, site = S.sql_pick(signals.KINDS, "k % 12"), "concat('https://www.uni', k div 12, '.edu')"
    documents = table(spark, sf, "part").selectExpr("p_partkey AS k").where("k % 4 <> 2").selectExpr(
        "k div 12 AS institution_id", f"concat({site}, '/sitemaps/', {kind}, '.xml') AS sitemap_url",
        f"concat('<urlset><url><loc>', {site}, {_PATH}, '/</loc></url></urlset>') AS xml",
    )
    return SRC.sitemap_entries(documents).select("institution_id", "sitemap_url", "loc")


def rendered(spark: SparkSession, sf: str, listed: bool = False) -> DataFrame:
    """Pages of the part table; with ``listed`` also the context of the sitemap that lists each."""
    # the keys are spread while they are narrow: pages are rendered and read where they are
    p = spread(table(spark, sf, "part").selectExpr("p_partkey AS k"), "k").selectExpr(
        "k", "k div 12 AS institution_id", f"{S.sql_pick(signals.KINDS, 'k % 12')} AS kind",
        f"concat({S.sql_pick(PREFIXES, 'k % 9')}, {S.sql_pick(TITLES, 'k % 12')}) AS shown",
        f"{_PATH} AS path",
        "k % 4 <> 3 AND k % 7 <> 0 AS has_table", "20000 + (k * 37) % 40000 AS tuition", "8000 + (k * 13) % 9000 AS housing",
        "CASE WHEN k % 7 = 0 THEN '2024-25' ELSE '2026-27' END AS prose_year", f"{S.sql_pick(MODIFIED, 'k % 5')} AS modified",
        "CASE WHEN k % 8 = 7 THEN 'January 15, 2020' ELSE date_format(date_add(DATE'2026-10-01', cast(k % 120 AS int)), 'MMMM d, yyyy') END AS due",
        "CASE k % 3 WHEN 0 THEN concat('IELTS ', 6 + (k % 5) div 2, '.', (k % 2) * 5, ' overall is required.') WHEN 1 THEN 'IELTS 6.0 in each component is required.' ELSE 'IELTS 7.0 is required.' END AS ielts",
    )
    usd = "concat('$', format_number({0}, 0))".format
    page = f"""concat('<!DOCTYPE html><html><head><title>', shown, '</title>', CASE WHEN modified <> '' THEN concat('<meta property="article:modified_time" content="', modified, 'T08:00:00Z">') ELSE '' END,
      '</head><body><nav class="top"><a href="/x">How to apply</a> Tuition is $99,999 per year. IELTS 9.0 overall. <nav>Deadline: January 5, 2027</nav> end</nav><div class="site-sidebar wide"><div>Financial aid</div>Scholarship links</div><main><h1>', shown,
      '</h1><p>', {S.sql_lit(FILLER)}, CASE WHEN k % 2 = 0 THEN ' For undergraduate applicants.' ELSE '' END, '</p><h2>Dates</h2><p>The application deadline is ', due, '.</p>',
      CASE WHEN has_table THEN concat('<table><tr><th>Item</th><th>2025-26</th><th>2026-27</th></tr><tr><td>Tuition per year</td><td>', {usd('tuition - 1000')}, '</td><td>', {usd('tuition')},
        '</td></tr><tr><td>Housing per year</td><td>', {usd('housing - 500')}, '</td><td>', {usd('housing')}, '</td></tr></table>') ELSE '' END,
      '<h2>Costs</h2><p>Tuition is ', {usd('tuition')}, ' per year and housing is ', {usd('housing')}, ' per year for ', prose_year, '. Families with income below $75,000 attend tuition free.</p><h2>English</h2><p>', ielts,
      ' TOEFL ', 80 + k % 40, ' is accepted.</p><h2>Testing</h2><p>', {S.sql_pick(TESTING, 'k % 4')}, '</p><h2>Aid</h2><p>', {S.sql_pick(AID, 'k % 6')}, '</p></main><footer>Tuition $88,888 per year</footer></body></html>')"""
    p = p.withColumn("url", F.expr("concat('https://www.uni', institution_id, '.edu', path)"))
    context = ["context"] if listed else []
    p = R.with_sitemap_context(p, sitemaps(spark, sf)) if listed else p
    return p.selectExpr("k AS page_id", "institution_id", "kind", "url", *context, f"{page} AS html", "'text/html' AS content_type")


SCOPE = ("CASE k % 9 WHEN 8 THEN 'graduate' WHEN 7 THEN 'transfer' WHEN 5 THEN 'visiting' WHEN 6 THEN CASE WHEN k % 12 IN (1, 5) OR (k % 10 <> 9 AND k % 12 = 1) THEN 'international_first_year' ELSE 'first_year' END "
         "ELSE CASE WHEN k % 2 = 0 THEN 'general_undergraduate' ELSE 'unknown' END END")
RENDERED_SQL = f"""
v_r0 AS (SELECT p_partkey AS k, p_partkey // 12 AS institution_id, {lst(signals.KINDS)}[p_partkey % 12 + 1] AS kind, {lst(PREFIXES)}[p_partkey % 9 + 1] || {lst(TITLES)}[p_partkey % 12 + 1] AS title,
  p_partkey % 4 <> 3 AND p_partkey % 7 <> 0 AS has_table, 20000 + (p_partkey * 37) % 40000 AS tuition, 8000 + (p_partkey * 13) % 9000 AS housing, CASE WHEN p_partkey % 7 = 0 THEN '2024-25' ELSE '2026-27' END AS prose_year,
  CASE WHEN p_partkey % 8 = 7 THEN DATE '2020-01-15' ELSE DATE '2026-10-01' + CAST(p_partkey % 120 AS INTEGER) END AS due FROM part),
v_r AS (SELECT *, {SCOPE} AS scope FROM v_r0),
v_served AS (SELECT * FROM v_r WHERE scope IN ('first_year', 'international_first_year', 'general_undergraduate', 'unknown')),
v_price AS (SELECT * FROM v_served WHERE kind IN ('tuition', 'cost_of_attendance')),
v_money AS (
  SELECT k AS page_id, institution_id, 'tuition' AS field, tuition - 1000 AS value, '2025-26' AS academic_year, 'table-column' AS year_source, NULL AS excluded, 1 AS o FROM v_price WHERE has_table
  UNION ALL SELECT k, institution_id, 'tuition', tuition, '2026-27', 'table-column', NULL, 2 FROM v_price WHERE has_table
  UNION ALL SELECT k, institution_id, 'livingCost', housing - 500, '2025-26', 'table-column', NULL, 1 FROM v_price WHERE has_table
  UNION ALL SELECT k, institution_id, 'livingCost', housing, '2026-27', 'table-column', NULL, 2 FROM v_price WHERE has_table
  UNION ALL SELECT k, institution_id, 'tuition', tuition, prose_year, 'section', NULL, 3 FROM v_price
  UNION ALL SELECT k, institution_id, 'tuition', housing, prose_year, 'section', 'a different cost component is named closer to this figure', 4 FROM v_price
  UNION ALL SELECT k, institution_id, 'livingCost', tuition, prose_year, 'section', 'a different cost component is named closer to this figure', 4 FROM v_price
  UNION ALL SELECT k, institution_id, 'livingCost', housing, prose_year, 'section', NULL, 3 FROM v_price
  UNION ALL SELECT k, institution_id, 'tuition', 75000, prose_year, 'section', 'an income threshold, not a price', 5 FROM v_price)"""


def cds_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS page_id", "p_partkey AS institution_id",
        r"""concat('Common Data Set 2026-27\nC1 applicants ', 10000 + p_partkey, ' admitted ', 2500 + p_size, '\nC8 Applicants are test-optional\nC9 SAT Composite 25th ', 1200 + p_size, ' 75th ', 1400 + p_size, '\nG1 Tuition is $', format_number(30000 + p_partkey, 0), ' per year')  AS text""",
    )


#: Page numbers of the Common Data Sets start here.
CDS_PAGES = 1_000_000_000


def cds_rendered(spark: SparkSession, sf: str) -> DataFrame:
    """A Common Data Set page for every second institution."""
    lines = r"""concat('<p>C1 applicants ', 10000 + p_partkey, ' admitted ', 2500 + p_size, '</p><p>C8 Applicants are test-optional</p><p>C9 SAT Composite 25th ', 1200 + p_size, ' 75th ', 1400 + p_size, '</p><p>G1 Tuition is $', format_number(30000 + p_partkey, 0), ' per year</p>')"""
    return table(spark, sf, "part").where("p_partkey % 24 = 11").selectExpr(
        f"p_partkey + {CDS_PAGES} AS page_id", "p_partkey div 12 AS institution_id", "'common_data_set' AS kind", "concat('https://www.uni', p_partkey div 12, '.edu/cds') AS url",
        f"concat('<html><head><title>Common Data Set</title></head><body><main><h1>Common Data Set 2026-27</h1>', {lines}, '</main></body></html>') AS html", "'text/html' AS content_type",
    )


_ENGLISH = "('english_requirements', 'international_admissions', 'admissions')"
_AID_KINDS = "('financial_aid', 'international_financial_aid', 'scholarships')"
_BAND = "CASE k % 3 WHEN 0 THEN 6 + (k % 5) // 2 + (k % 2) * 0.5e0 WHEN 1 THEN 6e0 ELSE 7e0 END"
_WHOLE = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END".format
_ISSUE = f"""CASE k % 6 WHEN 0 THEN CASE WHEN k % 12 = 6 THEN {q(signals.AID_ISSUE_SIZE)} ELSE '' END WHEN 1 THEN {q(signals.AID_ISSUE_SIZE)} WHEN 2 THEN {q(signals.AID_EXCLUDED)} WHEN 3 THEN '' END"""
_REASON = f"""CASE WHEN k % 6 IN (4, 5) THEN {q(signals.AID_SILENT)} WHEN f = 'meetsFullNeedForInternationals' THEN {q(signals.AID_NO_FULL_NEED)} WHEN f = 'fullRidePossible' THEN {q(signals.AID_NO_RIDE)}
  WHEN f = 'fullTuitionPossible' THEN {q(signals.AID_NO_TUITION)} WHEN f = 'needBasedAidForInternationals' THEN {q(signals.AID_NO_NEED_BASED)} WHEN k % 6 = 3 THEN {q(signals.AID_NOTHING)} END"""
_REFUSED = {"('tuition', 'cost_of_attendance')": ["tuition", "livingCost", "totalCostOfAttendance"], _ENGLISH: ["minimumIELTS"], "('testing_policy', 'admissions')": ["satPolicy"],
            "('deadlines', 'admissions', 'scholarships')": ["applicationDeadline"], _AID_KINDS: ["aidCertainty"]}
#: What the pages say as candidates, proposals and review rows, stated from how they are rendered.
OUTCOMES = f"""WITH v_cds AS (SELECT {CDS_PAGES} + p_partkey AS page_id, p_partkey // 12 AS institution_id, unnest(['sat25', 'sat75', 'satPolicy', 'tuition', 'admitRate']) AS field,
  unnest([CAST(1200 + p_size AS VARCHAR), CAST(1400 + p_size AS VARCHAR), 'optional', CAST(30000 + p_partkey AS VARCHAR), CAST(CAST(floor(CAST(2500 + p_size AS DOUBLE) / (10000 + p_partkey) * 1000e0 + 0.5e0) AS DOUBLE) / 10e0 AS VARCHAR)]) AS value FROM part WHERE p_partkey % 24 = 11),
v_flag AS (SELECT k AS page_id, k, institution_id, f AS field, CASE WHEN k % 6 = 2 THEN CASE WHEN f = 'aidCertainty' THEN 'SUPPORTED' ELSE 'CONTRADICTED' END
  WHEN (k % 6 = 0 AND f IN ('meetsFullNeedForInternationals', 'needBasedAidForInternationals', 'aidCertainty')) OR (k % 6 = 1 AND f = 'aidCertainty') OR (k % 6 = 3 AND f IN ('fullRidePossible', 'fullTuitionPossible')) THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS state, {_REASON} AS reason
  FROM v_served CROSS JOIN (SELECT unnest(['meetsFullNeedForInternationals', 'fullRidePossible', 'fullTuitionPossible', 'needBasedAidForInternationals', 'aidCertainty']) AS f) t WHERE kind IN {_AID_KINDS}),
v_spoken AS (SELECT *, CASE WHEN field = 'aidCertainty' THEN CASE k % 6 WHEN 2 THEN 'minimal' WHEN 0 THEN 'meets-full-need' ELSE 'competitive' END WHEN state = 'CONTRADICTED' THEN 'false' ELSE 'true' END AS value, CASE WHEN k % 6 = 2 THEN 0.3e0 ELSE 0.8e0 END AS confidence FROM v_flag WHERE state <> 'UNKNOWN'),
v_candidate AS (
  SELECT page_id, institution_id, field, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS value, 'per-year' AS unit, academic_year, year_source, NULL AS cand_kind, 0.85e0 AS confidence, false AS from_cds FROM v_money WHERE excluded IS NULL
  UNION ALL SELECT k, institution_id, 'minimumIELTS', CAST(CAST({_BAND} AS DOUBLE) AS VARCHAR), NULL, NULL, NULL, ['overall', 'section', 'unqualified'][k % 3 + 1], CASE k % 3 WHEN 0 THEN 0.9e0 ELSE 0.4e0 END, false FROM v_served WHERE kind IN {_ENGLISH}
  UNION ALL SELECT k, institution_id, 'minimumTOEFL', CAST(CAST(80 + k % 40 AS DOUBLE) AS VARCHAR), NULL, NULL, NULL, NULL, 0.85e0, false FROM v_served WHERE kind IN {_ENGLISH}
  UNION ALL SELECT k, institution_id, 'satPolicy', ['optional', 'required', 'not-used'][k % 4 + 1], NULL, NULL, NULL, NULL, 0.9e0, false FROM v_served WHERE kind IN ('testing_policy', 'admissions') AND k % 4 <> 3
  UNION ALL SELECT k, institution_id, f, CAST(due AS VARCHAR), NULL, NULL, NULL, 'application', 0.75e0, false FROM v_served CROSS JOIN (SELECT unnest(['applicationDeadline', 'scholarshipDeadline']) AS f) t WHERE kind IN ('deadlines', 'admissions', 'scholarships')
  UNION ALL SELECT page_id, institution_id, field, value, NULL, NULL, NULL, state, confidence, false FROM v_spoken
  UNION ALL SELECT page_id, institution_id, field, value, 'per-year', '2026-27', 'common-data-set', NULL, 0.95e0, true FROM v_cds),
v_price1 AS (SELECT *, row_number() OVER (PARTITION BY institution_id, field ORDER BY cds DESC, academic_year DESC, page_id, o) AS n FROM (SELECT institution_id, field, page_id, CAST(value AS DOUBLE) AS value, academic_year, o, 0 AS cds FROM v_money WHERE excluded IS NULL
  UNION ALL SELECT institution_id, field, page_id, CAST(value AS DOUBLE), '2026-27', 0, 1 FROM v_cds WHERE field = 'tuition') t),
v_score0 AS (SELECT institution_id, 'minimumIELTS' AS field, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 2 THEN 2 END AS grade, CAST({_BAND} AS DOUBLE) AS v FROM v_served WHERE kind IN {_ENGLISH} UNION ALL SELECT institution_id, 'minimumTOEFL', 1, CAST(80 + k % 40 AS DOUBLE) FROM v_served WHERE kind IN {_ENGLISH}),
v_score1 AS (SELECT institution_id, field, min(grade) AS g, min(v) FILTER (WHERE grade = 1) AS lo1, max(v) FILTER (WHERE grade = 1) AS hi1, min(v) FILTER (WHERE grade = 2) AS lo2, max(v) FILTER (WHERE grade = 2) AS hi2 FROM v_score0 GROUP BY ALL),
v_score AS (SELECT institution_id, field, CASE WHEN g = 1 THEN lo1 ELSE lo2 END AS lo, CASE WHEN g = 1 THEN hi1 ELSE hi2 END AS hi, g FROM v_score1),
v_due AS (SELECT institution_id, min(due) FILTER (WHERE due BETWEEN DATE '2026-08-01' AND DATE '2027-12-31') AS lo, max(due) FILTER (WHERE due BETWEEN DATE '2026-08-01' AND DATE '2027-12-31') AS hi FROM v_served WHERE kind IN ('deadlines', 'admissions', 'scholarships') GROUP BY institution_id),
v_policy AS (SELECT institution_id, arg_min(value, {{'rank': 1 - cds, 'page': page_id}}) AS value, max(cds) AS cds, CASE WHEN max(cds) = 1 THEN 0.95e0 ELSE 0.9e0 END AS confidence FROM (
  SELECT institution_id, page_id, value, CASE WHEN from_cds THEN 1 ELSE 0 END AS cds FROM v_candidate WHERE field = 'satPolicy') t GROUP BY institution_id),
v_strong AS (SELECT institution_id, arg_min(page_id, {{'rank': -confidence, 'page': page_id}}) AS page_id FROM v_spoken GROUP BY institution_id),
v_proposal AS (
  SELECT institution_id, field, {_WHOLE('value')} AS value, CASE WHEN cds = 1 THEN 'ACCEPT' ELSE 'REVIEW_REQUIRED' END AS verdict, '' AS errors, '' AS warnings, CASE WHEN cds = 1 THEN 'common_data_set' ELSE 'official_web' END AS source_type FROM v_price1 WHERE n = 1
  UNION ALL SELECT institution_id, field, CASE WHEN lo = hi THEN {_WHOLE('lo')} END, CASE WHEN g IS NULL OR lo <> hi THEN 'REJECT' WHEN g = 2 OR field = 'minimumTOEFL' THEN 'REVIEW_REQUIRED' ELSE 'ACCEPT' END,
    CASE WHEN g IS NULL THEN 'only per-section minimums found; the overall requirement is what the engine compares against' WHEN lo <> hi THEN 'conflicting overall minimums on the same page; requires review' ELSE '' END,
    CASE WHEN g = 2 AND lo = hi THEN 'the page does not say "overall"; confirm this is not a section minimum' ELSE '' END, 'official_web' FROM v_score
  UNION ALL SELECT institution_id, f, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) END, CASE WHEN lo = hi THEN 'REVIEW_REQUIRED' ELSE 'REJECT' END, CASE WHEN lo IS NULL THEN 'every candidate date falls outside the current cycle (2026-08-01..2027-12-31); the page is probably stale'
    WHEN lo <> hi THEN 'several in-cycle deadlines found; pick one in review' ELSE '' END, '', 'official_web' FROM v_due CROSS JOIN (SELECT unnest(['applicationDeadline', 'scholarshipDeadline']) AS f) t
  UNION ALL SELECT institution_id, 'satPolicy', value, 'ACCEPT', '', '', CASE WHEN cds = 1 THEN 'common_data_set' ELSE 'official_web' END FROM v_policy
  UNION ALL SELECT s.institution_id, field, value, 'REVIEW_REQUIRED', '', {_ISSUE}, 'official_web' FROM v_spoken s JOIN v_strong USING (institution_id, page_id))"""
REVIEW = f""", v_unspoken AS (SELECT institution_id, field, reason FROM v_flag WHERE state = 'UNKNOWN' {' '.join(
    f"UNION SELECT institution_id, f, 'the source is written for ' || replace(scope, '_', ' ') || ' applicants; ' || f || ' describes a first-year undergraduate and cannot be taken from it' FROM (SELECT *, unnest({lst(fields)}) AS f FROM v_r WHERE kind IN {kinds} AND scope NOT IN {tuple(signals.FIRST_YEAR_SCOPES)}) t"
    for kinds, fields in _REFUSED.items())})
SELECT institution_id, field, value, verdict, CASE WHEN errors <> '' THEN errors WHEN warnings <> '' THEN warnings END AS reason FROM v_proposal
UNION ALL SELECT institution_id, field, {_WHOLE('CAST(value AS DOUBLE)')}, 'EXCLUDED', excluded FROM v_money WHERE excluded IS NOT NULL
UNION ALL SELECT institution_id, field, value, 'UNROUTED', NULL FROM v_cds WHERE field IN ('sat25', 'sat75', 'admitRate')
UNION ALL SELECT DISTINCT institution_id, field, CAST(NULL AS VARCHAR), 'NO_EVIDENCE', reason FROM v_unspoken u WHERE NOT EXISTS (SELECT 1 FROM v_proposal p WHERE p.institution_id = u.institution_id AND p.field = u.field)"""
