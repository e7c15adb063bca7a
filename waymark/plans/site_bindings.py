"""Institution, URL, evidence and stored-JSON views on the given tables, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark import fixed, signals
from waymark.functions import scalar as S
from waymark.plans.bindings import table
from waymark.plans.oracle_match import lst

PATHS = [
    "/admissions", "/admissions/international/", "/tuition-and-fees", "/cost-of-attendance", "/financial-aid/scholarships", "/blog/2024/05/tuition-news",
    "/news/2023/admissions", "/transfer/apply", "/graduate/admissions", "/sitemap.xml", "/robots.txt", "/wp-json/feed", "/files/brochure.png",
    "/apply/deadlines", "/apply/first-year", "/academics/programs", "/ir/common-data-set", "/a/b/c/d/e/f/testing", "/english-language-requirements",
    "/Visiting-Students/apply", "/", "/study-abroad/apply", "/standardized-testing/tests",
]
TAILS = ["", "?page=2", "#top", "/", "", "", "?x=1#y"]
HOSTS = ["uni{i}.edu", "www.uni{i}.edu", "Apply.Uni{i}.edu", "uni{i}.edu.evil.com", "user:pw@uni{i}.edu", "uni{i}.edu:8443", "localhost", "10.0.0.{i}",
         "uni{i}.ac.uk", "uni{i}.edu:443", "xuni{i}.edu"]


def institutions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS institution_id", "concat('uni', s_suppkey) AS short_name", "concat('https://uni', s_suppkey, '.edu/') AS root_url",
        "array(concat('uni', s_suppkey, '.edu')) AS official_domains",
        "CASE WHEN s_suppkey % 3 = 0 THEN array(concat('.UNI', s_suppkey, '.ac.uk.'), concat('uni', s_suppkey, '.edu')) ELSE cast(array() AS array<string>) END AS trusted_subdomains",
    )


INSTITUTION_SQL = """
v_inst AS (SELECT s_suppkey AS institution_id, 'uni' || s_suppkey AS short_name, 'https://uni' || s_suppkey || '.edu/' AS root_url FROM supplier),
v_domain AS (SELECT institution_id, 'uni' || institution_id || '.edu' AS domain FROM v_inst UNION SELECT institution_id, 'uni' || institution_id || '.ac.uk' FROM v_inst WHERE institution_id % 3 = 0)"""


def site_urls(spark: SparkSession, sf: str) -> DataFrame:
    """One discovered URL per order, spread over the institutions."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    o = table(spark, sf, "orders").withColumn("i", F.col("o_custkey") % n)
    return o.selectExpr(
        "o_orderkey AS url_id", "i AS institution_id",
        f"""CASE WHEN o_orderkey % 101 = 0 THEN concat('not a url ', o_orderkey) ELSE concat(CASE WHEN o_orderkey % 13 = 0 THEN 'http' ELSE 'https' END, '://',
            replace({S.sql_pick(HOSTS, 'o_orderkey % 11')}, '{{i}}', cast(i AS string)), {S.sql_pick(PATHS, 'o_orderkey % 23')}, {S.sql_pick(TAILS, 'o_orderkey % 7')}) END AS url""",
    )


URL_SQL = f"""
v_url0 AS (SELECT o_orderkey AS k, o_custkey % (SELECT count(*) FROM supplier) AS i FROM orders),
v_url AS (SELECT k AS url_id, i AS institution_id, CASE WHEN k % 101 = 0 THEN 'not a url ' || k ELSE CASE WHEN k % 13 = 0 THEN 'http' ELSE 'https' END || '://' ||
  replace({lst(HOSTS)}[k % 11 + 1], '{{i}}', CAST(i AS VARCHAR)) || {lst(PATHS)}[k % 23 + 1] || {lst(TAILS)}[k % 7 + 1] END AS url FROM v_url0),
v_part0 AS (SELECT *, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+') AS parseable, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://[^/?#\\s]+', 1)) AS scheme,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS auth, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query FROM v_url),
v_part1 AS (SELECT *, lower(split_part(CASE WHEN contains(auth, '@') THEN split_part(auth, '@', 2) ELSE auth END, ':', 1)) AS host,
  CASE WHEN contains(auth, '@') THEN split_part(split_part(auth, '@', 2), ':', 2) ELSE split_part(auth, ':', 2) END AS port, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM v_part0),
v_part AS (SELECT *, ' ' || trim(regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g')) || ' ' AS hay, lower(path || query) AS target,
  CASE WHEN parseable THEN scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || query ELSE url END AS page_url,
  list_filter(list_transform(string_split(path, '/'), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS segs,
  len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth FROM v_part1)"""

SOURCE_TYPES = {"AF": "common_data_set", "AO": "official_pdf", "NF": "official_web", "NO": "government", "RF": "other_official", "RO": "official_web"}


def evidence_items(spark: SparkSession, sf: str) -> DataFrame:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_TYPES.items())
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS record_id", "concat('field', l_linenumber) AS field", "cast(l_quantity AS bigint) AS value",
        f"CASE concat(l_returnflag, l_linestatus) {arms} END AS source_type", "l_shipdate AS retrieved_at", "l_orderkey AS ordinal",
        "concat(year(l_shipdate), '-', lpad(cast((year(l_shipdate) + 1) % 100 AS string), 2, '0')) AS academic_year",
    )


EVIDENCE_SQL = f"""
v_ev AS (SELECT l_partkey AS record_id, 'field' || l_linenumber AS field, CAST(l_quantity AS BIGINT) AS value, CASE l_returnflag || l_linestatus {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_TYPES.items())} END AS source_type,
  l_shipdate AS retrieved_at, year(l_shipdate) || '-' || lpad(CAST((year(l_shipdate) + 1) % 100 AS VARCHAR), 2, '0') AS academic_year FROM lineitem),
v_evr AS (SELECT *, CASE source_type WHEN 'common_data_set' THEN 5 WHEN 'official_pdf' THEN 4 WHEN 'official_web' THEN 3 WHEN 'government' THEN 2 ELSE 1 END AS r FROM v_ev)"""


def stored_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Stored profile JSON per customer: valid, wrong types, wrong root, missing."""
    return table(spark, sf, "customer").withColumnRenamed("c_custkey", "k").selectExpr(
        "k AS profile_id",
        f"""CASE k % 8 WHEN 0 THEN 'null' WHEN 1 THEN '[]' WHEN 2 THEN '{{"budgetAnnualUSD":"5000","gpaValue":"high","preferredCountries":"USA","satTaken":"yes","aidNeed":7}}' WHEN 3 THEN '{{broken'
          ELSE concat('{{"name":"N', k, '","budgetAnnualUSD":', (k * 37) % 30000 - 500, ',"maxAffordableAnnualUSD":', (k * 11) % 20000, ',"gpaValue":', k % 130, ',"gpaScale":"', {S.sql_pick([*fixed.GPA_SCALES, '7.0'], 'k % 6')},
            '","satScore":', 300 + k % 1500, ',"englishScore":', k % 250, ',"intendedMajor":"', {S.sql_pick([*fixed.MAJORS, 'alchemy'], 'k % 18')}, '","aidNeed":"', {S.sql_pick([*fixed.AID_NEEDS, 'lots'], 'k % 5')},
            '","preferredCountries":["', {S.sql_pick(fixed.COUNTRIES, 'k % 15')}, '","Atlantis","', {S.sql_pick(fixed.COUNTRIES, '(k * 3) % 15')}, '",5],"satTaken":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
            ',"preferences":{{"research":', k % 140 - 20, ',"prestige":"x"}}}}') END AS json""",
    )


STORED_SQL = f"""
v_raw AS (SELECT c_custkey AS k, c_custkey % 8 >= 4 AS good FROM customer),
v_clean AS (SELECT k AS profile_id, CASE WHEN good THEN 'N' || k ELSE '' END AS name, CASE WHEN good THEN CAST(greatest(0, (k * 37) % 30000 - 500) AS DOUBLE) ELSE 10000e0 END AS budget_annual_usd,
  CASE WHEN good THEN CAST(greatest((k * 11) % 20000, (k * 37) % 30000 - 500, 0) AS DOUBLE) ELSE 15000e0 END AS max_affordable_annual_usd,
  CASE WHEN good AND k % 130 <= 100 THEN CAST(k % 130 AS DOUBLE) END AS gpa_value, CASE WHEN good AND k % 6 < 5 THEN {lst(fixed.GPA_SCALES)}[k % 6 + 1] ELSE '100' END AS gpa_scale,
  CASE WHEN good AND 300 + k % 1500 BETWEEN 400 AND 1600 THEN CAST(300 + k % 1500 AS DOUBLE) END AS sat_score, CASE WHEN good AND k % 250 <= 200 THEN CAST(k % 250 AS DOUBLE) END AS english_score,
  CASE WHEN good AND k % 18 < 17 THEN {lst(fixed.MAJORS)}[k % 18 + 1] ELSE 'computer-science' END AS intended_major, CASE WHEN good AND k % 5 < 4 THEN {lst(fixed.AID_NEEDS)}[k % 5 + 1] ELSE 'partial' END AS aid_need,
  CASE WHEN NOT good THEN '' WHEN k % 15 = (k * 3) % 15 THEN {lst(fixed.COUNTRIES)}[k % 15 + 1] ELSE {lst(fixed.COUNTRIES)}[k % 15 + 1] || '|' || {lst(fixed.COUNTRIES)}[(k * 3) % 15 + 1] END AS preferred_countries,
  NOT good AS open_to_any_country, good AND k % 2 = 0 AS sat_taken, CASE WHEN good THEN CAST(least(100, greatest(0, k % 140 - 20)) AS DOUBLE) ELSE 50e0 END AS research, 50e0 AS prestige FROM v_raw)"""


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """One proposal per (part, evidence field) with a value, issue flags and evidence count."""
    fields = S.sql_array(signals.EVIDENCE_FIELDS)
    return table(spark, sf, "part").selectExpr("p_partkey AS record_id", "p_size", f"posexplode({fields}) AS (fi, field)").selectExpr(
        "record_id", "field", "CASE WHEN (record_id + fi) % 6 <> 0 THEN cast(record_id * 10 + fi AS string) END AS value",
        "cast((record_id + fi * 3) % 4 AS int) AS evidence_count", "(record_id + fi) % 7 = 0 AS has_error", "(record_id + fi) % 5 = 0 AS has_warning",
        "cast((record_id * 7 + fi) % 101 AS double) / 100D AS confidence",
        "element_at(array('verified','derived','curated','unverified'), cast((record_id + fi) % 4 + 1 AS int)) AS status",
    )


PROPOSAL_SQL = f"""
v_prop AS (SELECT p_partkey AS record_id, field, CASE WHEN (p_partkey + fi) % 6 <> 0 THEN CAST(p_partkey * 10 + fi AS VARCHAR) END AS value, CAST((p_partkey + fi * 3) % 4 AS INTEGER) AS evidence_count,
  (p_partkey + fi) % 7 = 0 AS has_error, (p_partkey + fi) % 5 = 0 AS has_warning, CAST((p_partkey * 7 + fi) % 101 AS DOUBLE) / 100e0 AS confidence, ['verified','derived','curated','unverified'][(p_partkey + fi) % 4 + 1] AS status
  FROM part CROSS JOIN (SELECT unnest({lst(signals.EVIDENCE_FIELDS)}) AS field, unnest(range({len(signals.EVIDENCE_FIELDS)})) AS fi) f)"""
