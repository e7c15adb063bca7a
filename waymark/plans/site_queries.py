"""Keys for stored input, URL policy, registry, candidate ranking, evidence and governance."""

from __future__ import annotations


from pyspark.sql import Window, functions as F

from waymark import fixed, signals
from waymark.functions import scalar as S, urls as U
from waymark.operators import evidence as E, registry as R, sanitize as Z
from waymark.plans import bindings as B, oracle_match as O, site_bindings as V
from waymark.session import materialize, run_folder
from waymark.sources import files as SRC

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


URLS = O.with_(V.INSTITUTION_SQL, V.URL_SQL)
_CLEAN = ["profile_id", "name", "budget_annual_usd", "max_affordable_annual_usd", "gpa_value", "gpa_scale", "sat_score", "english_score", "intended_major",
          "aid_need", "open_to_any_country", "sat_taken"]


# ---- stored input ---------------------------------------------------------

@query("sanitize_profiles", O.with_(V.STORED_SQL) + "SELECT * FROM v_clean")
def sanitize_profiles(spark, sf):
    return Z.sanitize_profiles(V.stored_profiles(spark, sf)).select(
        *_CLEAN, F.array_join("preferred_countries", "|").alias("preferred_countries"),
        F.col("preferences.research").alias("research"), F.col("preferences.prestige").alias("prestige"),
    )


@query("sanitize_task_map", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'a' || event_id ELSE '' END ||
 CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN ',' ELSE '' END || 'b' ELSE '' END AS kept FROM events""")
def sanitize_task_map(spark, sf):
    raw = B.table(spark, sf, "events").selectExpr("event_id", """CASE WHEN event_id % 3 = 0 THEN '[1]' ELSE concat('{"a', event_id, '":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,
        ',"b":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE '1' END, ',"', repeat('k', 200), '":true,"":true}') END AS json""")
    return raw.select("event_id", F.array_join(Z.sanitize_task_map(F.col("json")), ",").alias("kept"))


@query("sanitize_id_list", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'id-' || event_id || ',u' || (event_id % 7) || ',c,d' END AS ids FROM events""")
def sanitize_id_list(spark, sf):
    raw = B.table(spark, sf, "events").selectExpr("event_id", """CASE WHEN event_id % 4 = 0 THEN '{"a":1}' ELSE concat('["id-', event_id, '","BAD ID","u', event_id % 7, '","id-', event_id, '",null,"c","d","e"]') END AS json""")
    return raw.select("event_id", F.array_join(Z.sanitize_id_list(F.col("json"), 4), ",").alias("ids"))


# ---- URLs -----------------------------------------------------------------

_NC = "CASE WHEN NOT parseable THEN 'unparseable URL' WHEN target = '/robots.txt' THEN " + O.q(signals.ROBOTS_REASON) + " " + " ".join(
    f"WHEN ends_with(target, '{e}') THEN '{e} is not a readable page'" for e in signals.ASSET_SUFFIXES) + " " + " ".join(
    f"""WHEN contains(' ' || trim(regexp_replace(target, '[^a-z0-9]+', ' ', 'g')) || ' ', ' {m} ') THEN '"{m}" marks a machine-readable index, not a page'""" for m in signals.INDEX_MARKERS) + " END"


@query("non_content_urls", URLS + f"SELECT url_id, {_NC} AS reason FROM v_part")
def non_content_urls(spark, sf):
    return V.site_urls(spark, sf).select("url_id", U.non_content_reason(F.col("url")).alias("reason"))


def _allowed(spark, sf):
    i = V.institutions(spark, sf)
    return i.select("institution_id", F.explode(R.allowed_domains(F.col("official_domains"), F.col("trusted_subdomains"))).alias("domain"))


_MATCH = "EXISTS (SELECT 1 FROM v_domain d WHERE d.institution_id = v_part.institution_id AND (host = domain OR ends_with(host, '.' || domain)))"
_POLICY = f"""CASE WHEN NOT parseable THEN 'unparseable URL' WHEN scheme <> 'https' THEN 'only https is permitted, got ' || scheme || ':' WHEN contains(auth, '@') THEN 'credentials in URL'
 WHEN port <> '' AND port <> '443' THEN 'non-standard port ' || port WHEN host = 'localhost' OR regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') THEN host || ' is not a public domain name'
 WHEN NOT {_MATCH} THEN host || ' is not an approved domain for this institution' END"""


@query("allowed_urls", URLS + f"SELECT url_id, {_POLICY} IS NULL AS ok, {_POLICY} AS reason FROM v_part")
def allowed_urls(spark, sf):
    return R.url_policy(V.site_urls(spark, sf), _allowed(spark, sf)).select("url_id", "ok", "reason")


@query("domain_suffix_join", URLS + f"SELECT DISTINCT institution_id, url FROM v_part WHERE {_MATCH}")
def domain_suffix_join(spark, sf):
    return R.domain_matches(V.site_urls(spark, sf), _allowed(spark, sf))


@query("domain_ok", """SELECT k, CASE WHEN NOT regexp_matches(d, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$') THEN 'not a domain name' WHEN regexp_matches(d, '^[0-9]+(\\.[0-9]+)*$') THEN 'looks like an IP address'
 WHEN ends_with(d, '.example') OR ends_with(d, '.local') THEN 'not a public domain' END AS reason FROM (SELECT p_partkey AS k, ['uni' || p_partkey || '.edu', 'a b.com', '10.0.0.' || (p_partkey % 250), 'x.example', 'plain', 'host.local', '-bad-.org'][p_partkey % 7 + 1] AS d FROM part) t""")
def domain_ok(spark, sf):
    d = B.table(spark, sf, "part").selectExpr("p_partkey AS k", "element_at(array(concat('UNI', p_partkey, '.edu'), 'a b.com', concat('10.0.0.', p_partkey % 250), 'x.example', 'plain', 'host.local', '-bad-.org'), cast(p_partkey % 7 + 1 AS int)) AS d")
    return d.select("k", U.domain_reason(F.col("d")).alias("reason"))


@query("url_parts", URLS + """SELECT url_id, host, path, array_to_string(segs, '|') AS segments, CASE WHEN NOT parseable THEN '' WHEN host = 'localhost' THEN host WHEN len(string_split(host, '.')) > 2 AND list_contains(['ac', 'edu', 'gov', 'co', 'or', 'ne', 'com'], string_split(host, '.')[-2])
 THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS registrable FROM v_part""")
def url_parts(spark, sf):
    u = F.col("url")
    return V.site_urls(spark, sf).select(
        "url_id", U.host(u).alias("host"), U.path(u).alias("path"), F.array_join(U.segments(u), "|").alias("segments"), U.registrable(U.host(u)).alias("registrable"),
    )


_REGISTRABLE = """CASE WHEN host = 'localhost' THEN host WHEN len(string_split(host, '.')) > 2 AND list_contains(['ac', 'edu', 'gov', 'co', 'or', 'ne', 'com'], string_split(host, '.')[-2])
 THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""


@query("url_variants", URLS + f""", v_reg AS (SELECT url_id, institution_id, host, path, string_split(host, '.') AS labels, {_REGISTRABLE} AS reg FROM v_part WHERE parseable),
v_var AS (SELECT url_id, institution_id, host, path, unnest(list_distinct(list_concat([CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE 'www.' || host END],
 flatten(list_transform(range(1, len(labels) - len(string_split(reg, '.')) + 1), lambda i: [array_to_string(labels[i + 1:], '.'), 'www.' || array_to_string(labels[i + 1:], '.')]))))) AS h FROM v_reg)
SELECT url_id, 'https://' || h || CASE WHEN path = '/' THEN '' ELSE path END AS variant,
 EXISTS (SELECT 1 FROM v_domain d WHERE d.institution_id = v_var.institution_id AND (h = domain OR ends_with(h, '.' || domain))) AS allowed FROM v_var WHERE contains(h, '.') AND h <> host""")
def url_variants(spark, sf):
    """Rewrites of every parseable URL, and whether they stay in the institution's domains."""
    return R.variants_with_status(V.site_urls(spark, sf), _allowed(spark, sf)).select("url_id", "variant", "allowed")


@query("url_distinct", URLS + "SELECT institution_id, page_url, min(url_id) AS url_id, count(*) AS copies FROM v_part GROUP BY ALL")
def url_distinct(spark, sf):
    return V.site_urls(spark, sf).withColumn("page_url", U.normalize(F.col("url"))).groupBy("institution_id", "page_url").agg(
        F.min("url_id").alias("url_id"), F.count(F.lit(1)).alias("copies"),
    )


@query("allowed_domain_union", O.with_(V.INSTITUTION_SQL) + "SELECT institution_id, string_agg(domain, ',' ORDER BY domain) AS domains, bool_or(domain = 'uni' || institution_id || '.ac.uk') AS already FROM v_domain GROUP BY institution_id")
def allowed_domain_union(spark, sf):
    i = V.institutions(spark, sf).withColumn("d", R.allowed_domains(F.col("official_domains"), F.col("trusted_subdomains")))
    return i.select("institution_id", F.array_join(F.array_sort("d"), ",").alias("domains"), F.array_contains("d", F.concat(F.lit("uni"), F.col("institution_id"), F.lit(".ac.uk"))).alias("already"))


# ---- URL-only candidate scoring ------------------------------------------

def _w(hay: str, terms) -> str:
    return "(" + " + ".join([f"CASE WHEN contains({hay}, ' {t} ') THEN {R.phrase_weight(t)}e0 ELSE 0e0 END" for t in terms] or ["0e0"]) + ")"


def _any(hay: str, terms) -> str:
    return "(" + " OR ".join(f"contains({hay}, ' {t} ')" for t in terms) + ")"


_LEVEL = "CASE " + " ".join(f"WHEN {_any('hay', t)} THEN '{n}'" for n, t in signals.SCOPE_MARKERS) + " ELSE 'unknown' END"
_ARTICLE = f"len(list_filter({O.lst(signals.ARTICLE_SEGMENTS)}, lambda a: list_contains(segs, a)))"


def _canon(kind: str) -> str:
    return f"len(list_filter({O.lst(signals.KIND_SIGNALS[kind]['canonical'])}, lambda c: len(list_filter(segs, lambda s: s = c OR starts_with(s, c || ' '))) > 0))"


def _candidate_rows(of: str = "v_aud", more: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT institution_id, url, url_id{more}, '{k}' AS kind, greatest(0e0, {_w('hay', sig['path'])} - CASE WHEN depth > 5 THEN 0.5e0 ELSE 0e0 END) AS relevance,
 CAST(CASE WHEN bad = 0 THEN least(4, {_canon(k)} * 2) ELSE greatest(-6, -4 - (bad - 1)) END + CASE WHEN regexp_matches(path, '/20[0-9][0-9]/') THEN -2 ELSE 0 END AS INTEGER) AS authority,
 {O.case_map('audience', signals.AUDIENCE_ADJUST) if sig['audience'] else '0'} AS adj, audience FROM {of}""" for k, sig in signals.KIND_SIGNALS.items())


CANDIDATE_SQL = f"""
v_lev AS (SELECT *, {_LEVEL} AS lev, {_any('hay', signals.INTERNATIONAL_MARKERS)} AS intl, {_ARTICLE} AS bad FROM v_part),
v_aud AS (SELECT *, CASE WHEN lev = 'first_year' THEN 'first_year' WHEN lev = 'general_undergraduate' THEN 'all_undergraduate' WHEN lev <> 'unknown' THEN lev WHEN intl THEN 'international' ELSE 'unknown' END AS audience FROM v_lev),
v_cand0 AS ({_candidate_rows()}), v_cand AS (SELECT *, relevance + authority + adj AS priority FROM v_cand0)"""
GUESSED_SQL = f"""
v_gpath AS (SELECT institution_id, url, kind AS own_kind, regexp_extract(url, '^https://[^/]*([^?#]*)', 1) AS path FROM v_guess),
v_gpart AS (SELECT *, ' ' || trim(regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g')) || ' ' AS hay, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth,
  list_filter(list_transform(string_split(path, '/'), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS segs FROM v_gpath),
v_glev AS (SELECT *, {_LEVEL} AS lev, {_any('hay', signals.INTERNATIONAL_MARKERS)} AS intl, {_ARTICLE} AS bad, 0 AS url_id FROM v_gpart),
v_gaud AS (SELECT *, CASE WHEN lev = 'first_year' THEN 'first_year' WHEN lev = 'general_undergraduate' THEN 'all_undergraduate' WHEN lev <> 'unknown' THEN lev WHEN intl THEN 'international' ELSE 'unknown' END AS audience FROM v_glev),
v_gcand AS (SELECT institution_id, url, kind, relevance + authority + adj AS priority FROM ({_candidate_rows('v_gaud', ', own_kind')}) g WHERE kind = own_kind)"""
CANDS = O.with_(V.INSTITUTION_SQL, V.URL_SQL, CANDIDATE_SQL)


def _scored(spark, sf):
    return R.candidate_scores(V.site_urls(spark, sf))


@query("path_relevance", CANDS + "SELECT url_id, kind, relevance FROM v_cand WHERE relevance > 0")
def path_relevance(spark, sf):
    return _scored(spark, sf).where(F.col("relevance") > 0).select("url_id", "kind", "relevance")


@query("path_authority", CANDS + "SELECT url_id, kind, authority FROM v_cand")
def path_authority(spark, sf):
    return _scored(spark, sf).select("url_id", "kind", F.col("authority").cast("int").alias("authority"))


@query("candidate_priority", CANDS + "SELECT url_id, kind, audience, priority FROM v_cand")
def candidate_priority(spark, sf):
    return _scored(spark, sf).select("url_id", "kind", "audience", F.col("priority").cast("double").alias("priority"))


_UNIQ = "v_uniq AS (SELECT institution_id, url, kind, any_value(relevance) AS relevance, any_value(priority) AS priority FROM v_cand GROUP BY ALL HAVING any_value(relevance) > 0), v_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institution_id, kind ORDER BY priority DESC, length(url), url) AS kind_rank FROM v_uniq) x WHERE kind_rank <= 4)"


def _top(spark, sf):
    urls = V.site_urls(spark, sf).select("institution_id", "url").distinct()
    return R.top_per_kind(R.candidate_scores(urls))


@query("top_candidates_per_kind", CANDS + ", " + _UNIQ + " SELECT institution_id, kind, CAST(kind_rank AS INTEGER) AS kind_rank, url, CAST(priority AS DOUBLE) AS priority FROM v_top")
def top_candidates_per_kind(spark, sf):
    return _top(spark, sf).select("institution_id", "kind", "kind_rank", "url", F.col("priority").cast("double").alias("priority"))


_GUESS = f"v_guess AS (SELECT i.institution_id, g.kind, 'https://uni' || i.institution_id || '.edu' || g.path AS url FROM v_inst i CROSS JOIN (VALUES {', '.join(f'({O.q(k)}, {O.q(p)})' for k, ps in signals.CANDIDATE_PATHS.items() for p in ps)}) g(kind, path) WHERE NOT EXISTS (SELECT 1 FROM (SELECT institution_id, kind FROM v_top WHERE priority >= 2 GROUP BY ALL HAVING count(*) >= 3) s WHERE s.institution_id = i.institution_id AND s.kind = g.kind))"


@query("guess_paths", CANDS + ", " + _UNIQ + ", " + _GUESS + " SELECT * FROM v_guess")
def guess_paths(spark, sf):
    return R.guess_paths(V.institutions(spark, sf), _top(spark, sf))


_GUESS_SQL = O.with_(V.INSTITUTION_SQL, V.URL_SQL, CANDIDATE_SQL, _UNIQ, _GUESS, GUESSED_SQL, """v_both AS (SELECT institution_id, url, kind, priority, 0 AS tier FROM v_top UNION ALL SELECT institution_id, url, kind, priority, 1 FROM v_gcand),
v_m AS (SELECT institution_id, url, max(priority) AS priority, min(tier) AS tier, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM v_both GROUP BY ALL)""")


@query("fetch_order", _GUESS_SQL + "SELECT institution_id, url, tier, CAST(priority AS DOUBLE) AS priority, kinds, CAST(n AS INTEGER) AS fetch_rank FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY tier, priority DESC, url) AS n FROM v_m) x WHERE n <= 45")
def fetch_order(spark, sf):
    # what is published is ranked once, and tells which paths are guessed
    top = materialize(_top(spark, sf), "top-candidates").withColumn("tier", F.lit(R.DISCOVERED))
    guessed = R.guess_paths(V.institutions(spark, sf), top).dropna().distinct()
    scored = R.candidate_scores(guessed).withColumn("tier", F.lit(R.GUESSED))
    columns = ["institution_id", "url", "kind", "priority", "tier"]
    out = R.fetch_order(top.select(*columns).unionByName(scored.select(*columns)))
    return out.select("institution_id", "url", "tier", F.col("priority").cast("double").alias("priority"), F.array_join("kinds", ",").alias("kinds"), "fetch_rank")


@query("term_hits", "WITH h AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS hay FROM documents) " + " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS term_group, {_w('hay', t)} AS weight FROM h WHERE {_any('hay', t)}" for g, t in {"short": ["the", "la", "der", "el", "of the"], "links": ["and", "que", "und", "et"]}.items()))
def term_hits(spark, sf):
    return R.term_hits(B.table(spark, sf, "documents").select("doc_id", "text"), {"short": ["the", "la", "der", "el", "of the"], "links": ["and", "que", "und", "et"]})


# ---- pages as given -------------------------------------------------------

@query("scan_pages", "SELECT page_id, url, octet_length(encode(html)) AS bytes, sha256(html) AS content_hash FROM pages")
def scan_pages(spark, sf):
    return B.table(spark, sf, "pages").select(
        "page_id", "url", F.octet_length("html").cast("bigint").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"),
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("challenge_pages", "SELECT page_id, contains(lower(html), 'just a moment...') OR (contains(lower(html), 'captcha') AND length(html) < 6000) AS challenge FROM (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN 'Just a moment...' WHEN 1 THEN 'CAPTCHA' ELSE '' END AS html FROM pages) t")
def challenge_pages(spark, sf):
    marked = B.table(spark, sf, "pages").selectExpr("page_id", "concat(html, CASE page_id % 5 WHEN 0 THEN 'Just a moment...' WHEN 1 THEN 'CAPTCHA' ELSE '' END) AS html")
    return marked.select("page_id", R.challenge(F.col("html")).alias("challenge"))


@query("sitemap_entries", "SELECT o_custkey AS site, 'https://s' || o_custkey || '.edu/p?a=' || o_orderkey || '&b=1' AS loc, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod, CASE WHEN o_custkey % 2 = 0 THEN 'urlset' ELSE 'index' END AS root_kind FROM orders")
def sitemap_entries(spark, sf):
    entry = F.expr("""concat('<', t, '>\n <loc> https://s', o_custkey, '.edu/p?a=', o_orderkey, '&amp;b=1 </loc>', CASE WHEN o_orderkey % 2 = 0 THEN concat('<lastmod>', date_format(o_orderdate, 'yyyy-MM-dd'), '</lastmod>') ELSE '' END, '</', t, '>')""")
    o = B.table(spark, sf, "orders").withColumn("t", F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'url' ELSE 'sitemap' END")).withColumn("e", entry)
    docs = o.groupBy(F.col("o_custkey").alias("site"), F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(F.concat(
        F.lit("<?xml version='1.0'?><"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'urlset' ELSE 'sitemapindex' END"), F.lit(">"), F.array_join(F.collect_list("e"), "\n"), F.lit("</end>"),
    ).alias("xml"))
    return SRC.sitemap_entries(docs).select("site", "loc", "lastmod", "root_kind")


@query("robots_sitemaps", "SELECT s_suppkey AS host, 'https://h' || s_suppkey || '.edu/sitemap.xml' AS sitemap_url FROM supplier UNION ALL SELECT s_suppkey, 'https://h' || s_suppkey || '.edu/news.xml' FROM supplier WHERE s_suppkey % 2 = 0")
def robots_sitemaps(spark, sf):
    docs = B.table(spark, sf, "supplier").selectExpr("s_suppkey AS host", r"concat('User-agent: *\nDisallow: /x # sitemap: no\n  Sitemap : https://h', s_suppkey, '.edu/sitemap.xml\n', CASE WHEN s_suppkey % 2 = 0 THEN concat('SITEMAP:https://h', s_suppkey, '.edu/news.xml trailing\n') ELSE '' END) AS text")
    return SRC.robots_sitemaps(docs)


# ---- registry -------------------------------------------------------------

@query("registry_merge", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'https://u' || s_suppkey || '.edu/t' END AS tuition_url, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_suppkey || '.edu,old' || s_suppkey || '.edu' ELSE 'd' || s_suppkey || '.edu' END AS official,
 CASE WHEN s_suppkey % 2 = 0 THEN 'complete' ELSE 'pending' END AS discovery_status FROM supplier""")
def registry_merge(spark, sf):
    s = B.table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id")
    built = s.selectExpr("id", "map('tuition', cast(null AS string), 'deadlines', cast(null AS string)) AS pages", "array(concat('d', id, '.edu')) AS official_domains", "cast(array() AS array<string>) AS trusted_subdomains", "'pending' AS discovery_status")
    old = s.where("id % 2 = 0").selectExpr("id", "map('tuition', concat('https://u', id, '.edu/t'), 'deadlines', concat('https://u', id, '.edu/sitemap.xml')) AS pages", "array(concat('old', id, '.edu')) AS official_domains", "cast(array() AS array<string>) AS trusted_subdomains", "'complete' AS discovery_status")
    merged = R.merge_registry(built, old)
    return merged.select("id", F.element_at("pages", "tuition").alias("tuition_url"), F.array_join("official_domains", ",").alias("official"), "discovery_status")


@query("scan_registry_json", "SELECT 'u' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'uni' || s_suppkey || '.edu' ELSE 'legacy' || s_suppkey || '.edu' END AS allowed FROM supplier")
def scan_registry_json(spark, sf):
    lines = B.table(spark, sf, "supplier").selectExpr("""concat('{"version":1,"universities":[{"id":"u', s_suppkey, '",', CASE WHEN s_suppkey % 2 = 0 THEN concat('"officialDomains":["UNI', s_suppkey, '.edu"]') ELSE concat('"allowedDomains":["legacy', s_suppkey, '.edu"]') END, ',"pages":{"tuition":null}}]}') AS value""")
    path = run_folder(spark, "registry")
    lines.write.text(path)
    return SRC.read_registry(spark, path).select("id", F.array_join("allowedDomains", ",").alias("allowed"))


@query("link_inventory", O.with_(O.PROFILE, O.OPTION) + "SELECT url, used, count(*) OVER (PARTITION BY url) AS uses FROM (SELECT official_url AS url, option_id || '.officialUrl' AS used FROM v_option UNION ALL SELECT 'https://aid.example.org/' || (option_id % 10), option_id || '.scholarshipUrl' FROM v_option) t")
def link_inventory(spark, sf):
    """Every use of a link, with how often its URL is used; a URL that many share stays rows."""
    o = B.options(spark, sf).select(F.inline(F.array(
        F.struct(F.col("official_url").alias("url"), F.concat(F.col("option_id").cast("string"), F.lit(".officialUrl")).alias("used")),
        F.struct(F.concat(F.lit("https://aid.example.org/"), (F.col("option_id") % 10).cast("string")).alias("url"), F.concat(F.col("option_id").cast("string"), F.lit(".scholarshipUrl")).alias("used")),
    )))
    return o.join(o.groupBy("url").agg(F.count(F.lit(1)).alias("uses")), "url")


@query("host_relatedness_join", """SELECT k, host, host_kind = 0 AND k >= 0 AS related FROM (SELECT s_suppkey AS k, unnest(['www.mit.edu', 'apply.mitsubishi.edu', 'mit.com', 'x.ac.uk']) AS host, unnest([0, 1, 2, 3]) AS host_kind FROM supplier) t""")
def host_relatedness_join(spark, sf):
    s = B.table(spark, sf, "supplier")
    hosts = s.selectExpr("s_suppkey AS institution_id", "explode(array('www.mit.edu', 'apply.mitsubishi.edu', 'mit.com', 'x.ac.uk')) AS host")
    tokens = s.selectExpr("s_suppkey AS institution_id", "explode(array('mitadmissions', concat('uni', s_suppkey))) AS token")
    return R.related_hosts(hosts, tokens).select(F.col("institution_id").alias("k"), "host", "related")


@query("domain_candidates", """WITH l AS (SELECT l_suppkey AS i, CASE l_linenumber WHEN 1 THEN 'www.mit.edu' WHEN 2 THEN 'news.org' WHEN 3 THEN 'uni' || l_suppkey || '.edu' ELSE 'h' || l_linenumber || '.com' END AS host FROM lineitem)
SELECT i AS institution_id, host, count(*) AS occurrences, CASE WHEN host = 'www.mit.edu' THEN 'candidate' ELSE 'external' END AS bucket FROM l WHERE host <> 'uni' || i || '.edu' GROUP BY ALL""")
def domain_candidates(spark, sf):
    li = B.table(spark, sf, "lineitem").selectExpr("l_suppkey AS institution_id", "l_orderkey AS page_id", """concat('<p><a class="x" href="https://', CASE l_linenumber WHEN 1 THEN 'www.mit.edu' WHEN 2 THEN 'news.org' WHEN 3 THEN concat('uni', l_suppkey, '.edu') ELSE concat('h', l_linenumber, '.com') END, '/p', l_linenumber, '">t</a><a href="http://plain.org/">no</a>') AS html""")
    s = B.table(spark, sf, "supplier")
    allowed = s.selectExpr("s_suppkey AS institution_id", "concat('uni', s_suppkey, '.edu') AS domain")
    tokens = s.selectExpr("s_suppkey AS institution_id", "'mit' AS token")
    return R.linked_hosts(li, allowed, tokens).select("institution_id", "host", "occurrences", "bucket")


@query("fetch_manifest", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'not a page: .xml is not a readable page' WHEN page_id % 4 = 1 THEN 'blocked: evil.com is not an approved domain for this institution' WHEN page_id % 4 = 2 THEN 'bot challenge page, not real content' END AS failure,
 CASE WHEN page_id % 4 = 3 THEN sha256(html) END AS content_hash FROM pages""")
def fetch_manifest(spark, sf):
    p = B.table(spark, sf, "pages").selectExpr("page_id AS institution_id", "page_id % 4 AS m", "html").selectExpr(
        "institution_id", "'tuition' AS kind", "concat('https://', CASE m WHEN 1 THEN 'evil.com' ELSE 'ok.edu' END, '/p', institution_id, CASE m WHEN 0 THEN '.xml' ELSE '' END) AS url",
        "CASE m WHEN 2 THEN concat(html, '__cf_chl') ELSE html END AS html", "'text/html' AS content_type")
    policy = R.url_policy(p.select("institution_id", "url"), p.selectExpr("institution_id", "'ok.edu' AS domain"))
    return R.fetch_manifest(p.select("institution_id", "kind", "url"), p.select("url", "html", "content_type"), policy).select(
        F.col("institution_id").alias("page_id"), "failure", "content_hash",
    )


# ---- evidence -------------------------------------------------------------

EV, PROP = O.with_(V.EVIDENCE_SQL), O.with_(V.PROPOSAL_SQL)


@query("primary_evidence", EV + "SELECT record_id, field, arg_max(source_type, r) AS source_type, max(retrieved_at) FILTER (WHERE r = m) AS retrieved_at FROM (SELECT *, max(r) OVER (PARTITION BY record_id, field) AS m FROM v_evr) t GROUP BY record_id, field")
def primary_evidence(spark, sf):
    return E.primary_evidence(V.evidence_items(spark, sf), ["record_id", "field"]).select("record_id", "field", "primary.source_type", "primary.retrieved_at")


@query("reconcile_sources", EV + """
, t AS (SELECT *, max(r) OVER w AS mr FROM v_evr WINDOW w AS (PARTITION BY record_id, field)), u AS (SELECT *, max(academic_year) FILTER (WHERE r = mr) OVER (PARTITION BY record_id, field) AS my FROM t)
SELECT record_id, field, count(*) AS sources, CASE WHEN count(DISTINCT value) = 1 THEN max(value) WHEN count(DISTINCT value) FILTER (WHERE r = mr AND academic_year = my) = 1 THEN max(value) FILTER (WHERE r = mr AND academic_year = my) END AS winner,
 CASE WHEN count(DISTINCT value) = 1 THEN 'sources agree' WHEN count(DISTINCT value) FILTER (WHERE r = mr AND academic_year = my) > 1 THEN 'equally authoritative sources disagree; escalating to human review'
  WHEN count(DISTINCT value) FILTER (WHERE r = mr) = 1 THEN 'higher source type' ELSE 'newer academic year' END AS reason FROM u GROUP BY record_id, field""")
def reconcile_sources(spark, sf):
    return E.reconcile(V.evidence_items(spark, sf))


@query("derive_status", PROP + """SELECT record_id, CASE WHEN bool_or(value IS NULL) OR bool_or(status = 'unverified') THEN 'unverified' WHEN bool_or(status = 'curated') THEN 'curated' ELSE 'derived' END AS status,
 CASE WHEN NOT (bool_or(value IS NULL) OR bool_or(status = 'unverified')) THEN CAST(sum(CAST(value AS BIGINT)) AS BIGINT) END AS value, count(*) AS inputs, CAST(sum(evidence_count) AS BIGINT) AS evidence_count FROM v_prop WHERE field IN ('tuition', 'livingCost') GROUP BY record_id""")
def derive_status(spark, sf):
    parts = V.proposals(spark, sf).where(F.col("field").isin("tuition", "livingCost")).withColumn("value", F.col("value").cast("bigint"))
    return E.derive(parts)


@query("verified_value_issues", PROP + """, i AS (SELECT record_id, field, list_filter([CASE WHEN status = 'unverified' AND value IS NOT NULL THEN 'status is unverified but a value is present; unverified values must be null' END,
 CASE WHEN status = 'verified' AND evidence_count = 0 THEN 'status is verified but no evidence is attached' END, CASE WHEN status = 'verified' AND value IS NULL THEN 'status is verified but the value is null' END,
 CASE WHEN status = 'derived' THEN 'status is derived but no source fields are recorded' END, CASE WHEN evidence_count >= 1 AND has_error THEN 'evidence[0] url is not https: http://x.edu' END,
 CASE WHEN evidence_count >= 1 AND has_warning THEN 'evidence[0] academicYear "2026" is not in YYYY-YY form' END], lambda x: x IS NOT NULL) AS items FROM v_prop)
SELECT record_id, field, array_to_string(items, ' | ') AS issues FROM i WHERE len(items) > 0""")
def verified_value_issues(spark, sf):
    item = F.struct(
        F.when(F.col("has_error"), "http://x.edu").otherwise("https://x.edu").alias("url"), F.lit("2026-09-01T00:00:00Z").alias("retrieved_at"),
        F.when(F.col("has_warning"), "2026").otherwise("2026-27").alias("academic_year"),
    )
    good = F.struct(F.lit("https://x.edu").alias("url"), F.lit("2026-09-01T00:00:00Z").alias("retrieved_at"), F.lit("2026-27").alias("academic_year"))
    values = V.proposals(spark, sf).withColumns({
        "evidence": F.slice(F.array(item, good, good), F.lit(1), F.col("evidence_count")), "derived_from": S.str_array([]),
    })
    return E.value_issues(values).where(F.size("issues") > 0).select("record_id", "field", F.array_join("issues", " | ").alias("issues"))


_VERDICT = "CASE WHEN has_error THEN 'REJECT' WHEN evidence_count = 0 THEN 'REJECT' WHEN has_warning OR confidence < 0.9 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPT' END"


@query("verdict", PROP + f"SELECT record_id, field, {_VERDICT} AS verdict FROM v_prop")
def verdict(spark, sf):
    return V.proposals(spark, sf).select("record_id", "field", E.verdict(F.col("has_error"), F.col("evidence_count") > 0, F.col("has_warning"), F.col("confidence")).alias("verdict"))


_WANTED = "SELECT p_partkey AS record_id, unnest(['tuition', 'satPolicy', 'nonsense']) AS field FROM part"


def _approval_events(spark, sf):
    wanted = B.table(spark, sf, "part").selectExpr("p_partkey AS record_id", "explode(array('tuition', 'satPolicy', 'nonsense')) AS field")
    return E.approve(V.proposals(spark, sf), wanted, F.lit("2026-09-01 00:00:00").cast("timestamp"), "reviewer", confirm=True)


APPROVED = PROP + f""", v_app AS (SELECT w.record_id, w.field, CASE WHEN p.field IS NULL THEN 'no such proposal' WHEN evidence_count = 0 THEN 'no evidence attached' WHEN value IS NULL THEN 'value is null' END AS reason, value
 FROM ({_WANTED}) w LEFT JOIN v_prop p ON p.record_id = w.record_id AND p.field = w.field)"""


@query("approve", APPROVED + " SELECT record_id, field, CASE WHEN reason IS NULL THEN value END AS value, reason IS NULL AS accepted, reason FROM v_app")
def approve(spark, sf):
    return _approval_events(spark, sf).select("record_id", "field", "value", "accepted", "reason")


@query("approved_history", APPROVED + " SELECT record_id, field, value AS approved_value FROM v_app WHERE reason IS NULL")
def approved_history(spark, sf):
    base = run_folder(spark, "stages")
    events = _approval_events(spark, sf)
    path = SRC.append_approved(events, base, confirm=True)
    return E.latest_approved(spark.read.parquet(path))


@query("stage_layout", PROP + f"SELECT stage, count(*) AS n FROM (SELECT 'raw' AS stage FROM pages UNION ALL SELECT 'extracted' FROM v_prop) t GROUP BY stage")
def stage_layout(spark, sf):
    base = run_folder(spark, "stages")
    raw = SRC.write_stage(B.table(spark, sf, "pages").select("page_id", "url", "html"), base, "raw")
    extracted = SRC.write_stage(V.proposals(spark, sf).select("record_id", "field"), base, "extracted")
    one = spark.read.parquet(raw).select(F.lit("raw").alias("stage"))
    return one.unionByName(spark.read.parquet(extracted).select(F.lit("extracted").alias("stage"))).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


_OV = APPROVED.replace("WITH ", "WITH " + O.PROFILE + "," + O.OPTION + ",", 1) + f""", v_long AS ({' UNION ALL '.join(f"SELECT option_id, '{f}' AS field, {e} AS current_value FROM v_option" for f, e in {
    'tuition': 'CAST(tuition AS VARCHAR)', 'livingCost': 'CAST(living_cost AS VARCHAR)', 'minimumIELTS': "CASE WHEN minimum_ielts IS NOT NULL THEN " + O.num('minimum_ielts') + " END", 'satPolicy': 'sat_policy',
    'applicationDeadline': 'CAST(application_deadline AS VARCHAR)', 'scholarshipDeadline': 'CAST(scholarship_deadline AS VARCHAR)', 'applicationPlatform': 'application_platform', 'fullRidePossible': 'CAST(full_ride_possible AS VARCHAR)',
    'fullTuitionPossible': 'CAST(full_tuition_possible AS VARCHAR)', 'needBasedAidForInternationals': 'CAST(need_based_aid AS VARCHAR)', 'aidCertainty': 'aid_certainty'}.items())}),
v_over AS (SELECT l.*, a.value AS approved_value FROM v_long l LEFT JOIN (SELECT * FROM v_app WHERE reason IS NULL) a ON a.record_id = l.option_id AND a.field = l.field)"""


@query("approved_overlay", _OV + " SELECT option_id, field, current_value, approved_value, coalesce(approved_value, current_value) AS effective_value, CASE WHEN approved_value IS NULL THEN 'curated' ELSE 'verified' END AS status FROM v_over")
def approved_overlay(spark, sf):
    return E.overlay(B.options(spark, sf), E.latest_approved(_approval_events(spark, sf)))


@query("approved_diff", _OV + " SELECT option_id, field, current_value, approved_value FROM v_over WHERE current_value <> approved_value")
def approved_diff(spark, sf):
    return E.overlay(B.options(spark, sf), E.latest_approved(_approval_events(spark, sf))).where(F.col("current_value") != F.col("approved_value")).select(
        "option_id", "field", "current_value", "approved_value",
    )


def _page_changes(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))
    known = pages.where("page_id % 3 <> 0").select("url", F.when(F.col("page_id") % 4 == 0, F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"), F.col("page_id").alias("ordinal"))
    return pages, E.hash_changes(pages, known)


_HASH = """WITH k AS (SELECT url, arg_min(CASE WHEN page_id % 4 = 0 THEN 'stale' ELSE sha256(html) END, page_id) AS known FROM pages WHERE page_id % 3 <> 0 GROUP BY url),
c AS (SELECT p.page_id, p.url, coalesce(known <> sha256(html), false) AS changed FROM pages p LEFT JOIN k USING (url))"""


@query("hash_change_join", _HASH + " SELECT page_id, changed FROM c")
def hash_change_join(spark, sf):
    return _page_changes(spark, sf)[1].select("page_id", "changed")


@query("freshness_report", _HASH + " SELECT CASE WHEN page_id % 10 = 9 THEN 'unconfigured' WHEN NOT starts_with(url, 'https:') THEN 'broken' WHEN changed THEN 'review' ELSE 'current' END AS freshness, count(*) AS n FROM c GROUP BY ALL")
def freshness_report(spark, sf):
    changed = _page_changes(spark, sf)[1]
    failure = F.when(U.scheme(F.col("url")) != "https", F.lit("only https is permitted"))
    rows = changed.withColumn("failure", failure).withColumn("url", F.when(F.col("page_id") % 10 != 9, F.col("url")))
    return E.freshness(rows).groupBy("freshness").agg(F.count(F.lit(1)).alias("n"))


@query("report_sink", ORACLES["freshness_report"])
def report_sink(spark, sf):
    path = run_folder(spark, "report")
    SRC.write_report(freshness_report(spark, sf), path)
    return spark.read.schema("freshness string, n bigint").json(path)


@query("evidence_coverage", PROP + f"SELECT record_id, count(*) FILTER (WHERE status = 'verified') AS verified, 13 AS total, CAST({O.rnd('CAST(count(*) FILTER (WHERE status = ' + chr(39) + 'verified' + chr(39) + ') AS DOUBLE) / 13e0 * 100e0')} AS INTEGER) AS percent FROM v_prop GROUP BY record_id")
def evidence_coverage(spark, sf):
    return E.evidence_coverage(B.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id")), V.proposals(spark, sf))


@query("coverage_groups", O.with_(O.PROFILE, O.OPTION) + """, b AS (SELECT *, coalesce(tuition, 0) + coalesce(living_cost, 0) AS c FROM v_option), r AS (SELECT 'country' AS grouping, country AS key FROM b UNION ALL SELECT 'region', region FROM b UNION ALL SELECT 'aid_certainty', aid_certainty FROM b
 UNION ALL SELECT 'cost_band', CASE WHEN c < 5000 THEN '<5k' WHEN c < 15000 THEN '5-15k' WHEN c < 30000 THEN '15-30k' WHEN c < 50000 THEN '30-50k' ELSE '50k+' END FROM b) SELECT grouping, key, count(*) AS n, count(*) = 1 AS singleton FROM r GROUP BY ALL""")
def coverage_groups(spark, sf):
    return E.coverage(B.options(spark, sf))


@query("country_counts", O.with_(O.PROFILE, O.OPTION) + "SELECT p.profile_id, (SELECT count(*) FROM v_option o WHERE list_contains(p.preferred_countries, o.country)) AS in_scope FROM v_profile p")
def country_counts(spark, sf):
    counts = B.options(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    wish = B.profiles(spark, sf).select("profile_id", F.explode_outer("preferred_countries").alias("country"))
    from waymark.operators.pairs import checked_broadcast
    return wish.join(checked_broadcast(counts), "country", "left").groupBy("profile_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_scope"))


def _picked(values, index: str) -> str:
    """One of the values by a row's number, in the words of both engines."""
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: What the given tables don't have, from the supplier's number: sources and dates of facts, highlights, a TOEFL minimum.
_GRADED = ["curated", "unverified", "guessed"]
_FACTS = {
    "compiled_on": "CASE WHEN k % 41 = 0 THEN '2026-02-30' WHEN k % 43 = 0 THEN '2026/03/01' WHEN k % 47 <> 0 THEN concat('2026-03-', CAST(10 + k % 19 AS {text})) END",
    **{f"{what}_source": f"CASE WHEN k % {n} = 0 THEN {_picked(_GRADED, '(k % 3)')} ELSE 'estimated' END" for what, n in (("requirements", 11), ("costs", 13), ("deadlines", 17), ("aid", 19))},
    "tuition_note": "CASE WHEN k % 2 = 0 THEN 'No tuition is charged.' END", "first_highlight": "CASE WHEN k % 37 <> 0 THEN concat('Highlight ', CAST(k AS {text})) END",
    "minimum_toefl": "CASE WHEN k % 5 <> 0 THEN 25 + (k * 3) % 110 END",
}
_RIDE, _SOURCES = "coalesce(full_ride_possible, false)", fixed.CONFIDENCES
#: Rules of a row in the words of both engines; a null value breaks only rules that ask for one.
_RULES = {
    **{f"{c}_filled": f"coalesce(length({c}), 0) > {n}" for c, n in (("name", 2), ("short_name", 1), ("city", 1), ("aid_note", 20), ("selectivity_note", 10), ("application_platform", 2), ("first_highlight", 0))},
    "url_safe_id": "{match}(CAST(option_id AS {text}), '^[a-z0-9-]+$')", "known_country": "known_country", "known_region": "known_region",
    "has_languages": "{size}(languages_of_instruction) > 0", "has_programs": "{size}(programs) > 0", "has_majors": "{size}(supported_majors) > 0",
    "known_majors": "unknown_majors = 0", "distinct_majors": "distinct_majors = {size}(supported_majors)",
    "dated_facts": "coalesce({match}(compiled_on, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'), false) AND try_cast(compiled_on AS DATE) IS NOT NULL",
    **{f"known_{w}_source": f"{w}_source IN ({', '.join(map(O.q, _SOURCES))})" for w in ("requirements", "costs", "deadlines", "aid")},
    "costs_are_estimates": "costs_source = 'estimated' AND tuition_confidence = 'estimated' AND living_confidence = 'estimated'",
    "unverified_is_null": "NOT (tuition_confidence = 'unverified' AND tuition IS NOT NULL)", "unverified_living_is_null": "NOT (living_confidence = 'unverified' AND living_cost IS NOT NULL)",
    "zero_is_explained": "NOT (tuition = 0 AND tuition_note IS NULL)", "money_range": "tuition BETWEEN 0 AND 149999", "living_range": "living_cost BETWEEN 0 AND 149999",
    **{f"{c}_range": f"{c} BETWEEN {low} AND {high}" for c, low, high in (
        ("minimum_ielts", 4, 9), ("recommended_ielts", 4, 9), ("minimum_toefl", 30, 120), ("minimum_sat", 400, 1600), ("recommended_sat", 400, 1600), ("research_intensity", 1, 5), ("prestige_tier", 1, 5))},
    "ielts_half_band": "minimum_ielts * 2 = floor(minimum_ielts * 2)", "recommended_ielts_half_band": "recommended_ielts * 2 = floor(recommended_ielts * 2)",
    "gpa_range": "gpa_expectation > 50 AND gpa_expectation <= 100", "ielts_order": "minimum_ielts <= recommended_ielts", "sat_order": "minimum_sat <= recommended_sat",
    **{f"{c}_in_cycle": f"{c}_deadline BETWEEN DATE '2026-09-01' AND DATE '2027-12-31'" for c in ("application", "scholarship")},
    "known_aid_certainty": f"coalesce(aid_certainty IN ({', '.join(map(O.q, fixed.AID_CERTAINTIES))}), false)", "ride_covers_tuition": f"NOT {_RIDE} OR coalesce(full_tuition_possible, false)",
    "minimal_aid_no_ride": f"NOT (aid_certainty = 'minimal' AND {_RIDE})", "need_met_needs_aid": f"aid_certainty <> 'meets-full-need' OR (coalesce(need_based_aid, false) AND {_RIDE})",
    "rare_aid_no_ride": f"NOT (scholarship_availability = 'rare-for-international' AND {_RIDE})",
}
_SPARK, _DUCK = {"text": "string", "size": "size", "match": "regexp_like"}, {"text": "VARCHAR", "size": "len", "match": "regexp_matches"}
_FACT_SQL = ", v_fact AS (SELECT *, " + ", ".join(f"{x.format(**_DUCK)} AS {n}" for n, x in _FACTS.items()) + f""", country IN (SELECT n_name FROM nation) AS known_country, region IN (SELECT r_name FROM region) AS known_region,
 len(list_filter(supported_majors, lambda x: NOT list_contains({O.lst(fixed.MAJORS)}, x))) AS unknown_majors, len(list_distinct(supported_majors)) AS distinct_majors FROM v_option) """
_UNIQUE = ["option_id", "name", "short_name"]


def _rule_sql(name: str, rule: str) -> str:
    broken = f"FILTER (WHERE NOT coalesce({rule.format(**_DUCK)}, true))"
    return f"SELECT '{name}' AS rule, count(*) {broken} AS violations, min(option_id) {broken} AS first_id, array_to_string(min(option_id, 5) {broken}, ',') AS sample_ids FROM v_fact"


@query("dq_expectations", O.with_(O.PROFILE, O.OPTION) + _FACT_SQL + " UNION ALL ".join(_rule_sql(n, r) for n, r in _RULES.items())
    + "".join(f" UNION ALL SELECT 'unique_{c}', count(*), min(f), array_to_string(min(f, 5), ',') FROM (SELECT min(option_id) AS f FROM v_fact GROUP BY lower(trim(CAST({c} AS VARCHAR))) HAVING count(*) > 1) u" for c in _UNIQUE)
    + " UNION ALL SELECT 'record_count', CAST(count(*) < 20 AS BIGINT), NULL, NULL FROM v_fact")
def dq_expectations(spark, sf):
    """Every invariant of the catalogue in one pass."""
    own, dim = B.options(spark, sf).withColumn("k", F.col("option_id")), B.country_dim(spark, sf)
    names = dim.agg(F.struct(F.collect_set("country").alias("country"), F.collect_set("region").alias("region")).alias("s")).scalar()
    facts = own.withColumns({n: F.expr(x.format(**_SPARK)) for n, x in _FACTS.items()}).withColumn("_known", names).withColumns({
        "known_country": F.array_contains("_known.country", F.col("country")), "known_region": F.array_contains("_known.region", F.col("region")),
        "unknown_majors": F.size(F.filter("supported_majors", lambda m: ~m.isin(*fixed.MAJORS))), "distinct_majors": F.size(F.array_distinct("supported_majors")),
    })
    return E.expectations(facts, {n: F.expr(r.format(**_SPARK)) for n, r in _RULES.items()}, _UNIQUE, 20)


@query("status_summary", APPROVED + " SELECT 'options' AS metric, count(*) AS n FROM supplier UNION ALL SELECT 'approved_records', count(DISTINCT record_id) FROM v_app WHERE reason IS NULL UNION ALL SELECT 'pages', count(*) FROM pages")
def status_summary(spark, sf):
    def metric(df, name, what):
        return df.agg(what.alias("n")).select(F.lit(name).alias("metric"), "n")
    return metric(B.table(spark, sf, "supplier"), "options", F.count(F.lit(1))).unionByName(
        metric(E.latest_approved(_approval_events(spark, sf)), "approved_records", F.count_distinct("record_id"))).unionByName(
        metric(B.table(spark, sf, "pages"), "pages", F.count(F.lit(1))))


@query("scope_gate", f"""SELECT p_partkey AS k, f.field, s.scope, NOT (list_contains({O.lst(signals.GUARDED_FIELDS)}, f.field)) OR list_contains({O.lst(signals.FIRST_YEAR_SCOPES)}, s.scope) AS may_serve FROM part
 JOIN (SELECT unnest({O.lst([*signals.GUARDED_FIELDS, 'applicationPlatform'])}) AS field, unnest(range({len(signals.GUARDED_FIELDS) + 1})) AS i) f ON f.i = p_partkey % {len(signals.GUARDED_FIELDS) + 1}
 JOIN (SELECT unnest({O.lst([*signals.FIRST_YEAR_SCOPES, 'transfer', 'graduate', 'visiting'])}) AS scope, unnest(range({len(signals.FIRST_YEAR_SCOPES) + 3})) AS i) s ON s.i = p_size % {len(signals.FIRST_YEAR_SCOPES) + 3}""")
def scope_gate(spark, sf):
    fields, scopes = [*signals.GUARDED_FIELDS, "applicationPlatform"], [*signals.FIRST_YEAR_SCOPES, "transfer", "graduate", "visiting"]
    rows = B.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.pick(fields, F.col("p_partkey") % len(fields)).alias("field"), S.pick(scopes, F.col("p_size") % len(scopes)).alias("scope"))
    return rows.withColumn("may_serve", ~F.col("field").isin(*signals.GUARDED_FIELDS) | F.col("scope").isin(*signals.FIRST_YEAR_SCOPES))


@query("no_evidence_minus_accounted", PROP + f" SELECT record_id, field FROM v_prop WHERE value IS NULL AND {_VERDICT} = 'REJECT' AND evidence_count = 0")
def no_evidence_minus_accounted(spark, sf):
    p = V.proposals(spark, sf)
    silent = p.where(F.col("value").isNull()).select("record_id", "field")
    accounted = p.where((F.col("evidence_count") > 0) | (E.verdict(F.col("has_error"), F.col("evidence_count") > 0, F.col("has_warning"), F.col("confidence")) != "REJECT")).select("record_id", "field")
    # both sides grow with the records
    return silent.join(accounted.hint("merge"), ["record_id", "field"], "left_anti")
