"""SQL statements of kind scores and page selection, over what the rendered pages say.

The words of a page are stated from the part table as they are rendered, never
from HTML; the signals are rows that the words are joined with.
"""

from __future__ import annotations

from waymark import signals
from waymark.operators.registry import phrase_weight
from waymark.plans import page_bindings as V
from waymark.plans.oracle_match import case_map, fill, lst, num, q, with_


def _words(text: str) -> str:
    return f"' ' || trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _terms() -> str:
    """One row per (kind, region, group, place in its list, term): groups tell clauses of one gate apart."""
    rows = []
    for kind, sig in signals.KIND_SIGNALS.items():
        lists = [(region, 0, sig.get(region) or []) for region in ("title", "heading", "text", "path", "negative", "hard", "canonical")]
        lists += [(region, g, terms) for region in ("require", "one_of", "together") for g, terms in enumerate(sig.get(region) or [])]
        rows += [f"({q(kind)}, {q(region)}, {g}, {i}, {q(t)}, {phrase_weight(t)}e0)" for region, g, terms in lists for i, t in enumerate(terms)]
    return ",\n".join(rows)


def _kinds() -> str:
    return ", ".join(f"({i}, {q(k)}, {signals.KIND_SIGNALS[k]['critical']}, {signals.KIND_SIGNALS[k]['audience']})" for i, k in enumerate(signals.KINDS))


_STATUS = "CASE WHEN k % 10 = 9 OR k % 5 = 3 THEN 'historical' WHEN k % 7 <> 0 THEN 'current' WHEN k % 5 = 1 THEN 'current' ELSE 'dated' END"
_AUDIENCE = """CASE WHEN scope IN ('first_year', 'international_first_year') THEN 'first_year' WHEN scope = 'general_undergraduate' THEN 'all_undergraduate' WHEN scope <> 'unknown' THEN scope
 WHEN k % 12 IN (1, 5) THEN 'international' ELSE 'unknown' END"""
_USD = "'$' || format('{{:,}}', {0})".format
_IELTS = "CASE k % 3 WHEN 0 THEN 'IELTS ' || (6 + (k % 5) // 2) || '.' || ((k % 2) * 5) || ' overall is required.' WHEN 1 THEN 'IELTS 6.0 in each component is required.' ELSE 'IELTS 7.0 is required.' END"
_SECTIONS = f"""[title || ' ' || {q(V.FILLER)} || CASE WHEN k % 2 = 0 THEN ' For undergraduate applicants.' ELSE '' END,
  'Dates The application deadline is ' || strftime(due, '%B %-d, %Y') || '.' || CASE WHEN has_table THEN ' Item 2025-26 2026-27 Tuition per year ' || {_USD('tuition - 1000')} || ' ' || {_USD('tuition')} || ' Housing per year ' || {_USD('housing - 500')} || ' ' || {_USD('housing')} ELSE '' END,
  'Costs Tuition is ' || {_USD('tuition')} || ' per year and housing is ' || {_USD('housing')} || ' per year for ' || prose_year || '. Families with income below $75,000 attend tuition free.',
  'English ' || {_IELTS} || ' TOEFL ' || (80 + k % 40) || ' is accepted.', 'Testing ' || {lst(V.TESTING)}[k % 4 + 1], 'Aid ' || {lst(V.AID)}[k % 6 + 1]]"""
_PATH = f"CASE WHEN k % 10 = 9 THEN '/blog/2019/03/p' || k ELSE {lst(V.PATHS)}[k % 12 + 1] || '/p' || k END"

SCORED = with_(V.RENDERED_SQL) + f""",
v_term(kind, region, grp, ord, term, weight) AS (VALUES {_terms()}),
v_kind(kind_ordinal, kind, critical, for_audience) AS (VALUES {_kinds()}),
v_say AS (SELECT k, institution_id, scope, {_AUDIENCE} AS audience, {_STATUS} AS status, k % 10 = 9 AS blog, {_PATH} AS path, {_SECTIONS} AS sections, title FROM v_r),
v_hay AS (SELECT *, {_words('title')} AS h_title, {_words("title || ' Dates Costs English Testing Aid'")} AS h_heading, {_words("array_to_string(sections, ' ')")} AS h_text, {_words('path')} AS h_path,
  CASE WHEN k % 4 <> 2 THEN {_words(f"{lst(signals.KINDS)}[k % 12 + 1] || '.xml'")} ELSE '  ' END AS h_context FROM v_say),
v_page AS (SELECT *, h_title || h_heading || h_text || h_path AS corpus FROM v_hay),
v_hit AS (SELECT p.k, t.kind, t.region, t.grp, t.ord, t.term, t.weight FROM v_page p JOIN v_term t ON t.region NOT IN ('canonical', 'together')
  AND contains(CASE t.region WHEN 'title' THEN h_title WHEN 'heading' THEN h_heading WHEN 'text' THEN h_text WHEN 'path' THEN h_path ELSE corpus END, ' ' || t.term || ' ')),
v_listed AS (SELECT p.k, t.kind, sum(t.weight) AS w FROM v_page p JOIN v_term t ON t.region = 'path' AND contains(h_context, ' ' || t.term || ' ') GROUP BY ALL),
v_text AS (SELECT k, kind, sum(weight) AS w FROM (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY ord) AS n FROM v_hit WHERE region = 'text') t WHERE n <= {signals.TEXT_HIT_CAP} GROUP BY ALL),
v_sum AS (SELECT k, kind, coalesce(sum(weight) FILTER (WHERE region = 'title'), 0) AS w_title, coalesce(sum(weight) FILTER (WHERE region = 'heading'), 0) AS w_heading, coalesce(sum(weight) FILTER (WHERE region = 'path'), 0) AS w_path,
  count(*) FILTER (WHERE region = 'negative') AS negatives, count(*) FILTER (WHERE region = 'hard') AS hard, count(DISTINCT grp) FILTER (WHERE region = 'require') AS required FROM v_hit GROUP BY ALL),
v_clause AS (SELECT DISTINCT h.k, h.kind FROM (SELECT k, kind, grp, count(DISTINCT term) AS n FROM v_hit WHERE region = 'one_of' GROUP BY ALL) h
  JOIN (SELECT kind, grp, count(*) AS n FROM v_term WHERE region = 'one_of' GROUP BY ALL) w ON h.kind = w.kind AND h.grp = w.grp AND h.n = w.n),
v_place AS (SELECT k, 0 AS place, h_title AS hay FROM v_page UNION ALL SELECT k, generate_subscripts(sections, 1), {_words('unnest(sections)')} FROM v_page),
v_near AS (SELECT DISTINCT k, kind FROM (SELECT p.k, p.place, t.kind, count(DISTINCT t.grp) AS n FROM v_place p JOIN v_term t ON t.region = 'together' AND contains(p.hay, ' ' || t.term || ' ') GROUP BY ALL) x WHERE n = 2),
v_need AS (SELECT kind, count(DISTINCT grp) FILTER (WHERE region = 'require') AS required, count(*) FILTER (WHERE region = 'one_of') > 0 AS one_of, count(*) FILTER (WHERE region = 'together') > 0 AS together FROM v_term GROUP BY kind),
v_global AS (SELECT k, count(*) AS n FROM v_page JOIN (SELECT unnest({lst(signals.GLOBAL_NEGATIVE)}) AS term) g ON contains(h_title || h_path, ' ' || term || ' ') GROUP BY k),
v_seg AS (SELECT k, trim(regexp_replace(unnest(string_split(path, '/')), '[^a-z0-9]+', ' ', 'g')) AS seg FROM v_page),
v_canon AS (SELECT s.k, t.kind, count(DISTINCT t.term) AS n FROM v_seg s JOIN v_term t ON t.region = 'canonical' AND (s.seg = t.term OR starts_with(s.seg, t.term || ' ')) GROUP BY ALL),
v_gate AS (
  SELECT p.k, p.institution_id, p.path, p.scope, p.audience, p.status, p.blog, c.kind_ordinal, c.kind, c.critical, coalesce(n.n, 0) AS canon,
    CASE WHEN p.scope NOT IN {tuple(signals.FIRST_YEAR_SCOPES)} THEN 'scope' WHEN coalesce(s.hard, 0) > 0 THEN 'hard negative' WHEN coalesce(s.required, 0) < w.required THEN 'missing required term'
      WHEN w.one_of AND o.k IS NULL THEN 'no specific statement' WHEN w.together AND t.k IS NULL THEN 'never together' END AS failed,
    coalesce(s.w_title, 0) * {signals.TITLE_WEIGHT} + coalesce(s.w_heading, 0) * {signals.HEADING_WEIGHT} + coalesce(x.w, 0) * {signals.TEXT_WEIGHT} AS content,
    coalesce(s.w_path, 0) * {signals.PATH_WEIGHT} + coalesce(l.w, 0) * {signals.SITEMAP_WEIGHT} + (coalesce(g.n, 0) + coalesce(s.negatives, 0)) * {signals.NEGATIVE_WEIGHT} AS extra,
    CASE WHEN p.blog THEN {signals.ARTICLE_FIRST} + {signals.DATED_PATH} ELSE least({signals.CANONICAL_CAP}, coalesce(n.n, 0) * {signals.CANONICAL_SEGMENT}) END + {case_map('p.status', signals.TEMPORAL_ADJUST)}
      + CASE WHEN c.for_audience THEN {case_map('p.audience', signals.AUDIENCE_ADJUST)} ELSE 0 END AS authority
  FROM v_page p JOIN v_kind c ON true JOIN v_need w ON w.kind = c.kind LEFT JOIN v_sum s ON s.k = p.k AND s.kind = c.kind LEFT JOIN v_text x ON x.k = p.k AND x.kind = c.kind LEFT JOIN v_clause o ON o.k = p.k AND o.kind = c.kind
    LEFT JOIN v_near t ON t.k = p.k AND t.kind = c.kind LEFT JOIN v_canon n ON n.k = p.k AND n.kind = c.kind LEFT JOIN v_global g ON g.k = p.k LEFT JOIN v_listed l ON l.k = p.k AND l.kind = c.kind),
v_passed AS (SELECT k, institution_id, 'https://www.uni' || institution_id || '.edu' || path AS page_url, scope, audience, status, kind_ordinal, kind, critical, failed, CASE WHEN failed IS NULL THEN content ELSE 0 END::DOUBLE AS content,
  CASE WHEN failed IS NULL THEN content + extra ELSE 0 END::DOUBLE AS relevance, CASE WHEN failed IS NULL THEN authority ELSE 0 END::DOUBLE AS authority,
  CASE WHEN failed IS NOT NULL THEN 'fallback' WHEN blog THEN 'historical' WHEN canon > 0 THEN 'canonical' ELSE 'supporting' END AS role FROM v_gate),
v_scored AS (SELECT *, relevance + authority AS score, failed IS NULL AND content >= {signals.CONTENT_BAR} AND relevance + authority >= {signals.ACCEPT_BAR} AS accepted FROM v_passed)"""

KIND_SCORE = SCORED + " SELECT k AS page_id, kind, failed, content, relevance, authority, score, role, accepted FROM v_scored"

_ROLE = "CAST({} AS INTEGER)".format(case_map("role", signals.ROLE_RANK))
_SCOPE = "coalesce({}, 1)".format(case_map("scope", signals.SCOPE_RANK))
_HEARD = "coalesce({}, 3)".format(case_map("audience", signals.AUDIENCE_RANK))
RANKED = SCORED + f""",
v_ranked AS (SELECT *, {_ROLE} AS r_role, {_SCOPE} AS r_scope, {_HEARD} AS r_audience, row_number() OVER (PARTITION BY institution_id, kind ORDER BY {_ROLE} DESC, {_SCOPE} DESC, score DESC, {_HEARD} DESC, k) AS place FROM v_scored WHERE accepted),
v_best AS (SELECT * FROM v_ranked WHERE place = 1)"""
BEST = RANKED + " SELECT institution_id, kind, page_url, role, scope, score FROM v_best"


def _spaced(column: str) -> str:
    return f"replace({column}, '_', ' ')"


_NOTE = " || CASE WHEN a.status <> b.status THEN " + fill(
    signals.WHY_STATUS, a="a.status", b="b.status", x=case_map("a.status", signals.TEMPORAL_ADJUST), y=case_map("b.status", signals.TEMPORAL_ADJUST)) + " ELSE '' END"
RUNNER_UP = RANKED + f""" SELECT a.institution_id, a.kind, a.page_url, b.page_url AS runner_up_url, CASE WHEN b.k IS NULL THEN {q(signals.WHY_ALONE)} WHEN a.r_role <> b.r_role THEN {fill(signals.WHY_ROLE, a='a.role', b='b.role')}
  WHEN a.r_scope <> b.r_scope THEN {fill(signals.WHY_SCOPE, a=_spaced('a.scope'), b=_spaced('b.scope'))} WHEN a.score <> b.score THEN {fill(signals.WHY_SCORE, a=num('a.score'), b=num('b.score'))}{_NOTE}
  WHEN a.r_audience <> b.r_audience THEN {fill(signals.WHY_AUDIENCE, a='a.audience', b='b.audience')} ELSE {fill(signals.WHY_ORDER, a=num('a.score'))} END AS why_it_won
  FROM v_best a LEFT JOIN v_ranked b ON b.institution_id = a.institution_id AND b.kind = a.kind AND b.place = 2"""

GATED = RANKED + f""",
v_refused AS (SELECT *, CASE WHEN critical AND role = 'historical' THEN {q(signals.REFUSED_HISTORICAL)} WHEN critical AND role = 'fallback' AND score < {signals.FALLBACK_BAR} THEN {fill(signals.REFUSED_FALLBACK, score=num('score'), bar=str(signals.FALLBACK_BAR))} END AS reason FROM v_best),
v_gated AS (SELECT i.institution_id, c.kind, b.page_url, CASE WHEN b.k IS NULL THEN 'not_found' WHEN b.reason IS NOT NULL THEN 'rejected' ELSE 'found' END AS outcome, b.reason
  FROM (SELECT DISTINCT institution_id FROM v_r) i JOIN v_kind c ON true LEFT JOIN v_refused b ON b.institution_id = i.institution_id AND b.kind = c.kind)"""
QUALITY_GATE = GATED + " SELECT institution_id, kind, page_url, outcome, reason FROM v_gated"
NOT_FOUND = GATED + f""" SELECT institution_id, found, missing, CASE WHEN found = {len(signals.KINDS)} THEN 'complete' WHEN found > 0 THEN 'partial' ELSE 'failed' END AS status FROM (
  SELECT institution_id, count(*) FILTER (WHERE outcome = 'found') AS found, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE outcome <> 'found'), '') AS missing FROM v_gated GROUP BY institution_id) t"""
