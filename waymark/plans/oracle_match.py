"""SQL statements of the match keys, written for a SQL engine on the same tables."""

from __future__ import annotations

import re

from waymark import fixed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{lst(values)}[CAST({index} AS INTEGER) + 1]"


def fill(template: str, **exprs) -> str:
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(f"CAST({exprs[piece[1:-1]]} AS VARCHAR)")
        elif piece:
            parts.append(q(piece))
    return "(" + " || ".join(parts) + ")"


def num(expr: str) -> str:
    return f"(CASE WHEN {expr} = floor({expr}) THEN CAST(CAST({expr} AS BIGINT) AS VARCHAR) ELSE CAST({expr} AS VARCHAR) END)"


def usd(expr: str) -> str:
    return f"(CASE WHEN {expr} IS NULL THEN 'Unknown' WHEN {expr} = 0 THEN '$0' ELSE '$' || format('{{:,}}', CAST({expr} AS BIGINT)) END)"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(str(k))} THEN {q(v) if isinstance(v, str) else repr(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def clamp(e: str, lo="0", hi="100") -> str:
    return f"least({hi}, greatest({lo}, {e}))"


def scale(v: str, li: str, hi: str, lo: float, ho: float) -> str:
    a, b = f"CAST({li} AS DOUBLE)", f"CAST({hi} AS DOUBLE)"
    lo_, ho_ = f"{float(lo)}e0", f"{float(ho)}e0"
    t = f"(({v}) - {a}) / nullif({b} - {a}, 0)"
    return f"(CASE WHEN {a} = {b} THEN {ho_} ELSE {clamp(f'{lo_} + {t} * ({ho_} - {lo_})', f'{float(min(lo, ho))}e0', f'{float(max(lo, ho))}e0')} END)"


def rnd(e: str) -> str:
    return f"CAST(floor(({e}) + 0.5e0) AS BIGINT)"


def label(e: str) -> str:
    return f"(CASE WHEN {e} >= 82 THEN 'excellent' WHEN {e} >= 66 THEN 'good' WHEN {e} >= 48 THEN 'moderate' ELSE 'weak' END)"


_ADJ = {m: sorted({x for c in fixed.MAJOR_CLUSTERS if m in c for x in c} - {m}) for m in fixed.MAJORS}

PROFILE = f"""
v_country AS (
  SELECT n_nationkey AS nation_key, n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
),
v_profile0 AS (
  SELECT c_custkey AS k, c_custkey AS profile_id, c_name AS profile_name, a.n_name AS current_country,
    a.n_name AS n1, b.n_name AS n2, c.n_name AS n3,
    CAST(floor(greatest(c_acctbal, 0) * 4e0) AS BIGINT) AS budget_annual_usd, c_mktsegment
  FROM customer JOIN nation a ON a.n_nationkey = c_nationkey
  JOIN nation b ON b.n_nationkey = (c_nationkey + 7) % 25 JOIN nation c ON c.n_nationkey = (c_nationkey + 13) % 25
),
v_profile1 AS (
  SELECT *, {pick(fixed.MAJORS, 'k % 17')} AS intended_major,
    (budget_annual_usd * [4, 5, 8][CAST(k % 3 AS INTEGER) + 1]) // 4 AS max_affordable_annual_usd,
    {pick(fixed.GPA_SCALES, 'k % 5')} AS gpa_scale, {pick(fixed.CLASS_RANKS, 'k % 6')} AS class_rank,
    {pick(fixed.ENGLISH_TESTS, 'k % 4')} AS english_test, k % 2 = 0 AS english_planned,
    CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(900 + (k * 37) % 701 AS INTEGER) END AS sat_score,
    CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_slice([n1, n2, n3], 1, 1 + k % 3) END AS preferred_countries,
    k % 4 = 0 AS open_to_any_country,
    {pick([*fixed.CITY_SIZES, fixed.NO_PREFERENCE], 'k % 5')} AS city_size_preference,
    {pick([*fixed.ENVIRONMENTS, fixed.NO_PREFERENCE], 'k % 4')} AS environment_preference,
    {pick([*fixed.SIZES, fixed.NO_PREFERENCE], '(k % 7) % 4')} AS size_preference, k % 7 < 2 AS english_taught_only,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'full-ride' WHEN 'BUILDING' THEN 'full-tuition' WHEN 'MACHINERY' THEN 'none' ELSE 'partial' END AS aid_need,
    CAST((k * 13) % 101 AS INTEGER) AS research, CAST((k * 29) % 101 AS INTEGER) AS prestige, CAST((k * 7) % 101 AS INTEGER) AS pref_scholarship
  FROM v_profile0
),
v_profile2 AS (
  SELECT *, CASE WHEN k % 29 = 0 THEN NULL WHEN gpa_scale = '4.0' THEN 2e0 + CAST(k % 21 AS DOUBLE) / 10e0 WHEN gpa_scale = '5.0' THEN 3e0 + CAST(k % 21 AS DOUBLE) / 10e0
      WHEN gpa_scale = 'IB45' THEN CAST(20 + k % 26 AS DOUBLE) ELSE CAST(60 + k % 41 AS DOUBLE) END AS gpa_value,
    CASE WHEN k % 31 = 0 OR english_test = 'none' THEN NULL WHEN english_test = 'IELTS' THEN 5e0 + CAST(k % 9 AS DOUBLE) / 2e0
      WHEN english_test = 'TOEFL' THEN CAST(40 + k % 81 AS DOUBLE) ELSE CAST(80 + k % 71 AS DOUBLE) END AS english_score,
    NOT open_to_any_country AND len(preferred_countries) > 0 AS wants_specific,
    greatest(max_affordable_annual_usd, budget_annual_usd) AS ceiling
  FROM v_profile1
),
v_profile AS (
  SELECT *, CASE WHEN gpa_value IS NULL THEN NULL WHEN gpa_scale = '4.0' THEN {clamp('gpa_value / 4e0 * 100e0')} WHEN gpa_scale = '5.0' THEN {clamp('gpa_value / 5e0 * 100e0')}
      WHEN gpa_scale = 'IB45' THEN {scale('gpa_value', '24', '45', 70, 100)} ELSE {clamp('gpa_value')} END AS gpa_norm,
    CASE WHEN english_score IS NULL THEN NULL WHEN english_test = 'IELTS' THEN english_score
      WHEN english_test = 'TOEFL' THEN CASE {' '.join(f'WHEN english_score >= {b} THEN {r}e0' for b, r in fixed.TOEFL_STEPS)} ELSE 5e0 END
      WHEN english_test = 'Duolingo' THEN CASE {' '.join(f'WHEN english_score >= {b} THEN {r}e0' for b, r in fixed.DUOLINGO_STEPS)} ELSE 5e0 END END AS ielts_band
  FROM v_profile2
)"""

OPTION = f"""
v_option0 AS (
  SELECT s_suppkey AS k, s_suppkey AS option_id, s_name AS name, 'S' || s_suppkey AS short_name, n_name AS country, r_name AS region,
    'City ' || (s_suppkey % 50) AS city
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
),
v_option1 AS (
  SELECT *, {pick(fixed.CITY_SIZES, 'k % 4')} AS city_size, {pick(fixed.ENVIRONMENTS, 'k % 3')} AS environment,
    {pick(fixed.CLIMATES, 'k % 4')} AS climate, {pick(fixed.SIZES, '(k // 2) % 3')} AS size,
    k % 3 <> 2 AS teaches_english,
    CASE k % 3 WHEN 0 THEN ['English'] WHEN 1 THEN ['German', 'English'] ELSE ['German'] END AS languages_of_instruction,
    CASE WHEN k % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Programme ' || (k % 17), 'Programme ' || ((k + 3) % 17)] END AS programs,
    list_slice([{', '.join(pick(fixed.MAJORS, f'(k + {4 * i}) % 17') for i in range(5))}], 1, 3 + k % 3) AS supported_majors,
    CAST(1 + k % 5 AS INTEGER) AS research_intensity, CAST(1 + (k // 5) % 5 AS INTEGER) AS prestige_tier,
    CASE WHEN k % 23 <> 0 THEN (k * 7919) % 60000 END AS tuition, CASE WHEN k % 19 <> 0 THEN (k * 104729) % 25000 END AS living_cost,
    {pick(fixed.CONFIDENCES, 'k % 3')} AS tuition_confidence, {pick(fixed.CONFIDENCES, '(k // 3) % 3')} AS living_confidence,
    {pick(fixed.AVAILABILITIES, 'k % 5')} AS scholarship_availability, {pick(fixed.AID_CERTAINTIES, '(k // 2) % 4')} AS aid_certainty,
    CASE k % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS full_ride_possible,
    CASE k % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS full_tuition_possible,
    CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS need_based_aid,
    'Aid note ' || k || '. Details follow.' AS aid_note,
    CASE WHEN k % 6 <> 0 THEN 5.5e0 + CAST(k % 5 AS DOUBLE) / 2e0 END AS minimum_ielts, CASE WHEN k % 9 <> 0 THEN 6e0 + CAST(k % 5 AS DOUBLE) / 2e0 END AS recommended_ielts,
    {pick(fixed.SAT_POLICIES, 'k % 5')} AS sat_policy,
    CASE WHEN k % 4 <> 0 THEN CAST(1000 + (k % 5) * 50 AS INTEGER) END AS minimum_sat, CASE WHEN k % 3 <> 0 THEN CAST(1200 + (k % 9) * 40 AS INTEGER) END AS recommended_sat,
    CAST(70 + k % 26 AS INTEGER) AS gpa_expectation, {pick(fixed.SELECTIVITIES, '(k // 3) % 4')} AS admission_selectivity,
    'Selectivity note ' || k AS selectivity_note,
    CASE WHEN k % 13 <> 0 THEN DATE '2026-09-01' + CAST((k * 17) % 200 AS INTEGER) END AS application_deadline,
    CASE WHEN k % 10 <> 0 THEN DATE '2026-08-15' + CAST((k * 11) % 150 AS INTEGER) END AS scholarship_deadline,
    {pick(["Common App", "Direct", "UCAS"], 'k % 3')} AS application_platform, 'https://www.uni' || k || '.edu/' AS official_url
  FROM v_option0
),
v_option2 AS (
  SELECT *, tuition + living_cost AS total_annual_cost, aid_certainty IN ('meets-full-need', 'structural') AS aid_dependable,
    gpa_expectation + CASE admission_selectivity WHEN 'highly-selective' THEN 10 WHEN 'selective' THEN 5 WHEN 'moderate' THEN 0 ELSE -4 END AS academic_bar,
    coalesce(minimum_ielts, recommended_ielts) AS ielts_need, coalesce(recommended_sat, minimum_sat) AS sat_target
  FROM v_option1
),
v_option AS (
  SELECT *, CASE WHEN total_annual_cost IS NULL THEN NULL ELSE least(total_annual_cost, CASE WHEN coalesce(full_ride_possible, false) THEN 0
      WHEN coalesce(full_tuition_possible, false) THEN living_cost
      ELSE {rnd(f"CAST(total_annual_cost AS DOUBLE) * CASE scholarship_availability WHEN 'extensive' THEN 0.25e0 WHEN 'moderate' THEN 0.6e0 WHEN 'limited' THEN 0.85e0 WHEN 'rare-for-international' THEN 0.95e0 ELSE 0.9e0 END")} END) END AS best_case_net_cost
  FROM v_option2
),
v_adjacent AS (
  SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a in fixed.MAJORS for b in _ADJ[a])}) t(major, neighbour)
),
v_major_option AS (
  SELECT option_id, major, min(pos) AS pos FROM (
    SELECT option_id, unnest(supported_majors) AS m, unnest(range(1, len(supported_majors) + 1)) AS pos FROM v_option) s
  JOIN v_adjacent ON neighbour = m GROUP BY ALL
)"""


def scored_sql(profile: str = "v_profile", suffix: str = "", extra: str = "") -> str:
    """Chained CTEs: all pairs of a profile relation with v_option, scored."""
    reliance = "((CAST(total_annual_cost AS DOUBLE) - ceiling) / nullif(CAST(total_annual_cost AS DOUBLE), 0))"
    gap = "greatest(0, best_case_net_cost - ceiling)"
    return f"""
v_pair{suffix} AS (
  SELECT {extra} p.profile_id, p.intended_major, p.gpa_norm, p.class_rank, p.ielts_band, p.sat_score, p.budget_annual_usd, p.ceiling, p.aid_need,
    p.preferred_countries, p.wants_specific, p.open_to_any_country, p.city_size_preference, p.environment_preference, p.size_preference, p.english_taught_only,
    p.english_planned, p.research, p.prestige, p.pref_scholarship, o.*,
    list_contains(p.preferred_countries, o.country) AS in_list,
    EXISTS (SELECT 1 FROM v_country c WHERE list_contains(p.preferred_countries, c.country) AND c.region = o.region) AS in_region,
    list_contains(o.supported_majors, p.intended_major) AS major_exact, m.pos AS adjacent_pos
  FROM {profile} p CROSS JOIN v_option o LEFT JOIN v_major_option m ON m.option_id = o.option_id AND m.major = p.intended_major
),
v_fit{suffix} AS (
  SELECT *,
    CASE WHEN gpa_norm - academic_bar >= 0 THEN {scale('gpa_norm - academic_bar', '0', '8', 78, 100)} ELSE {scale('gpa_norm - academic_bar', '-20', '0', 15, 78)} END AS academic_base,
    CASE WHEN total_annual_cost IS NULL THEN 'unknown' WHEN total_annual_cost <= ceiling THEN 'strong-financial-fit'
      WHEN best_case_net_cost <= ceiling AND aid_dependable THEN 'potentially-affordable-with-aid' WHEN best_case_net_cost <= ceiling THEN 'aid-dependent' ELSE 'above-budget' END AS verdict,
    CASE WHEN total_annual_cost IS NOT NULL THEN {gap} END AS funding_gap,
    CASE WHEN major_exact THEN 100 WHEN adjacent_pos IS NOT NULL THEN 62 ELSE 18 END AS major_score,
    CASE WHEN NOT wants_specific THEN 78 WHEN in_list THEN 100 WHEN in_region THEN 58 ELSE 20 END AS geo0,
    CASE WHEN ielts_band IS NULL THEN 45e0 WHEN ielts_need IS NULL THEN 80e0 WHEN ielts_band >= ielts_need + 0.5e0 THEN 100e0 WHEN ielts_band >= ielts_need THEN 88e0
      ELSE {scale('ielts_need - ielts_band', '2', '0', 10, 62)} END AS english_part,
    CASE WHEN sat_policy = 'not-used' THEN 92e0 WHEN sat_score IS NOT NULL AND sat_target IS NULL THEN 80e0 WHEN sat_score >= sat_target THEN 100e0
      WHEN sat_score IS NOT NULL THEN {scale('CAST(sat_target - sat_score AS DOUBLE)', '250', '0', 25, 92)} WHEN sat_policy = 'required' THEN 30e0 WHEN sat_policy = 'recommended' THEN 58e0 ELSE 85e0 END AS sat_part,
    {clamp('100 - abs(research - (research_intensity - 1) * 25)')} AS research_align, {clamp('100 - abs(prestige - (prestige_tier - 1) * 25)')} AS prestige_align,
    CASE WHEN size_preference = 'no-preference' THEN 75 WHEN size_preference = size THEN 100 ELSE 45 END AS size_align
  FROM v_pair{suffix}
),
v_comp{suffix} AS (
  SELECT *,
    CASE WHEN class_rank IN ('top-1', 'top-5') THEN {clamp('academic_base + 6')} ELSE academic_base END AS academic_raw,
    CAST(CASE WHEN total_annual_cost IS NULL THEN 50 WHEN total_annual_cost <= budget_annual_usd THEN 100
      WHEN total_annual_cost <= ceiling THEN {rnd(scale('CAST(total_annual_cost AS DOUBLE)', 'ceiling', 'budget_annual_usd', 78, 96))}
      WHEN best_case_net_cost <= ceiling AND aid_dependable THEN {rnd(clamp(f'58e0 + (1e0 - {reliance}) * 22e0'))}
      WHEN best_case_net_cost <= ceiling THEN {rnd(clamp(f"30e0 + (1e0 - {reliance}) * 14e0 + CASE WHEN aid_certainty = 'competitive' THEN 1e0 ELSE 0.5e0 END * 8e0"))}
      ELSE {rnd(scale(f'CAST({gap} AS DOUBLE)', '0', 'greatest(total_annual_cost, 1)', 34, 2))} END AS INTEGER) AS financial_score,
    CASE WHEN city_size_preference = 'no-preference' THEN geo0 WHEN city_size_preference = city_size THEN {clamp('geo0 + 8')} ELSE {clamp('geo0 - 5')} END AS geo1,
    CAST(CASE aid_need WHEN 'none' THEN 80 WHEN 'full-ride' THEN CASE WHEN full_ride_possible THEN 96 WHEN full_tuition_possible THEN 58 ELSE 14 END
      WHEN 'full-tuition' THEN CASE WHEN full_ride_possible OR full_tuition_possible THEN 90 ELSE 26 END
      ELSE CASE scholarship_availability WHEN 'extensive' THEN 94 WHEN 'moderate' THEN 78 WHEN 'limited' THEN 50 WHEN 'rare-for-international' THEN 30 ELSE 45 END END AS INTEGER) AS scholarship_score,
    CAST({rnd('(english_part + sat_part) / 2e0')} AS INTEGER) AS tests_score,
    CAST({rnd('CAST(research_align * greatest(research, 20) + prestige_align * greatest(prestige, 20) + size_align * 40 AS DOUBLE) / CAST(greatest(research, 20) + greatest(prestige, 20) + 40 AS DOUBLE)')} AS INTEGER) AS preference_score
  FROM v_fit{suffix}
),
v_comp2{suffix} AS (
  SELECT *, CAST(CASE WHEN gpa_norm IS NULL THEN 50 ELSE {rnd('academic_raw')} END AS INTEGER) AS academic_score,
    CASE WHEN gpa_norm IS NULL THEN 'unknown' ELSE {label('academic_raw')} END AS academic_label,
    CASE WHEN environment_preference <> 'no-preference' AND environment_preference = environment THEN {clamp('geo1 + 5')} ELSE geo1 END AS geo2,
    wants_specific AND NOT in_list AS outside_preferred
  FROM v_comp{suffix}
),
v_comp3{suffix} AS (
  SELECT *, CAST(CASE WHEN english_taught_only AND NOT teaches_english THEN {clamp('geo2 - 35')} ELSE geo2 END AS INTEGER) AS geography_score FROM v_comp2{suffix}
),
v_comp4{suffix} AS (
  SELECT *, (((((academic_score * 0.18e0 + financial_score * 0.24e0) + major_score * 0.18e0) + geography_score * 0.13e0) + scholarship_score * 0.1e0) + tests_score * 0.08e0) + preference_score * 0.09e0 AS weighted
  FROM v_comp3{suffix}
),
v_comp5{suffix} AS (
  SELECT *, CAST({rnd('CASE WHEN outside_preferred THEN weighted * 0.55e0 ELSE weighted END')} AS INTEGER) AS score FROM v_comp4{suffix}
),
v_scored{suffix} AS (
  SELECT *, CASE WHEN score >= 74 AND academic_score >= 55 THEN 'strong' WHEN score >= 58 THEN 'possible' ELSE 'ambitious' END AS category FROM v_comp5{suffix}
)"""


def shortlist_sql(suffix: str = "", key: str = "profile_id", limit: int = 8) -> str:
    return f"""
v_moded{suffix} AS (
  SELECT *, CASE WHEN viable >= 3 THEN 1 WHEN inside >= 3 THEN 2 ELSE 3 END AS mode FROM (
    SELECT *, count(*) FILTER (WHERE NOT outside_preferred AND verdict <> 'above-budget') OVER (PARTITION BY {key}) AS viable,
      count(*) FILTER (WHERE NOT outside_preferred) OVER (PARTITION BY {key}) AS inside FROM v_scored{suffix}) x
),
v_shortlist{suffix} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN mode = 1 AND verdict = 'above-budget' THEN 1 ELSE 0 END, score DESC, name, option_id) AS rank
    FROM v_moded{suffix} WHERE mode = 3 OR NOT outside_preferred) x
  WHERE rank <= {limit}
),
v_counts{suffix} AS (
  SELECT {key}, count(*) AS option_count, count(*) FILTER (WHERE verdict = 'strong-financial-fit') AS affordable_count,
    count(*) FILTER (WHERE verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS aid_dependent_count,
    count(*) FILTER (WHERE verdict = 'above-budget') AS above_budget_count
  FROM v_scored{suffix} GROUP BY {key}
)"""


SCORED = scored_sql()
SHORTLIST = shortlist_sql()


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


ALL = with_(PROFILE, OPTION, SCORED, SHORTLIST)
PAIRS = with_(PROFILE, OPTION, SCORED)


# ---- sentences over the shortlist ----------------------------------------

T = fixed.TEXT
_LONG = "strftime({0}, '%B %-d, %Y')"


def _lab(e: str) -> str:
    return case_map(e, fixed.MAJOR_LABELS)


_need = num("coalesce(ielts_need, 6.5e0)")
_band = num("ielts_band")
_gap10 = "(CAST(floor((ielts_need - ielts_band) * 10e0 + 0.5e0) AS DOUBLE) / 10e0)"
_spaced = "regexp_replace({0}, '-', ' ')"

TEXTS = f"""
v_flag AS (
  SELECT *,
    CASE WHEN ielts_band IS NULL THEN 'english-missing' WHEN ielts_need IS NULL THEN 'english-any' WHEN ielts_band >= ielts_need + 0.5e0 THEN 'english-strong' WHEN ielts_band >= ielts_need THEN 'english-met' ELSE 'english-below' END AS es,
    CASE WHEN sat_policy = 'not-used' THEN 'sat-unused' WHEN sat_score IS NULL THEN 'sat-missing' WHEN sat_target IS NULL THEN 'sat-any' WHEN sat_score >= sat_target THEN 'sat-strong' ELSE 'sat-below' END AS ss,
    gpa_norm - academic_bar AS delta, CAST(floor(gpa_norm + 0.5e0) AS BIGINT) AS gpa_r, scholarship_availability IN ('extensive', 'moderate') AS thick,
    coalesce(full_ride_possible, false) AS ride, coalesce(full_tuition_possible, false) AS ftuition
  FROM v_shortlist
),
v_text AS (
  SELECT *,
    list_filter([
      CASE WHEN major_score = 100 THEN {fill(T['major_yes'], label=_lab('intended_major'), example="CASE WHEN len(programs) > 0 THEN ' (e.g. ' || array_to_string(list_slice(programs, 1, 2), ', ') || ')' ELSE '' END")} END,
      CASE WHEN verdict = 'strong-financial-fit' AND total_annual_cost <= budget_annual_usd THEN {fill(T['in_budget'], total=usd('total_annual_cost'), budget=usd('budget_annual_usd'))}
        WHEN verdict = 'strong-financial-fit' THEN {fill(T['in_ceiling'], total=usd('total_annual_cost'), ceiling=usd('ceiling'))}
        WHEN verdict = 'potentially-affordable-with-aid' AND aid_certainty = 'meets-full-need' THEN {fill(T['full_need'], total=usd('total_annual_cost'), short='short_name', net=usd('best_case_net_cost'))}
        WHEN verdict = 'potentially-affordable-with-aid' THEN {fill(T['low_by_default'], net=usd('best_case_net_cost'))}
        WHEN verdict = 'aid-dependent' THEN {fill(T['award_reach'], total=usd('total_annual_cost'), net=usd('best_case_net_cost'), ceiling=usd('ceiling'))} END,
      CASE WHEN aid_need = 'none' THEN {q(T['aid_not_needed'])} WHEN aid_need = 'full-ride' AND ride THEN {fill(T['full_ride'], note="split_part(aid_note, '.', 1)")}
        WHEN aid_need = 'full-tuition' AND (ride OR ftuition) THEN {q(T['tuition_yes'])} WHEN aid_need = 'partial' AND thick THEN {q(T['partial_yes'])} END,
      CASE WHEN aid_need <> 'none' AND need_based_aid THEN {q(T['need_based'])} END,
      CASE WHEN NOT wants_specific THEN {q(T['geo_open'])} WHEN in_list THEN {fill(T['geo_yes'], country='country')} END,
      CASE WHEN city_size_preference <> 'no-preference' AND city_size_preference = city_size THEN {fill(T['city_match'], city=_spaced.format('city_size'))} END,
      CASE WHEN gpa_norm IS NOT NULL AND class_rank IN ('top-1', 'top-5') THEN {fill(T['class_rank'], rank="CASE class_rank WHEN 'top-1' THEN 'top 1%' ELSE 'top 5%' END")} END,
      CASE WHEN delta >= 4 THEN {fill(T['gpa_above'], gpa='gpa_r', bar='gpa_expectation')} WHEN delta >= -3 THEN {fill(T['gpa_in_line'], gpa='gpa_r', bar='gpa_expectation')} END,
      CASE es WHEN 'english-any' THEN {fill(T['english_ok'], band=_band)} WHEN 'english-strong' THEN {fill(T['english_strong'], band=_band, need=_need)} WHEN 'english-met' THEN {fill(T['english_met'], band=_band, need=_need)} END,
      CASE WHEN ss = 'sat-unused' THEN {q(T['sat_not_used'])} WHEN ss = 'sat-strong' THEN {fill(T['sat_strong'], sat='sat_score', target='sat_target')} WHEN ss = 'sat-missing' AND sat_policy NOT IN ('required', 'recommended') THEN {q(T['sat_optional'])} END,
      CASE WHEN research >= 65 AND research_intensity >= 4 THEN {q(T['research_match'])} END,
      CASE WHEN research <= 35 AND research_intensity <= 3 THEN {q(T['practical_match'])} END,
      CASE WHEN prestige >= 70 AND prestige_tier >= 4 THEN {q(T['prestige_match'])} END
    ], lambda x: x IS NOT NULL) AS reasons,
    list_filter([
      CASE WHEN verdict = 'unknown' THEN {q(T['cost_unknown'])} WHEN verdict = 'strong-financial-fit' AND total_annual_cost > budget_annual_usd THEN {q(T['in_ceiling_concern'])}
        WHEN verdict = 'potentially-affordable-with-aid' THEN {q(T['conditional'])} WHEN verdict = 'aid-dependent' AND aid_certainty = 'competitive' THEN {q(T['contest'])}
        WHEN verdict = 'aid-dependent' THEN {q(T['long_shot'])} WHEN verdict = 'above-budget' THEN {fill(T['above'], net=usd('best_case_net_cost'), gap=usd('funding_gap'))} END,
      CASE WHEN aid_need = 'full-ride' AND NOT ride AND ftuition THEN {q(T['ride_tuition_only'])} WHEN aid_need = 'full-ride' AND NOT ride THEN {q(T['ride_none'])}
        WHEN aid_need = 'full-tuition' AND NOT ride AND NOT ftuition THEN {q(T['tuition_no'])} WHEN aid_need = 'partial' AND NOT thick THEN {q(T['partial_no'])} END,
      CASE WHEN es = 'english-missing' AND english_planned THEN {fill(T['english_planned'], short='short_name', need=_need)} WHEN es = 'english-missing' THEN {fill(T['english_none'], short='short_name', need=_need)}
        WHEN es = 'english-below' THEN {fill(T['english_gap'], short='short_name', need=_need, band=_band, gap=num(_gap10), s=f"CASE WHEN {_gap10} = 0.5 THEN '' ELSE 's' END")} END,
      CASE WHEN ss = 'sat-below' THEN {fill(T['sat_below'], sat='sat_score', gap='(sat_target - sat_score)', target='sat_target')} WHEN ss = 'sat-missing' AND sat_policy = 'required' THEN {fill(T['sat_required'], short='short_name')}
        WHEN ss = 'sat-missing' AND sat_policy = 'recommended' THEN {q(T['sat_recommended'])} END,
      CASE WHEN gpa_norm IS NULL THEN {q(T['gpa_missing'])} WHEN delta < -3 THEN {fill(T['gpa_below'], gpa='gpa_r', bar='gpa_expectation')} END,
      CASE WHEN gpa_norm IS NOT NULL AND admission_selectivity = 'highly-selective' THEN {fill(T['highly_selective'], note='selectivity_note')} END,
      CASE WHEN major_score = 62 THEN {fill(T['major_adjacent'], label=_lab('intended_major'), closest=_lab('supported_majors[adjacent_pos]'))} WHEN major_score < 62 THEN {fill(T['major_no'], label=_lab('intended_major'))} END,
      CASE WHEN wants_specific AND NOT in_list AND in_region THEN {fill(T['geo_region'], country='country', region='region')} WHEN wants_specific AND NOT in_list THEN {fill(T['geo_no'], country='country')} END,
      CASE WHEN english_taught_only AND NOT teaches_english THEN {q(T['language'])} END,
      CASE WHEN prestige >= 70 AND prestige_tier <= 2 THEN {q(T['prestige_low'])} END,
      CASE WHEN size_preference <> 'no-preference' AND size_preference <> size THEN {fill(T['size_mismatch'], size='size', wanted='size_preference')} END
    ], lambda x: x IS NOT NULL) AS concerns
  FROM v_flag
)"""

M = fixed.SUMMARY
_clauses = f"""concat_ws(', ',
  CASE WHEN major_score >= 90 THEN {fill(M['offers'], major=_lab('intended_major'))} WHEN major_score >= 50 THEN {fill(M['adjacent'], major=_lab('intended_major'))} ELSE {fill(M['despite'], major=_lab('intended_major'))} END,
  CASE WHEN verdict = 'strong-financial-fit' THEN {fill(M['inside'], total=usd('total_annual_cost'))} WHEN verdict = 'potentially-affordable-with-aid' AND aid_certainty = 'meets-full-need' THEN {fill(M['full_need'], total=usd('total_annual_cost'), net=usd('best_case_net_cost'))}
    WHEN verdict = 'potentially-affordable-with-aid' THEN {fill(M['default_low'], net=usd('best_case_net_cost'))} WHEN verdict = 'aid-dependent' THEN {fill(M['contest'], total=usd('total_annual_cost'), net=usd('best_case_net_cost'))}
    WHEN verdict = 'above-budget' THEN {fill(M['above'], net=usd('best_case_net_cost'))} ELSE {q(M['unknown'])} END,
  CASE WHEN outside_preferred THEN {fill(M['outside'], country='country')} WHEN wants_specific AND in_list THEN {fill(M['preferred'], country='country')} WHEN open_to_any_country AND geography_score >= 85 THEN {fill(M['setting'], city='city')} END,
  CASE WHEN research >= 65 AND research_intensity >= 4 THEN {q(M['research'])} WHEN pref_scholarship >= 70 AND scholarship_availability = 'extensive' THEN {q(M['aid'])} END) || '.'"""
SUMMARY = (
    f"regexp_replace(regexp_replace({_clauses}, ', and it matches', ' and it matches'), ', and scholarship', ' and scholarship') || "
    "CASE WHEN len(concerns) > 0 THEN ' However: ' || lower(substr(concerns[1], 1, 1)) || substr(concerns[1], 2) ELSE '' END"
)


def _ranked(labels, order) -> str:
    items = ", ".join(f"{{'s': {d}_score * {order}, 'o': {i}, 'l': {q(t)}}}" for i, (d, t) in enumerate(labels))
    return f"list_sort([{items}])[1].l"


ADVANTAGE = _ranked(fixed.ADVANTAGE_LABELS, "-1")
_weakest = "least(" + ", ".join(f"{d}_score" for d, _ in fixed.CONCERN_LABELS) + ")"
CONCERN = f"(CASE WHEN {_weakest} >= 78 THEN 'No major concern' ELSE {_ranked(fixed.CONCERN_LABELS, '1')} END)"

# ---- comparison -----------------------------------------------------------

C = fixed.COMPARE_TEXT


def compare_sql(source: str) -> str:
    """source: relation with set_id, position, option columns and scores."""
    leads = ", ".join(
        f"{d}_score - (SELECT max(r.{d}_score) FROM v_set r WHERE r.set_id = a.set_id AND r.option_id <> a.option_id) AS lead_{d}" for d, _ in fixed.DIMENSION_LABELS
    )
    best = "list_sort([" + ", ".join(f"{{'s': -lead_{d}, 'o': {i}, 'l': {q(t)}}}" for i, (d, t) in enumerate(fixed.DIMENSION_LABELS)) + "])[1]"
    worst = "list_sort([" + ", ".join(f"{{'s': lead_{d}, 'o': {i}, 'l': {q(t)}}}" for i, (d, t) in enumerate(fixed.DIMENSION_LABELS)) + "])[1]"
    sat = "CASE WHEN sat_policy = 'not-used' THEN 'Not used' ELSE upper(substr(sat_policy, 1, 1)) || substr(sat_policy, 2) || CASE WHEN coalesce(recommended_sat, 0) <> 0 THEN ' (~' || recommended_sat || ')' ELSE '' END END"
    shown = {
        "country": ("country || ' — ' || city", "NULL"),
        "match": ("score || '%'", "score"),
        "program": ("CASE WHEN major_score >= 90 THEN coalesce(programs[1], 'Available') WHEN major_score >= 50 THEN 'Related programme only' ELSE 'Not offered' END", "major_score"),
        "tuition": (usd("tuition"), "tuition"), "living": (usd("living_cost"), "living_cost"), "netcost": (usd("best_case_net_cost"), "best_case_net_cost"),
        "financial": (case_map("verdict", fixed.VERDICT_LABELS), case_map("verdict", fixed.VERDICT_RANKS)),
        "scholarship": ("CASE WHEN full_ride_possible THEN 'Full cost possible' WHEN full_tuition_possible THEN 'Full tuition possible' WHEN scholarship_availability = 'extensive' THEN 'Extensive partial aid' WHEN scholarship_availability = 'moderate' THEN 'Moderate partial aid' ELSE 'Limited' END", "scholarship_score"),
        "ielts": (f"CASE WHEN minimum_ielts IS NOT NULL THEN 'IELTS ' || {num('minimum_ielts')} WHEN recommended_ielts IS NOT NULL THEN 'IELTS ~' || {num('recommended_ielts')} || ' (recommended)' ELSE 'Not published' END", "coalesce(minimum_ielts, recommended_ielts)"),
        "sat": (sat, "NULL"), "selectivity": (_spaced.format("admission_selectivity"), "NULL"),
        "deadline": ("coalesce(strftime(application_deadline, '%b %-d, %Y'), 'Not published')", "NULL"),
        "scholarship-deadline": ("coalesce(strftime(scholarship_deadline, '%b %-d, %Y'), 'Not published')", "NULL"),
        "advantage": ("advantage", "NULL"), "concern": ("concern", "NULL"),
    }
    metrics = " UNION ALL ".join(
        f"SELECT set_id, position, option_id, short_name, {i} AS metric_ordinal, {q(k)} AS metric, {q(lab)} AS label, {q(b) if b else 'CAST(NULL AS VARCHAR)'} AS better, {shown[k][0]} AS display, CAST({shown[k][1]} AS DOUBLE) AS numeric_value, {q(fixed.COMPARE_NOTES[k]) if k in fixed.COMPARE_NOTES else 'CAST(NULL AS VARCHAR)'} AS note FROM v_named"
        for i, (k, lab, b) in enumerate(fixed.COMPARE_METRICS)
    )
    return f"""
v_set AS ({source}),
v_lead AS (SELECT *, {leads}, (SELECT count(*) FROM v_set r WHERE r.set_id = a.set_id) AS set_size FROM v_set a),
v_named AS (
  SELECT *, CASE WHEN set_size = 1 THEN {ADVANTAGE} WHEN -{best}.s <= 0 THEN {fill(C['tie'], own=ADVANTAGE)} ELSE {fill(C['lead'], label=best + '.l', n='-' + best + '.s')} END AS advantage,
    CASE WHEN set_size = 1 THEN {CONCERN} WHEN {worst}.s >= 0 AND {CONCERN} = 'No major concern' THEN {q(C['nothing_weaker'])} WHEN {worst}.s >= 0 THEN {CONCERN}
      ELSE {fill(C['deficit'], label=worst + '.l', n=worst + '.s')} END AS concern
  FROM v_lead
),
v_metric AS ({metrics}),
v_winner AS (
  SELECT set_id, metric_ordinal, metric, label, arg_min(option_id, CASE better WHEN 'high' THEN -numeric_value ELSE numeric_value END * 1000 + position) AS winner
  FROM v_metric WHERE better IS NOT NULL AND numeric_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND min(numeric_value) <> max(numeric_value)
)"""


COMPARE = compare_sql("SELECT profile_id AS set_id, CAST(rank - 1 AS INTEGER) AS position, * FROM v_shortlist WHERE rank <= 4")

# ---- diagnostics ----------------------------------------------------------

G, DG, N = fixed.GAPS, fixed.DIAG, fixed.INSIGHTS
FACTS = """
v_fact0 AS (
  SELECT profile_id, count(*) AS results, max(mode) AS mode, count(*) FILTER (WHERE es = 'english-below') AS english_below,
    count(*) FILTER (WHERE es IN ('english-met', 'english-strong')) AS english_ok, max(coalesce(ielts_need, 6.5e0)) FILTER (WHERE es = 'english-below') AS english_target,
    greatest(max(coalesce(ielts_need, 6.5e0)), 6.5e0) AS english_needed, count(*) FILTER (WHERE sat_policy IN ('required', 'recommended')) AS sat_needed,
    count(*) FILTER (WHERE sat_policy = 'required') AS sat_required,
    array_to_string(list_slice(list(short_name ORDER BY rank) FILTER (WHERE sat_policy IN ('required', 'recommended')), 1, 3), ', ') AS sat_names,
    count(*) FILTER (WHERE ss = 'sat-below') AS sat_below, max(coalesce(recommended_sat, 0)) FILTER (WHERE ss = 'sat-below') AS sat_goal,
    count(*) FILTER (WHERE verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS need_aid, count(*) FILTER (WHERE verdict = 'aid-dependent') AS contested,
    count(*) FILTER (WHERE admission_selectivity = 'highly-selective') AS selective, min(application_deadline) AS earliest
  FROM v_flag GROUP BY profile_id
),
v_fact AS (SELECT p.*, f.* EXCLUDE (profile_id), c.* EXCLUDE (profile_id) FROM v_profile p JOIN v_fact0 f USING (profile_id) JOIN v_counts c USING (profile_id))"""


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_gpa_r = "CAST(floor(gpa_norm + 0.5e0) AS BIGINT)"
DIMENSIONS = _union([
    f"""SELECT profile_id, 0 AS ordinal, 'academics' AS dimension, 'Academics' AS label, CASE WHEN gpa_norm IS NULL THEN 'unknown' WHEN gpa_norm >= 92 THEN 'strong' WHEN gpa_norm >= 84 THEN 'competitive' WHEN gpa_norm >= 75 THEN 'moderate' ELSE 'needs-improvement' END AS level,
      CAST(CASE WHEN gpa_norm IS NULL THEN 40 ELSE {_gpa_r} END AS INTEGER) AS value,
      CASE WHEN gpa_norm IS NULL THEN {q(DG['gpa_none'])} ELSE {fill(DG['gpa'], gpa=_gpa_r, rank="CASE WHEN class_rank NOT IN ('unknown', 'other') THEN " + fill(DG['rank'], rank="replace(class_rank, 'top-', 'top ')") + " ELSE '' END")} END AS detail FROM v_fact""",
    f"""SELECT profile_id, 1, 'english', 'English', CASE WHEN ielts_band IS NULL THEN 'needs-improvement' WHEN ielts_band >= 6.5 THEN 'ready' WHEN ielts_band >= 6 THEN 'moderate' ELSE 'needs-improvement' END,
      CAST(CASE WHEN ielts_band IS NULL THEN 25 ELSE {rnd('ielts_band / 9e0 * 100e0')} END AS INTEGER),
      CASE WHEN ielts_band IS NULL AND english_planned THEN {q(DG['english_planned'])} WHEN ielts_band IS NULL THEN {q(DG['english_none'])} WHEN english_below = 0 THEN {fill(DG['english_ok'], band=_band)} ELSE {fill(DG['english_short'], band=_band, n='english_below', total='results')} END FROM v_fact""",
    f"""SELECT profile_id, 2, 'testing', 'Standardized Testing', CASE WHEN sat_score IS NULL AND sat_needed > 0 THEN 'needs-improvement' WHEN sat_score IS NULL THEN 'moderate' WHEN sat_below = 0 THEN 'strong' WHEN sat_below <= 2 THEN 'competitive' ELSE 'needs-improvement' END,
      CAST(CASE WHEN sat_score IS NULL THEN 30 ELSE least(100, {rnd('CAST(sat_score - 800 AS DOUBLE) / 800e0 * 100e0')}) END AS INTEGER),
      CASE WHEN sat_score IS NULL AND sat_needed > 0 THEN {fill(DG['sat_needed'], n='sat_needed')} WHEN sat_score IS NULL THEN {q(DG['sat_free'])} WHEN sat_below = 0 THEN {fill(DG['sat_ok'], sat='sat_score')} ELSE {fill(DG['sat_short'], sat='sat_score', n='sat_below')} END FROM v_fact""",
    f"""SELECT profile_id, 3, 'financial', 'Financial Flexibility', CASE WHEN ceiling >= 45000 THEN 'strong' WHEN ceiling >= 22000 THEN 'moderate' ELSE 'limited' END, CAST(least(100, {rnd('CAST(ceiling AS DOUBLE) / 60000e0 * 100e0')}) AS INTEGER),
      {fill(DG['finance'], budget=usd('budget_annual_usd'), ceiling=usd('ceiling'), n='affordable_count', total='option_count')} FROM v_fact""",
    f"""SELECT profile_id, 4, 'scholarship', 'Scholarship Dependence', {case_map('aid_need', fixed.AID_NEED_LEVEL)}, CAST({case_map('aid_need', fixed.AID_NEED_VALUE)} AS INTEGER), {case_map('aid_need', fixed.AID_NEED_DETAIL)} FROM v_fact""",
    f"""SELECT profile_id, 5, 'selectivity', 'Target Selectivity', CASE WHEN selective * 1e0 / results >= 0.6e0 THEN 'very-high' WHEN selective * 1e0 / results >= 0.3e0 THEN 'competitive' ELSE 'moderate' END, CAST({rnd('selective * 1e0 / results * 100e0')} AS INTEGER),
      {fill(DG['selectivity'], n='selective', total='results')} FROM v_fact""",
])

_uni = "CASE WHEN english_below = 1 THEN 'university' ELSE 'universities' END"
GAPS = _union([
    f"SELECT profile_id, 0 AS ordinal, 'gpa-missing' AS gap, {q(G['gpa-missing'][0])} AS title, {q(G['gpa-missing'][1])} AS detail, 'medium' AS severity FROM v_fact WHERE gpa_norm IS NULL",
    f"SELECT profile_id, 1, 'english-missing', {q(G['english-missing'][0])}, {q(G['english-missing'][1])}, 'high' FROM v_fact WHERE ielts_band IS NULL",
    f"SELECT profile_id, 2, 'english-below', {fill(G['english-below'][0], n='english_below', noun=_uni)}, {fill(G['english-below'][1], band=_band, need=num('english_target'))}, 'high' FROM v_fact WHERE ielts_band IS NOT NULL AND english_below > 0",
    f"SELECT profile_id, 3, 'sat-missing', {q(G['sat-missing'][0])}, {fill(G['sat-missing'][1], names='sat_names')}, CASE WHEN sat_required > 0 THEN 'high' ELSE 'medium' END FROM v_fact WHERE sat_score IS NULL AND sat_needed > 0",
    f"SELECT profile_id, 4, 'sat-below', {q(G['sat-below'][0])}, {fill(G['sat-below'][1], sat='sat_score', target='sat_goal', n='sat_below')}, 'medium' FROM v_fact WHERE sat_score IS NOT NULL AND sat_below >= 2",
    f"SELECT profile_id, 5, 'scholarship-dependence', {q(G['scholarship-dependence'][0])}, {fill(G['scholarship-dependence'][1], n='need_aid', m='contested')}, 'high' FROM v_fact WHERE aid_need IN ('full-ride', 'full-tuition')",
    f"SELECT profile_id, 6, 'narrow-geography', {q(G['narrow-geography'][0])}, {q(G['narrow-geography'][1])}, 'low' FROM v_fact WHERE NOT open_to_any_country AND len(preferred_countries) = 1",
])
NOTICE = f"""CASE WHEN mode = 2 THEN {q(fixed.NOTICE_TIGHT)} WHEN mode = 3 AND open_to_any_country THEN {q(fixed.NOTICE_OPEN)}
  WHEN mode = 3 THEN {fill(fixed.NOTICE_WIDENED, noun="CASE WHEN len(preferred_countries) = 1 THEN 'country' ELSE 'countries' END", chosen="array_to_string(preferred_countries, ', ')")} END"""
INSIGHTS = "SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY o) - 1 AS INTEGER) AS ordinal, insight FROM (" + _union([
    f"SELECT profile_id, 0 AS o, {q(N['strong_poor'])} AS insight FROM v_fact WHERE gpa_norm >= 88 AND ceiling < 15000",
    f"SELECT profile_id, 1, {fill(N['english'], n='english_ok', total='results')} FROM v_fact WHERE ielts_band >= 6.5",
    f"SELECT profile_id, 2, {fill(N['sat_missing'], n='sat_needed')} FROM v_fact WHERE sat_score IS NULL AND sat_needed >= 2",
    f"SELECT profile_id, 3, {fill(N['sat_low'], target='greatest(1450, sat_score + 60)')} FROM v_fact WHERE sat_score < 1450",
    f"SELECT profile_id, 4, {fill(N['out_of_reach'], n='above_budget_count', total='option_count')} FROM v_fact WHERE above_budget_count > option_count / 2",
    f"SELECT profile_id, 5, {fill(N['single'], country='preferred_countries[1]')} FROM v_fact WHERE NOT open_to_any_country AND len(preferred_countries) = 1",
    f"SELECT profile_id, 6, {NOTICE} FROM v_fact WHERE mode > 1",
]) + ") x QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY o) <= 5"

# ---- roadmap --------------------------------------------------------------

K = fixed.TASKS
_TODAY = "DATE '2026-09-01'"


def _due(days: int) -> str:
    return f"(CASE WHEN anchor - {days} < {_TODAY} THEN {_TODAY} + 3 ELSE anchor - {days} END)"


def _row(i, task_id, title, description, category, due, priority, rationale, where="true", source="v_plan", option="CAST(NULL AS BIGINT)"):
    return (f"SELECT profile_id, CAST({i} AS INTEGER) AS ordinal, {task_id} AS task_id, {title} AS title, {description} AS description, {q(category)} AS category, CAST({due} AS DATE) AS due_date, "
            f"{priority} AS priority, {rationale} AS rationale, {option} AS option_id FROM {source} WHERE {where}")


def _deadline(fallback: str) -> str:
    return f"coalesce({_LONG.format('earliest')}, {q(fallback)})"


_more = "CASE WHEN sat_needed > 3 THEN 'and ' || (sat_needed - 3) || ' more ' ELSE '' END"
ROADMAP = f"""
v_gap AS ({GAPS}),
v_plan AS (
  SELECT f.*, coalesce(earliest, {_TODAY} + 120) AS anchor,
    (SELECT detail FROM v_gap g WHERE g.profile_id = f.profile_id AND gap IN ('english-missing', 'english-below')) AS english_gap,
    (SELECT detail FROM v_gap g WHERE g.profile_id = f.profile_id AND gap IN ('sat-missing', 'sat-below')) AS sat_gap
  FROM v_fact f
),
v_first5 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY coalesce(application_deadline, DATE '9999-12-31'), rank) AS deadline_rank,
    application_deadline - {_TODAY} AS days, scholarship_deadline - {_TODAY} AS sdays FROM v_flag) x WHERE deadline_rank <= 5
),
v_task0 AS ({_union([
    _row(0, q('shortlist-review'), q(K['shortlist-review'][0]), fill(K['shortlist-review'][1], n='results'), 'shortlist', f'{_TODAY} + 7', q('critical'), q(K['shortlist-review'][2])),
    _row(1, q('shortlist-compare'), q(K['shortlist-compare'][0]), q(K['shortlist-compare'][1]), 'shortlist', f'{_TODAY} + 12', q('high'), q(K['shortlist-compare'][2])),
    _row(2, q('english-register'), q(K['english-register-new'][0]), fill(K['english-register-new'][1], deadline=_deadline('your first deadline')), 'tests', f'{_TODAY} + 10', q('critical'), 'english_gap', 'english_gap IS NOT NULL AND ielts_band IS NULL'),
    _row(2, q('english-register'), fill(K['english-register-retake'][0], need=num('english_needed')), fill(K['english-register-retake'][1], band=_band, need=num('english_needed')), 'tests', f'{_TODAY} + 10', q('critical'), 'english_gap', 'english_gap IS NOT NULL AND ielts_band IS NOT NULL'),
    _row(3, q('english-prep'), q(K['english-prep'][0]), q(K['english-prep'][1]), 'tests', f'{_TODAY} + 38', q('high'), 'english_gap', 'english_gap IS NOT NULL'),
    _row(4, q('english-send'), q(K['english-send'][0]), fill(K['english-send'][1], band=_band, deadline=_deadline('coming up')), 'documents', _due(21), q('high'), q(K['english-send'][2]), 'english_gap IS NULL AND ielts_band IS NOT NULL'),
    _row(5, q('sat-register'), fill(K['sat-register'][0], kind="CASE WHEN sat_score IS NULL THEN 'sitting' ELSE 'retake' END"), fill(K['sat-register'][1], names='sat_names', more=_more, deadline=_deadline('your earliest deadline')), 'tests', f'{_TODAY} + 21', "CASE WHEN sat_required > 0 THEN 'critical' ELSE 'high' END", 'sat_gap', 'sat_gap IS NOT NULL AND sat_needed > 0'),
    _row(6, q('sat-prep'), q(K['sat-prep'][0]), q(K['sat-prep'][1]), 'tests', f'{_TODAY} + 40', q('normal'), 'sat_gap', 'sat_gap IS NOT NULL AND sat_needed > 0'),
    _row(7, q('doc-statement'), q(K['doc-statement'][0]), fill(K['doc-statement'][1], major=_lab('intended_major')), 'documents', _due(45), q('high'), q(K['doc-statement'][2])),
    _row(8, q('doc-recommendations'), q(K['doc-recommendations'][0]), q(K['doc-recommendations'][1]), 'documents', _due(40), q('high'), q(K['doc-recommendations'][2])),
    _row(9, q('doc-transcript'), q(K['doc-transcript'][0]), q(K['doc-transcript'][1]), 'documents', _due(30), q('normal'), q(K['doc-transcript'][2])),
    _row(10, q('doc-financial'), q(K['doc-financial'][0]), fill(K['doc-financial'][1], need=case_map('aid_need', fixed.AID_NEED_TASK_TEXT)), 'scholarships', _due(35), q('critical'), fill(K['doc-financial'][2], budget=usd('budget_annual_usd')), "aid_need <> 'none'"),
    _row('20 + deadline_rank * 2', "'apply-' || option_id", fill(K['apply'][0], short='short_name'), fill(K['apply'][1], platform='application_platform', deadline=_LONG.format('application_deadline')), 'applications', 'application_deadline', "CASE WHEN days <= 45 THEN 'critical' WHEN days <= 90 THEN 'high' ELSE 'normal' END", fill(K['apply'][2], short='short_name', category='category', score='score'), 'application_deadline IS NOT NULL', 'v_first5', 'option_id'),
    _row('21 + deadline_rank * 2', "'scholarship-' || option_id", fill(K['scholarship'][0], short='short_name'), 'aid_note', 'scholarships', 'scholarship_deadline', "CASE WHEN sdays <= 60 THEN 'critical' ELSE 'high' END",
         f"CASE verdict WHEN 'aid-dependent' THEN {fill(fixed.SCHOLARSHIP_RATIONALE['aid-dependent'], short='short_name')} WHEN 'potentially-affordable-with-aid' THEN {fill(fixed.SCHOLARSHIP_RATIONALE['potentially-affordable-with-aid'], short='short_name')} ELSE {fill(fixed.SCHOLARSHIP_RATIONALE['other'], budget=usd('budget_annual_usd'))} END",
         "scholarship_deadline IS NOT NULL AND aid_need <> 'none' AND scholarship_availability <> 'rare-for-international'", 'v_first5', 'option_id'),
])}),
v_task1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY due_date, ordinal) AS INTEGER) AS position, strftime(due_date, '%Y-%m') AS month_key FROM v_task0),
v_done AS (
  SELECT user_id AS profile_id, ['shortlist-review', 'shortlist-compare', 'english-register', 'english-prep', 'english-send', 'sat-register', 'sat-prep',
    'doc-statement', 'doc-recommendations', 'doc-transcript', 'doc-financial', 'apply-0'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 + 1] AS task_id, count(*) % 2 = 1 AS done
  FROM events WHERE event_type = 'click' GROUP BY ALL
),
v_task AS (SELECT t.*, coalesce(d.done, false) AS done FROM v_task1 t LEFT JOIN v_done d USING (profile_id, task_id))"""

TEXT_ALL = with_(PROFILE, OPTION, SCORED, SHORTLIST, TEXTS)
COMPARE_ALL = with_(PROFILE, OPTION, SCORED, SHORTLIST, COMPARE)
FACTS_ALL = with_(PROFILE, OPTION, SCORED, SHORTLIST, TEXTS, FACTS)
ROADMAP_ALL = with_(PROFILE, OPTION, SCORED, SHORTLIST, TEXTS, FACTS, ROADMAP)

# ---- what-if --------------------------------------------------------------

_pv = "[" + ", ".join(str(v) for _, _, v, _, _ in fixed.BUDGET_PRESETS) + "]"
_pn = lst([n for _, _, _, n, _ in fixed.BUDGET_PRESETS])
AFTER_PROFILE = f"""
v_after0 AS (
  SELECT * REPLACE (CAST({_pv}[CAST(profile_id % 5 AS INTEGER) + 1] AS BIGINT) AS budget_annual_usd, CAST({_pv}[CAST(profile_id % 5 AS INTEGER) + 1] AS BIGINT) AS max_affordable_annual_usd,
    CAST({_pv}[CAST(profile_id % 5 AS INTEGER) + 1] AS BIGINT) AS ceiling, {_pn}[CAST(profile_id % 5 AS INTEGER) + 1] AS aid_need,
    CASE WHEN profile_id % 3 = 0 THEN list_slice(preferred_countries, 1, 1) ELSE preferred_countries END AS preferred_countries)
  FROM v_profile
),
v_after AS (SELECT * REPLACE (NOT open_to_any_country AND len(preferred_countries) > 0 AS wants_specific) FROM v_after0)"""
BOTH_SIDES = with_(PROFILE, OPTION, SCORED, SHORTLIST, AFTER_PROFILE, scored_sql("v_after", "_a"), shortlist_sql("_a"))

W = fixed.WHATIF


def _delta(key, d, one, many, direction_up="up", direction_down="down"):
    return (f"CASE WHEN {d} <> 0 THEN CASE WHEN {d} > 0 THEN '{direction_up}: ' ELSE '{direction_down}: ' END || "
            + fill(W[key], sign=f"CASE WHEN {d} > 0 THEN '+' ELSE '−' END", n=f"abs({d})", noun=f"CASE WHEN abs({d}) = 1 THEN {q(one)} ELSE {q(many)} END") + " END")


def _moved(key, col, direction):
    return (f"CASE WHEN len({col}) > 0 THEN '{direction}: ' || " + fill(
        W[key], n=f"len({col})", s=f"CASE WHEN len({col}) = 1 THEN '' ELSE 's' END", names=f"array_to_string(list_slice({col}, 1, 4), ', ')",
        more=f"CASE WHEN len({col}) > 4 THEN ', +' || (len({col}) - 4) || ' more' ELSE '' END") + " END")


_w0 = "CASE WHEN b.open_to_any_country THEN ['Open to any'] ELSE b.preferred_countries END"
_w1 = "CASE WHEN a.open_to_any_country THEN ['Open to any'] ELSE a.preferred_countries END"


def _shown(w):
    return f"CASE WHEN len({w}) > 0 THEN array_to_string({w}, ' + ') ELSE 'nothing selected' END"


WHATIF_SQL = BOTH_SIDES + f"""
, s AS (
  SELECT p.profile_id,
    coalesce((SELECT list(short_name ORDER BY rank) FROM v_shortlist_a x WHERE x.profile_id = p.profile_id AND option_id NOT IN (SELECT option_id FROM v_shortlist y WHERE y.profile_id = p.profile_id)), []) AS entered,
    coalesce((SELECT list(short_name ORDER BY rank) FROM v_shortlist x WHERE x.profile_id = p.profile_id AND option_id NOT IN (SELECT option_id FROM v_shortlist_a y WHERE y.profile_id = p.profile_id)), []) AS gone,
    (SELECT short_name FROM v_shortlist x WHERE x.profile_id = p.profile_id AND rank = 1) AS t0, (SELECT short_name FROM v_shortlist_a x WHERE x.profile_id = p.profile_id AND rank = 1) AS t1,
    (SELECT count(*) FROM v_shortlist x WHERE x.profile_id = p.profile_id AND verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS d0,
    (SELECT count(*) FROM v_shortlist_a x WHERE x.profile_id = p.profile_id AND verdict IN ('potentially-affordable-with-aid', 'aid-dependent')) AS d1,
    (SELECT count(*) FROM v_shortlist_a x WHERE x.profile_id = p.profile_id) AS after_size
  FROM v_profile p
), e AS (
  SELECT b.profile_id,
    concat_ws(' ', CASE WHEN b.max_affordable_annual_usd <> a.max_affordable_annual_usd THEN {fill(W['budget'], before=usd('b.max_affordable_annual_usd'), after=usd('a.max_affordable_annual_usd'))} END,
      CASE WHEN array_to_string({_w0}, ',') <> array_to_string({_w1}, ',') THEN {fill(W['countries'], before=_shown(_w0), after=_shown(_w1))} END,
      CASE WHEN b.aid_need <> a.aid_need THEN {fill(W['need'], before="regexp_replace(b.aid_need, '-', ' ')", after="regexp_replace(a.aid_need, '-', ' ')")} END) AS h,
    list_filter([{_delta('affordable', '(ca.affordable_count - cb.affordable_count)', 'university is', 'universities are')}, {_delta('aid', '(ca.aid_dependent_count - cb.aid_dependent_count)', 'university', 'universities')},
      {_delta('over', '(ca.above_budget_count - cb.above_budget_count)', 'university', 'universities', 'down', 'up')}, {_moved('entered', 'entered', 'up')}, {_moved('left', 'gone', 'down')},
      CASE WHEN t0 <> t1 THEN 'neutral: ' || {fill(W['top'], before='t0', after='t1')} END,
      CASE WHEN d0 <> d1 THEN CASE WHEN d1 < d0 THEN 'up: ' ELSE 'down: ' END || {fill(W['dependence'], verb="CASE WHEN d1 < d0 THEN 'decreased' ELSE 'increased' END", before='d0', after='d1', n='after_size')} END
    ], lambda x: x IS NOT NULL) AS items
  FROM v_profile b JOIN v_after a USING (profile_id) JOIN v_counts cb USING (profile_id) JOIN v_counts_a ca USING (profile_id) JOIN s USING (profile_id)
) SELECT profile_id, CASE WHEN h = '' THEN 'Your parameters changed.' ELSE h END AS headline, array_to_string(items, ' | ') AS effects, len(items) = 0 AS no_change FROM e"""
