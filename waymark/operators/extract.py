"""Page content to candidate values with their sentence, year and confidence; candidates to one outcome per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import signals
from waymark.functions import html as H, scalar as S
from waymark.operators import evidence as E
from waymark.operators.pages import academic_years

def spans(text: Column, pattern: str) -> Column:
    """All matches with their zero-based start: the pieces between matches give the offsets."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    total = lambda items: F.aggregate(items, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.transform(hits, lambda h, i: F.named_struct(
        F.lit("hit"), h, F.lit("start"), total(F.slice(parts, F.lit(1), i + 1)) + total(F.slice(hits, F.lit(1), i)), F.lit("n"), i,
    ))


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentence(text: Column, start: Column, length: Column) -> Column:
    """The sentence or line that owns a match, never a fixed window."""
    before = F.regexp_extract(F.substring(text, F.lit(1), start), r"([^.\n]*)$", 1)
    after = F.regexp_extract(F.substr(text, start + length + 1), r"^([^.\n]*[.\n]?)", 1)
    return squeeze(F.concat(before, F.substring(text, start + 1, length), after))


def excerpt(text: Column, start: Column, length: Column, pad: int) -> Column:
    first = F.greatest(start - pad, F.lit(0))
    return squeeze(F.substring(text, first + 1, start + length + pad - first))


def first_excerpt(text: Column, pattern: str, pad: int = 150) -> Column:
    """The surroundings of a pattern's first match, or null."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, excerpt(text, at - 1, F.length(F.regexp_extract(text, pattern, 0)), pad))


def not_a_price(sentence_col: Column) -> Column:
    reason = None
    for pattern, why in signals.NOT_A_PRICE:
        cond = sentence_col.rlike(pattern)
        reason = F.when(cond, F.lit(why)) if reason is None else reason.when(cond, F.lit(why))
    return reason


def money_tokens(rows: DataFrame, text: str) -> DataFrame:
    """One row per amount in ``text``: value, currency, unit, annual flag and owning sentence."""
    out = rows.withColumn("m", F.explode(spans(F.col(text), signals.MONEY)))
    start, size = F.col("m.start"), F.length("m.hit")
    out = out.withColumns({
        "start": start, "token": F.col("m.n"), "value": F.expr("try_cast(regexp_replace(m.hit, '[^0-9.]', '') AS decimal(18,2))"),
        "currency": F.element_at(S.lit_map(signals.CURRENCIES), F.regexp_extract("m.hit", signals.SYMBOL, 1)),
        "sentence": sentence(F.col(text), start, size),
    }).drop("m").where(F.col("value") > 0)
    return with_unit(out)


def with_unit(rows: DataFrame) -> DataFrame:
    unit = None
    for pattern, name in signals.PER_UNIT:
        cond = F.col("sentence").rlike(pattern)
        unit = F.when(cond, F.lit(name)) if unit is None else unit.when(cond, F.lit(name))
    annual = F.col("sentence").rlike(signals.ANNUAL)
    return rows.withColumn("_per", unit).withColumns({
        "unit": F.coalesce("_per", F.when(annual, F.lit("per-year")), F.lit("unqualified")), "is_annual": annual & F.col("_per").isNull(),
    }).drop("_per")


def _word(terms) -> str:
    return r"(?i)\b(" + "|".join(terms) + r")\b"


def nearest(text: Column, start: Column, terms) -> Column:
    """Distance from a figure to the nearest of the terms, or null."""
    found = F.transform(spans(text, _word(sorted(terms, key=len, reverse=True))), lambda s: F.abs(s["start"] - start))
    return F.array_min(found)


def table_cells(pages: DataFrame) -> DataFrame:
    """(page, table, row, column) cells with the row label and every year they name."""
    kept = ["institution_id", "page_id", *[c for c in ("page_years",) if c in pages.columns]]
    t = pages.select(*kept, F.posexplode(H.tables_of(F.col("main_html"))).alias("table_no", "rows"))
    r = t.select(*kept, "table_no", F.posexplode("rows").alias("row_no", "cells"))
    return r.select(
        *kept, "table_no", "row_no", F.get("cells", F.lit(0)).alias("row_label"), academic_years(F.array_join("cells", " ")).alias("row_years"),
        F.posexplode("cells").alias("col_no", "cell"),
    )


def header_years(cells: DataFrame) -> DataFrame:
    """Each cell with its column's header: the first row of its table that names a year."""
    whole = Window.partitionBy("page_id", "table_no")
    header_row = F.min(F.when(F.size("row_years") > 0, F.col("row_no"))).over(whole)
    marked = cells.withColumn("header_row", header_row)
    column = Window.partitionBy("page_id", "table_no", "col_no")
    named = F.max(F.when(F.col("row_no") == F.col("header_row"), F.col("cell"))).over(column)
    return marked.withColumn("column_label", F.coalesce(named, F.lit(""))).where(
        F.col("header_row").isNull() | (F.col("row_no") != F.col("header_row"))
    ).withColumn("column_years", academic_years(F.col("column_label")))


def _attributed(rows: DataFrame, scope_years: Column, source: Column) -> DataFrame:
    one, many = F.size(scope_years) == 1, F.size(scope_years) > 1
    page_one = F.size("page_years") == 1
    return rows.withColumns({
        "academic_year": F.when(one, F.get(scope_years, F.lit(0))).when(~many & page_one, F.get("page_years", F.lit(0))),
        "year_source": F.when(one, source).when(~many & page_one, F.lit("page")),
        "year_ambiguous": many | (~one & (F.size("page_years") > 1)),
    })


MONEY_COLUMNS = ["institution_id", "page_id", "field", "value", "currency", "unit", "is_annual", "academic_year", "year_source", "year_ambiguous", "sentence", "ordinal", "excluded"]


def money_scoped(pages: DataFrame, fields: dict | None = None) -> DataFrame:
    """Figures per field with the year their column, row, section or page states; excluded figures keep their reason."""
    fields = fields or signals.MONEY_FIELDS
    pages = pages.select("institution_id", "page_id", "main_html", academic_years(F.col("text")).alias("page_years"))
    # tables
    cells = header_years(table_cells(pages))
    in_cells = money_tokens(cells.where(F.col("cell").rlike(r"\d")), "cell")
    in_cells = with_unit(in_cells.withColumn("sentence", squeeze(F.concat_ws(" ", "row_label", "column_label", "cell"))))
    by_column = F.size("column_years") == 1
    scope_years = F.when(by_column, F.col("column_years")).otherwise(F.col("row_years"))
    in_cells = _attributed(in_cells, scope_years, F.when(by_column, F.lit("table-column")).otherwise(F.lit("table-row")))
    label = F.concat_ws(" ", "row_label", "column_label")
    tabled = in_cells.withColumn("ordinal", F.col("table_no") * 1000000 + F.col("row_no") * 1000 + F.col("col_no")).withColumn("field", F.explode(F.array(*[
        F.when(label.rlike(_word(terms)), F.lit(name)) for name, terms in fields.items()
    ]))).where(F.col("field").isNotNull()).withColumn("excluded", not_a_price(F.col("sentence")))
    # prose, section by section
    sections = pages.select("institution_id", "page_id", "page_years", F.posexplode(H.sections_of(F.regexp_replace("main_html", H.TABLE, " "))).alias("section_no", "s"))
    sections = sections.withColumn("section_text", F.concat(F.col("s.heading"), F.lit("\n"), F.col("s.body"))).drop("s")
    prose = money_tokens(sections, "section_text").withColumn("section_years", academic_years(F.col("section_text")))
    prose = _attributed(prose, F.col("section_years"), F.lit("section"))
    judged = []
    for name, terms in fields.items():
        aggregate = any(t in signals.AGGREGATE_CONCEPTS for t in terms)
        others = [t for t in (signals.AGGREGATE_CONCEPTS if aggregate else signals.COST_CONCEPTS) if t not in terms]
        mine, theirs = nearest(F.col("section_text"), F.col("start"), terms), nearest(F.col("section_text"), F.col("start"), others)
        judged.append(F.when(F.col("sentence").rlike(_word(terms)), F.struct(F.lit(name).alias("field"), (theirs < mine).alias("other"))))
    found = prose.withColumn("f", F.explode(S.texts(*judged)))
    worded = found.withColumns({
        "field": F.col("f.field"), "ordinal": F.lit(10**9).cast("bigint") + F.col("section_no") * 1000000 + F.col("start"),
        "excluded": F.when(F.col("f.other"), F.lit(signals.OTHER_COMPONENT)).otherwise(not_a_price(F.col("sentence"))),
    })
    return tabled.withColumn("ordinal", F.col("ordinal").cast("bigint")).select(*MONEY_COLUMNS).unionByName(worded.select(*MONEY_COLUMNS))


def ielts_scores(pages: DataFrame) -> DataFrame:
    pattern = r"(?i)IELTS[^.\n]{0,120}?\d(?:\.\d)?|\d(?:\.\d)?[^.\n]{0,80}?IELTS"
    t = F.col("text")
    out = pages.select("institution_id", "page_id", "text", F.explode(spans(t, pattern)).alias("m"))
    score = F.coalesce(F.expr("try_cast(nullif(regexp_extract(m.hit, '(?i)^IELTS[^.\\\\n]*?(\\\\d(?:\\\\.\\\\d)?)$', 1), '') AS double)"),
                       F.expr("try_cast(regexp_extract(m.hit, '^(\\\\d(?:\\\\.\\\\d)?)', 1) AS double)"))
    context = excerpt(t, F.col("m.start"), F.length("m.hit"), 150)
    section, overall = context.rlike(signals.SECTION_MINIMUM), context.rlike(signals.OVERALL_SCORE)
    return out.select(
        "institution_id", "page_id", F.col("m.n").alias("ordinal"), score.alias("score"),
        F.when(section & ~overall, "section").when(overall, "overall").otherwise("unqualified").alias("score_kind"), context.alias("excerpt"),
    ).where(F.col("score").between(4, 9) & (F.col("score") * 2 == F.floor(F.col("score") * 2)))


def toefl_scores(pages: DataFrame) -> DataFrame:
    out = pages.select("institution_id", "page_id", "text", F.explode(spans(F.col("text"), r"(?i)TOEFL[^.\n]{0,120}?\d{2,3}")).alias("m"))
    return out.select(
        "institution_id", "page_id", F.col("m.n").alias("ordinal"), F.regexp_extract("m.hit", r"(\d{2,3})$", 1).cast("double").alias("score"),
        excerpt(F.col("text"), F.col("m.start"), F.length("m.hit"), 150).alias("excerpt"),
    ).where(F.col("score").between(30, 120))


def testing_policy(text: Column) -> Column:
    """The distinct policies a text states; more than one is ambiguous."""
    return F.array_distinct(S.texts(*[F.when(text.rlike(p), F.lit(name)) for name, p in signals.TESTING_PATTERNS]))


def aid_signals(pages: DataFrame) -> DataFrame:
    t = F.col("text")
    contest = F.transform(spans(t, signals.COMPETITIVE), lambda s: sentence(t, s["start"], F.length(s["hit"])))
    first = F.get(F.filter(contest, lambda s: s.rlike(signals.AID_CONTEXT)), F.lit(0))
    return pages.withColumns({name: t.rlike(p) for name, p in signals.AID_PATTERNS.items()} | {"contest_sentence": first}).withColumn(
        "competitive_award", F.col("contest_sentence").isNotNull(),
    )


def aid_flags(rows: DataFrame) -> DataFrame:
    """Three-state evidence per aid field, with the page's issues and excerpt: silence is UNKNOWN, never false."""
    closed, open_ = F.col("international_excluded"), F.col("international_eligible")
    full, ride, tuition = F.col("meets_full_need"), F.col("full_ride"), F.col("full_tuition")

    def flag(field, cond, value, why, silent):
        state = F.when(closed, "CONTRADICTED").when(open_ & cond, "SUPPORTED").otherwise("UNKNOWN")
        return F.struct(
            F.lit(field).alias("field"), state.alias("state"), F.when(closed, F.lit("false")).when(open_ & cond, F.lit(value)).alias("value"),
            F.when(closed, F.lit(signals.AID_EXCLUDED)).when(~open_, F.lit(signals.AID_SILENT)).when(cond, F.lit(why)).otherwise(F.lit(silent)).alias("reason"),
        )

    contest = F.concat(F.lit(signals.AID_CONTEST), F.substring("contest_sentence", 1, 120), F.lit('"'))
    unclear = F.when(F.col("any_scholarship"), F.lit(signals.AID_UNCLEAR)).otherwise(F.lit(signals.AID_NOTHING))
    certainty = F.struct(
        F.lit("aidCertainty").alias("field"),
        F.when(closed, "SUPPORTED").when(open_ & (full | F.col("competitive_award")), "SUPPORTED").otherwise("UNKNOWN").alias("state"),
        F.when(closed, F.lit("minimal")).when(open_ & full, F.lit("meets-full-need")).when(open_ & F.col("competitive_award"), F.lit("competitive")).alias("value"),
        F.when(closed, F.lit(signals.AID_EXCLUDED)).when(~open_, F.lit(signals.AID_SILENT)).when(full, F.lit(signals.AID_CERTAIN))
        .when(F.col("competitive_award"), contest).otherwise(unclear).alias("reason"),
    )
    items = F.array(
        flag("meetsFullNeedForInternationals", full, "true", signals.AID_FULL_NEED, signals.AID_NO_FULL_NEED),
        flag("fullRidePossible", ride, "true", signals.AID_RIDE, signals.AID_NO_RIDE),
        flag("fullTuitionPossible", tuition | ride, "true", signals.AID_TUITION, signals.AID_NO_TUITION),
        flag("needBasedAidForInternationals", full | F.col("need_blind"), "true", signals.AID_NEED_BASED, signals.AID_NO_NEED_BASED),
        certainty,
    )
    issues = F.when(closed, S.str_array([signals.AID_EXCLUDED])).otherwise(S.texts(
        F.when(~open_, F.lit(signals.AID_ISSUE_SILENT)), F.when(F.col("any_scholarship") & ~tuition & ~ride, F.lit(signals.AID_ISSUE_SIZE)),
        F.when(tuition & ~ride, F.lit(signals.AID_ISSUE_LIVING)),
    ))
    t = F.col("text")
    telling = [signals.AID_PATTERNS["meets_full_need"], signals.COMPETITIVE, signals.AID_PATTERNS["any_scholarship"], signals.AID_PATTERNS["international_excluded"], signals.AID_PATTERNS["international_eligible"]]
    quoted = F.coalesce(*[first_excerpt(t, p) for p in telling])
    return rows.select("institution_id", "page_id", issues.alias("issues"), quoted.alias("excerpt"), F.when(open_, 0.8).otherwise(0.3).alias("confidence"), F.inline(items))


def deadline_tokens(pages: DataFrame) -> DataFrame:
    names = "january|february|march|april|may|june|july|august|september|october|november|december"
    pattern = rf"(?i)\b\d{{1,2}}\s+(?:{names})\s+20\d{{2}}\b|\b(?:{names}|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.?\s+\d{{1,2}},?\s+20\d{{2}}\b"
    out = pages.select("institution_id", "page_id", "text", F.explode(spans(F.col("text"), pattern)).alias("m"))
    hit = F.col("m.hit")
    month = F.try_element_at(S.lit_map(signals.MONTHS), F.lower(F.regexp_extract(hit, "([A-Za-z]+)", 1)))
    day, year = F.regexp_extract(F.regexp_replace(hit, r"20\d{2}$", ""), r"(\d{1,2})", 1), F.regexp_extract(hit, r"(20\d{2})$", 1)
    iso = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    context = excerpt(F.col("text"), F.col("m.start"), F.length("m.hit"), 170)
    kind = None
    for name, p in signals.DEADLINE_KINDS:
        kind = F.when(context.rlike(p), F.lit(name)) if kind is None else kind.when(context.rlike(p), F.lit(name))
    return out.select(
        "institution_id", "page_id", F.col("m.n").alias("ordinal"), F.try_to_date(iso, "yyyy-MM-dd").alias("date"), kind.otherwise("unqualified").alias("date_kind"), context.alias("excerpt"),
    ).where(F.col("date").isNotNull())


#: Characters that a quotation of a Common Data Set section shows.
EXCERPT = 160


def common_data_set(pages: DataFrame) -> DataFrame:
    """Section-coded values of a Common Data Set text."""
    t = F.col("text")

    def section(code, size):
        at = F.regexp_instr(t, F.lit(rf"(?i)\b{code}\b"))
        return F.when(at > 0, F.substring(t, at, F.lit(size)))

    c9, c8, g, c1 = section("C9", 900), section("C8", 900), F.coalesce(section("G0", 1600), section("G1", 1600)), section("C1", 600)
    sat = r"(?i)SAT (?:Evidence-Based Read|Composite|Total)[^\n]*?(\d{3,4})[^\n]*?(\d{3,4})"
    policy = testing_policy(c8)
    tuition = F.regexp_extract(g, r"(?i)\btuition\b[^.\n]*?[$]\s?([\d,]+(?:\.\d{1,2})?)", 1)
    nums = F.transform(F.regexp_extract_all(c1, F.lit(r"\b(\d{3,7})\b"), F.lit(1)), lambda x: x.cast("double"))
    applied, admitted = F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    rate = F.when((admitted > 0) & (admitted <= applied), S.js_round(admitted / applied * F.lit(1000.0)).cast("double") / F.lit(10.0))

    def item(field, value, quoted):
        return F.when(value.isNotNull(), F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), squeeze(quoted).alias("excerpt")))

    blank = lambda c: F.when(c != "", c)
    scores, price = F.regexp_extract(c9, sat, 0), r"(?i)\btuition\b[^.\n]*?[$]\s?([\d,]+(?:\.\d{1,2})?)"
    found = S.texts(
        item("sat25", blank(F.regexp_extract(c9, sat, 1)), scores), item("sat75", blank(F.regexp_extract(c9, sat, 2)), scores),
        item("satPolicy", F.when(F.size(policy) == 1, F.get(policy, F.lit(0))), F.substring(c8, 1, EXCERPT)),
        item("tuition", blank(F.regexp_replace(tuition, ",", "")), F.regexp_extract(g, price, 0)), item("admitRate", rate, F.substring(c1, 1, EXCERPT)),
    )
    years = academic_years(t)
    return pages.where(t.rlike("(?i)common data set")).select("institution_id", "page_id", F.get(years, F.size(years) - 1).alias("academic_year"), F.inline(found))


# ---- validation -----------------------------------------------------------

def money_issues(rows: DataFrame) -> DataFrame:
    usd = F.col("currency") == "USD"
    v, unit = F.col("value"), F.col("unit")
    errors = S.texts(
        F.when(v.isNull(), F.lit(signals.NO_VALUE)),
        F.when(F.col("currency").isNull(), F.lit(signals.NO_CURRENCY)),
        F.when(unit.isin("per-credit", "per-course", "per-month", "per-week"),
               S.fill(signals.NOT_ANNUAL, u=unit)),
        F.when(usd & (v > signals.COST_CEILING), S.fill(signals.OVER_CEILING, v=S.num_text(v))),
        F.when(F.col("year_ambiguous"), F.lit(signals.SEVERAL_YEARS)),
    )
    warnings = S.texts(
        F.when(unit.isin("per-semester", "per-quarter"), S.fill(signals.NEEDS_TERMS, u=unit)),
        F.when(unit == "unqualified", F.lit(signals.UNSTATED_UNIT)),
        F.when(usd & (v > 0) & (v < 100) & (unit != "per-credit"), S.fill(signals.TOO_SMALL, v=S.num_text(v))),
        F.when(F.col("academic_year").isNull(), F.lit(signals.NO_YEAR)),
    )
    return rows.withColumns({"errors": errors, "warnings": warnings})


def best_money(candidates: DataFrame) -> DataFrame:
    """One candidate per field: CDS first, newest year, annual, confidence, first seen."""
    order = Window.partitionBy("institution_id", "field").orderBy(
        F.col("from_cds").desc(), F.coalesce("academic_year", F.lit("")).desc(), F.col("is_annual").desc(), F.col("confidence").desc(), "page_id", "ordinal",
    )
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def score_outcome(scores: DataFrame, field: str) -> DataFrame:
    """One distinct overall score, else unqualified; conflicts and section-only pages carry an error."""
    n = lambda c: F.count(F.when(c, 1))
    kind = F.col("score_kind") if "score_kind" in scores.columns else F.lit("overall")
    s = scores.withColumn("_k", kind)
    agg = s.groupBy("institution_id").agg(
        n(F.col("_k") == "overall").alias("_overall"), n(F.col("_k") == "unqualified").alias("_plain"),
        F.min(F.when(F.col("_k") == "overall", F.col("score"))).alias("_olo"), F.max(F.when(F.col("_k") == "overall", F.col("score"))).alias("_ohi"),
        F.min(F.when(F.col("_k") == "unqualified", F.col("score"))).alias("_plo"), F.max(F.when(F.col("_k") == "unqualified", F.col("score"))).alias("_phi"),
    )
    has = F.col("_overall") > 0
    lo, hi = F.when(has, F.col("_olo")).otherwise(F.col("_plo")), F.when(has, F.col("_ohi")).otherwise(F.col("_phi"))
    error = F.when((F.col("_overall") == 0) & (F.col("_plain") == 0), F.lit(signals.ONLY_SECTIONS)).when(
        lo != hi, F.lit(signals.CONFLICTING_SCORES))
    warning = F.when(~has, F.lit(signals.NOT_OVERALL))
    return agg.select(
        "institution_id", F.lit(field).alias("field"), F.when(error.isNull(), S.num_text(lo)).alias("value"), S.texts(error).alias("errors"),
        F.when(error.isNull(), S.texts(warning)).otherwise(S.str_array([])).alias("warnings"),
    )


def deadline_outcome(dates: DataFrame, field: str, cycle=signals.CYCLE) -> DataFrame:
    """The one in-cycle date of the wanted kind, else of any labelled kind."""
    wanted = "scholarship" if field == "scholarshipDeadline" else "application"
    typed, labelled = F.col("date_kind") == wanted, F.col("date_kind") != "unqualified"
    inside = F.col("date").between(F.lit(cycle[0]).cast("date"), F.lit(cycle[1]).cast("date"))

    def stats(cond, tag):
        return [F.count(F.when(cond, 1)).alias(f"n_{tag}"), F.min(F.when(cond & inside, F.col("date"))).alias(f"lo_{tag}"), F.max(F.when(cond & inside, F.col("date"))).alias(f"hi_{tag}")]

    agg = dates.groupBy("institution_id").agg(*stats(typed, "t"), *stats(labelled, "l"))
    use = F.col("n_t") > 0
    lo, hi = F.when(use, F.col("lo_t")).otherwise(F.col("lo_l")), F.when(use, F.col("hi_t")).otherwise(F.col("hi_l"))
    error = (
        F.when(F.col("n_l") == 0, F.lit(signals.BARE_DATES))
        .when(lo.isNull(), F.lit(f"every candidate date falls outside the current cycle ({cycle[0]}..{cycle[1]}); the page is probably stale"))
        .when(lo != hi, F.lit(signals.SEVERAL_DEADLINES))
    )
    return agg.select("institution_id", F.lit(field).alias("field"), F.when(error.isNull(), lo.cast("string")).alias("value"), S.texts(error).alias("errors"), S.str_array([]).alias("warnings"))


ROUTES = {
    "money": ["tuition", "cost_of_attendance"], "english": ["english_requirements", "international_admissions", "admissions"],
    "testing": ["testing_policy", "admissions"], "deadlines": ["deadlines", "admissions", "scholarships"],
    "aid": ["financial_aid", "international_financial_aid", "scholarships"],
}


def routed(pages: DataFrame, route: str) -> DataFrame:
    """Pages whose kind feeds an extractor and whose applicant scope may serve first-year fields."""
    return pages.where(F.col("kind").isin(*ROUTES[route]) & F.col("scope").isin(*signals.FIRST_YEAR_SCOPES))


CANDIDATE = {
    "institution_id": None, "page_id": None, "field": None, "value": "string", "currency": "string", "unit": "string", "academic_year": "string", "year_source": "string", "year_ambiguous": "boolean",
    "is_annual": "boolean", "cand_kind": "string", "confidence": "double", "from_cds": "boolean", "ordinal": "bigint", "excerpt": "string", "issues": "array<string>",
}
SOURCE = ["url", "title", "retrieved_at", "source_type", "content_hash"]
AID_FIELDS = ["meetsFullNeedForInternationals", "fullRidePossible", "fullTuitionPossible", "needBasedAidForInternationals", "aidCertainty"]
MONEY_FIELDS = list(signals.MONEY_FIELDS)
VALIDATED = [*MONEY_FIELDS, "minimumIELTS", "minimumTOEFL", "satPolicy", "applicationDeadline", "scholarshipDeadline", *AID_FIELDS]
#: The fields for which a page of the wrong applicants is refused, by what it would have fed.
REFUSED = {"money": MONEY_FIELDS, "english": ["minimumIELTS"], "testing": ["satPolicy"], "deadlines": ["applicationDeadline"], "aid": ["aidCertainty"]}


def sources(pages: DataFrame) -> DataFrame:
    """Where each page came from, for the evidence of its values."""
    kind = F.when(F.col("kind") == "common_data_set", "common_data_set").when(F.col("content_type") == "application/pdf", "official_pdf").otherwise("official_web")
    retrieved = F.col("retrieved_at").cast("timestamp") if "retrieved_at" in pages.columns else F.lit(None).cast("timestamp")
    return pages.select("page_id", "url", "title", retrieved.alias("retrieved_at"), kind.alias("source_type"), "content_hash")


def extract_candidates(pages: DataFrame) -> DataFrame:
    """All candidate values as one long table, each with its source and the words it was read from."""
    defaults = {"year_ambiguous": F.lit(False), "is_annual": F.lit(False), "from_cds": F.lit(False), "ordinal": F.lit(0), "issues": S.str_array([])}

    def shaped(df, **fixed_cols):
        df = df.withColumns(fixed_cols)
        return df.select(*[
            (F.col(c) if c in df.columns else defaults.get(c, F.lit(None))).cast(kind).alias(c) if kind else F.col(c) for c, kind in CANDIDATE.items()
        ])

    money = money_scoped(routed(pages, "money")).where(F.col("excluded").isNull()).withColumnRenamed("sentence", "excerpt")
    ielts = ielts_scores(routed(pages, "english")).withColumnRenamed("score", "value").withColumnRenamed("score_kind", "cand_kind")
    toefl = toefl_scores(routed(pages, "english")).withColumnRenamed("score", "value")
    stated = None
    for _, pattern in signals.TESTING_PATTERNS:
        quoted = first_excerpt(F.col("text"), pattern)
        stated = quoted if stated is None else F.coalesce(stated, quoted)
    policy = routed(pages, "testing").select("institution_id", "page_id", testing_policy(F.col("text")).alias("p"), stated.alias("excerpt")).where(F.size("p") == 1).withColumn("value", F.get("p", F.lit(0)))
    dates = deadline_tokens(routed(pages, "deadlines")).withColumnRenamed("date", "value").withColumnRenamed("date_kind", "cand_kind")
    both = dates.withColumn("field", F.explode(S.str_array(["applicationDeadline", "scholarshipDeadline"])))
    aid = aid_flags(aid_signals(routed(pages, "aid"))).where(F.col("state") != "UNKNOWN").withColumnRenamed("state", "cand_kind")
    cds = common_data_set(pages.where(F.col("kind") == "common_data_set"))
    parts = [
        shaped(money, confidence=F.when(F.col("is_annual"), 0.85).otherwise(0.5)),
        shaped(ielts, field=F.lit("minimumIELTS"), confidence=F.when(F.col("cand_kind") == "overall", 0.9).otherwise(0.4)),
        shaped(toefl, field=F.lit("minimumTOEFL"), confidence=F.lit(0.85)),
        shaped(policy, field=F.lit("satPolicy"), confidence=F.lit(0.9)),
        shaped(both, confidence=F.lit(0.75)), shaped(aid),
        shaped(cds, currency=F.when(F.col("field") == "tuition", "USD"), unit=F.lit("per-year"), year_source=F.lit("common-data-set"), confidence=F.lit(0.95), from_cds=F.lit(True)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(sources(pages), "page_id")


def proposals(candidates: DataFrame) -> DataFrame:
    """At most one validated outcome per institution and field, with its evidence, from the written candidates."""
    key = ["institution_id", "field"]
    of = lambda *fields: candidates.where(F.col("field").isin(*fields))
    shown = [F.col(c).alias(f"evidence_{c}") for c in (*SOURCE, "excerpt")]
    none = S.str_array([])

    money = best_money(of(*MONEY_FIELDS).withColumn("value", F.col("value").cast("decimal(18,2)")))
    rows = money_issues(money).select(*key, S.num_text(F.col("value")).alias("value"), "errors", "warnings", "confidence", *shown)

    # the first candidate is the evidence; an overall score before others, a Common Data Set before pages
    order = F.struct(F.coalesce(F.col("cand_kind") != "overall", F.lit(True)), ~F.col("from_cds"), "page_id", "ordinal")
    first = candidates.groupBy(*key).agg(F.min_by(F.struct("value", *SOURCE, "excerpt"), order).alias("e"))
    evidence = first.select(*key, F.col("e.value").alias("first_value"), *[F.col(f"e.{c}").alias(f"evidence_{c}") for c in (*SOURCE, "excerpt")])
    score = lambda field: of(field).withColumn("score", F.col("value").cast("double"))
    ielts = score_outcome(score("minimumIELTS").withColumn("score_kind", F.col("cand_kind")), "minimumIELTS").withColumn("confidence", F.lit(0.9))
    toefl = score_outcome(score("minimumTOEFL"), "minimumTOEFL").withColumn("confidence", F.lit(0.85))
    due = [deadline_outcome(of(f).select("institution_id", F.col("value").cast("date").alias("date"), F.col("cand_kind").alias("date_kind")), f).withColumn("confidence", F.lit(0.75)) for f in ("applicationDeadline", "scholarshipDeadline")]
    judged = ielts
    for part in (toefl, *due):
        judged = judged.unionByName(part)
    policy = of("satPolicy").groupBy(*key).agg(F.min_by("confidence", order).alias("confidence")).select(*key, F.lit(None).cast("string").alias("value"), none.alias("errors"), none.alias("warnings"), "confidence")
    judged = judged.unionByName(policy).join(evidence, key, "left")
    judged = judged.withColumn("value", F.when(F.col("field") == "satPolicy", F.col("first_value")).otherwise(F.col("value"))).drop("first_value")

    # of the aid pages that speak, the strongest
    aid = of(*AID_FIELDS)
    strongest = aid.groupBy("institution_id").agg(F.min_by("page_id", F.struct(-F.col("confidence"), F.col("page_id"))).alias("page_id"))
    spoken = aid.join(strongest, ["institution_id", "page_id"]).select(*key, "value", none.alias("errors"), F.col("issues").alias("warnings"), "confidence", *shown)

    rows = rows.unionByName(judged).unionByName(spoken)
    has_evidence = F.col("evidence_url").isNotNull()
    return demote(rows.withColumn("verdict", E.verdict((F.size("errors") > 0) | F.col("value").isNull(), has_evidence, F.size("warnings") > 0, F.col("confidence"))))


def scope_refusals(pages: DataFrame) -> DataFrame:
    """Fields that a page would have fed, were it not written for other applicants."""
    wrong = ~F.col("scope").isin(*signals.FIRST_YEAR_SCOPES)
    out = None
    for route, fields in REFUSED.items():
        part = pages.where(F.col("kind").isin(*ROUTES[route]) & wrong).select("institution_id", F.explode(S.str_array(fields)).alias("field"), F.replace(F.col("scope"), F.lit("_"), F.lit(" ")).alias("_scope"))
        out = part if out is None else out.unionByName(part)
    return out.select("institution_id", "field", S.fill(signals.SCOPE_REFUSAL, scope=F.col("_scope"), field=F.col("field")).alias("reason"))


def consistency_issues(record_values: DataFrame, key: str = "institution_id") -> DataFrame:
    """Cross-field contradictions; a record has at most one row per known field, so its map is small."""
    record = record_values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("v"))
    items = S.texts(*[F.when(F.expr(cond), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, cond, message in signals.CONSISTENCY])
    return record.select(key, F.inline(items))


def demote(judged: DataFrame) -> DataFrame:
    """A contradicted proposal goes back to review."""
    live = judged.where((F.col("verdict") != "REJECT") & F.col("value").isNotNull()).select("institution_id", "field", "value")
    bad = consistency_issues(live).where(F.col("field") != "satPolicy").select("institution_id", "field").distinct().withColumn("_bad", F.lit(True))
    return judged.join(bad, ["institution_id", "field"], "left").withColumn(
        "verdict", F.when(F.col("_bad") & (F.col("verdict") == "ACCEPT"), "REVIEW_REQUIRED").otherwise(F.col("verdict")),
    ).drop("_bad")


def review_table(outcomes: DataFrame, candidates: DataFrame, money: DataFrame, flags: DataFrame, refusals: DataFrame) -> DataFrame:
    """Outcomes, excluded figures, unrouted values and fields without evidence as one table."""
    accounted = outcomes.select("institution_id", "field")
    unspoken = flags.where(F.col("state") == "UNKNOWN").select("institution_id", "field", "reason").unionByName(refusals).distinct()
    silent = unspoken.join(accounted, ["institution_id", "field"], "left_anti").select("institution_id", "field", F.lit(None).cast("string").alias("value"), F.lit("NO_EVIDENCE").alias("verdict"), "reason")
    main = outcomes.select("institution_id", "field", "value", "verdict", F.get(F.concat("errors", "warnings"), F.lit(0)).alias("reason"))
    left_out = money.where(F.col("excluded").isNotNull()).select("institution_id", "field", S.num_text(F.col("value")).alias("value"), F.lit("EXCLUDED").alias("verdict"), F.col("excluded").alias("reason"))
    unrouted = candidates.where(~F.col("field").isin(*VALIDATED)).select("institution_id", "field", "value", F.lit("UNROUTED").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    return main.unionByName(left_out).unionByName(unrouted).unionByName(silent)
