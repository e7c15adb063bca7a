"""Small pages for the traps: nested furniture, several years, thresholds, wrong populations, look-alike hosts."""

import pytest
from pyspark.sql import functions as F

from waymark import signals
from waymark.functions import html as H, urls as U
from waymark.operators import evidence as E, extract as X, pages as G, registry as R

PAD = "Our office answers questions by letter and keeps a record of every answer. " * 4


def page(spark, body, title="Tuition", url="https://uni.edu/tuition", kind="tuition", page_id=1):
    html = f"<html><head><title>{title}</title></head><body><main><h1>{title}</h1>{body}</main></body></html>"
    return spark.createDataFrame([(page_id, 1, kind, url, html, "text/html")], "page_id bigint, institution_id bigint, kind string, url string, html string, content_type string")


def content(spark, *args, **kw):
    return G.with_scope(G.with_content(page(spark, *args, **kw)))


@pytest.mark.parametrize("html, want", [
    ("<nav>a<nav>b</nav>c</nav>keep", " keep"),
    ("<nav>open keep", " open keep"),
    ("<div class='main-nav'><div>x</div>y</div>keep", " keep"),
    ("<div class='canvas'>keep</div>", "<div class='canvas'>keep</div>"),
    ("keep</nav>", "keep</nav>"),
])
def test_furniture_is_cut_by_nesting(html, want):
    assert H._main(html)[0] == want


def test_landmark_wins():
    assert H._main("<header>x</header>a<main>b</main>c") == ("<main>b</main>", True)


def test_two_years_in_prose_are_ambiguous(spark):
    got = X.money_scoped(content(spark, "<h2>Costs</h2><p>In 2024-25 and 2025-26 tuition is $50,000 per year.</p>")).collect()
    assert [(r.field, float(r.value), r.academic_year, r.year_ambiguous) for r in got] == [("tuition", 50000.0, None, True)]


def test_threshold_and_award_are_excluded_with_a_reason(spark):
    rows = X.money_scoped(content(spark, "<p>Tuition is free for family income below $200,000. Scholarships of up to $9,000 reduce tuition.</p>")).collect()
    assert len(rows) == 2 and all(r.excluded for r in rows)


def test_digits_do_not_swallow_the_next_number(spark):
    tokens = X.money_tokens(spark.sql("select 'Housing is $12,500 2027 per year.' as text"), "text").collect()
    assert [float(t.value) for t in tokens] == [12500.0]


def test_per_class_price_is_an_error(spark):
    kept = X.money_issues(X.money_scoped(content(spark, "<p>Tuition is $7,778.25 per class.</p>")))
    row = kept.first()
    assert float(row.value) == 7778.25 and row.unit == "per-course" and any("per-course" in e for e in row.errors)


@pytest.mark.parametrize("title, url, want", [
    ("Visiting undergraduate students", "https://u.edu/visiting", "visiting"),
    ("Transfer applicants", "https://u.edu/apply", "transfer"),
    ("First-year applicants", "https://u.edu/international", "international_first_year"),
    ("Apply", "https://u.edu/graduate/admissions", "graduate"),
    ("Apply", "https://u.edu/apply", "unknown"),
])
def test_scope_comes_from_structure(spark, title, url, want):
    assert content(spark, "<p>Nothing else.</p>", title=title, url=url).first().scope == want


def test_body_never_imposes_an_excluding_scope(spark):
    assert content(spark, "<p>First-year students apply here; transfer students elsewhere.</p>", title="Apply", url="https://u.edu/apply").first().scope == "first_year"


def test_wrong_population_yields_no_candidate(spark):
    pages = content(spark, "<p>Tuition is $9,000 per year.</p>", title="Visiting students")
    assert X.extract_candidates(pages).count() == 0


def table_of(spark, *pages):
    """(page_id, kind, title, body) of one institution to its content."""
    rows = [(i, 1, kind, f"https://uni.edu/{i}", f"<html><head><title>{title}</title></head><body><main><h1>{title}</h1>{body}</main></body></html>", "text/html") for i, kind, title, body in pages]
    return G.with_scope(G.with_content(spark.createDataFrame(rows, "page_id bigint, institution_id bigint, kind string, url string, html string, content_type string"))).cache()


def outcomes(spark, *pages):
    content = table_of(spark, *pages)
    candidates = X.extract_candidates(content).cache()
    flags = X.aid_flags(X.aid_signals(X.routed(content, "aid")))
    found = X.proposals(candidates).cache()
    review = X.review_table(found, candidates, X.money_scoped(X.routed(content, "money")), flags, X.scope_refusals(content)).collect()
    return {r.field: r for r in found.collect()}, {(r.field, r.verdict): r for r in review}


def test_a_silent_but_eligible_page_does_not_hide_one_that_speaks(spark):
    found, review = outcomes(
        spark, (1, "financial_aid", "Aid", "<p>International students are eligible to apply.</p>"),
        (2, "scholarships", "Aid", "<p>This aid is not available to international applicants.</p>"),
    )
    assert found["aidCertainty"].value == "minimal" and found["aidCertainty"].evidence_url == "https://uni.edu/2"
    assert found["aidCertainty"].warnings == [signals.AID_EXCLUDED] and "not available" in found["aidCertainty"].evidence_excerpt
    assert ("aidCertainty", "NO_EVIDENCE") not in review


def test_common_data_set_comes_first_and_its_other_fields_are_unrouted(spark):
    found, review = outcomes(
        spark, (1, "tuition", "Tuition", "<p>Tuition is $9,000 per year for 2027-28.</p>"), (2, "admissions", "Apply", "<p>The SAT is required.</p>"),
        (3, "common_data_set", "Common Data Set", "<p>Common Data Set 2026-27</p><p>C8 We are test-optional</p><p>C9 SAT Composite 25th 1200 75th 1400</p><p>G1 Tuition is $31,000 per year</p>"),
    )
    assert (found["tuition"].value, found["satPolicy"].value) == ("31000", "optional")
    assert {found[f].evidence_source_type for f in ("tuition", "satPolicy")} == {"common_data_set"}
    assert {("sat25", "UNROUTED"), ("sat75", "UNROUTED")} <= set(review)


def test_wrong_applicants_leave_a_row_without_evidence(spark):
    found, review = outcomes(spark, (1, "tuition", "Visiting students", "<p>Tuition is $9,000 per year.</p>"))
    assert not found
    assert review[("tuition", "NO_EVIDENCE")].reason == "the source is written for visiting applicants; tuition describes a first-year undergraduate and cannot be taken from it"


def test_pages_are_read_where_they_lie(spark, sf):
    from waymark.plans import page_bindings as V
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "1L AS institution_id", "url", "html")
    for df in (G.with_content(pages), G.with_scope(G.with_content(pages))):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "ArrowEvalPython" in plan and "Exchange" not in plan
    assert V.rendered(spark, sf).columns[0] == "page_id"


def test_scope_rank_decides_between_equal_roles(spark):
    cols = "institution_id int, kind string, page_id int, url string, role string, scope string, score double, audience string, accepted boolean"
    rows = [(1, "tuition", 1, "https://u.edu/a", "canonical", "unknown", 20.0, "unknown", True), (1, "tuition", 2, "https://u.edu/b", "canonical", "first_year", 10.0, "first_year", True)]
    best = G.best_pages(G.ranked_pages(spark.createDataFrame(rows, cols))).first()
    assert best.page_id == 2 and best.why_it_won == "written for first year applicants rather than unknown"


def test_announcement_is_not_a_policy(spark):
    pages = content(spark, f"<p>{PAD} We are reinstating our SAT requirement. Posted on Monday.</p>", title="Testing", url="https://u.edu/blog/sat", kind="testing_policy")
    assert G.with_temporal(pages, "2026-09-01").first().temporal_status == "historical"


def test_concepts_in_different_sections_do_not_count(spark):
    body = "<h2>Visas</h2><p>International students need a visa.</p><h2>Money</h2><p>A scholarship fund exists.</p>"
    scored = G.kind_scores(G.with_temporal(content(spark, body, title="Office", url="https://u.edu/office"), "2026-09-01").drop("kind"))
    assert scored.where("kind = 'international_financial_aid'").first().failed == "never together"


def test_section_minimum_is_not_an_overall_score(spark):
    pages = content(spark, "<p>IELTS 6.0 in each component.</p>", title="English", kind="english_requirements")
    assert X.score_outcome(X.ielts_scores(pages), "minimumIELTS").first().value is None


def test_silence_about_aid_is_unknown(spark):
    flags = X.aid_flags(X.aid_signals(content(spark, "<p>Scholarships are available.</p>"))).collect()
    assert {f.state for f in flags} == {"UNKNOWN"}


def test_look_alike_host_does_not_match(spark):
    pages = spark.createDataFrame([(1, "https://x.mit.edu.evil.com/a"), (1, "https://x.mit.edu/a")], "institution_id int, url string")
    allowed = spark.createDataFrame([(1, "mit.edu")], "institution_id int, domain string")
    assert [r.url for r in R.domain_matches(pages, allowed).collect()] == ["https://x.mit.edu/a"]


def test_approval_needs_confirmation(spark):
    df = spark.createDataFrame([(1, "tuition", "5", 1)], "record_id int, field string, value string, evidence_count int")
    with pytest.raises(PermissionError):
        E.approve(df, df.select("record_id", "field"), F.current_timestamp(), "someone")


def test_two_source_reconciliation(spark):
    cols = "record_id int, field string, value bigint, source_type string, academic_year string"
    rows = [(1, "a", 5, "official_web", "2025-26"), (1, "a", 6, "common_data_set", "2024-25"), (2, "a", 5, "official_web", "2025-26"), (2, "a", 6, "official_web", "2026-27"),
            (3, "a", 5, "official_web", "2025-26"), (3, "a", 6, "official_web", "2025-26"), (4, "a", 7, "official_web", "2025-26"), (4, "a", 7, "government", "2020-21")]
    got = {r.record_id: (r.winner, r.reason) for r in E.reconcile(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == (6, "higher source type") and got[2] == (6, "newer academic year")
    assert got[3][0] is None and got[4] == (7, "sources agree")


def test_every_kind_has_signals():
    assert list(signals.KIND_SIGNALS) == signals.KINDS and len(signals.KINDS) == 12


def test_url_normalisation(spark):
    got = spark.sql("select 'HTTPS://A.Edu/x/?q=1#f' as u").select(U.normalize(F.col("u"))).first()[0]
    assert got == "https://a.edu/x?q=1"


def test_first_sitemap_that_lists_a_page_is_its_context(spark):
    urls = spark.createDataFrame([(1, "https://u.edu/a"), (1, "https://u.edu/b/"), (2, "https://u.edu/a")], "institution_id bigint, url string")
    entries = spark.createDataFrame([
        (1, "https://u.edu/maps/tuition-fees.xml", "https://U.edu/a/"), (1, "https://u.edu/maps/z.xml", "https://u.edu/a"), (1, "https://u.edu/", "https://u.edu/b"),
    ], "institution_id bigint, sitemap_url string, loc string")
    got = {(r.institution_id, r.url): r.context for r in R.with_sitemap_context(urls, entries).collect()}
    assert got == {(1, "https://u.edu/a"): "tuition-fees.xml", (1, "https://u.edu/b/"): None, (2, "https://u.edu/a"): None}


def test_weak_winners_of_critical_kinds_are_refused_with_a_reason(spark):
    best = spark.createDataFrame([
        (1, "tuition", "u1", "historical", 20.0, True), (1, "deadlines", "u2", "fallback", 7.5, True), (1, "programs", "u3", "historical", 20.0, False), (1, "financial_aid", "u4", "fallback", 8.0, True),
    ], "institution_id bigint, kind string, page_url string, role string, score double, critical boolean")
    gated = {r.kind: (r.outcome, r.reason) for r in G.quality_gate(best, spark.createDataFrame([(1,)], "institution_id bigint")).collect()}
    assert gated["tuition"] == ("rejected", signals.REFUSED_HISTORICAL)
    assert gated["deadlines"] == ("rejected", "only a fallback source was found for a decision-critical field, and 7.5 is below the 8 bar for one")
    assert gated["programs"] == gated["financial_aid"] == ("found", None) and gated["admissions"] == ("not_found", None) and len(gated) == 12


def test_every_date_pattern_has_a_sign_that_its_matches_hold(spark):
    """A page with one stated date gives it, in any case; the sign only spares pages that can't match."""
    assert set(signals.DATE_SIGNS) == {p for p in signals.PUBLISHED + signals.UPDATED if p != "path"}
    for which, names in ((signals.PUBLISHED, ["article:published_time", "datePublished", "pubdate", "date", "DC.date", "DCxDATE"]), (signals.UPDATED, ["article:modified_time", "og:updated_time", "dateModified"])):
        pages = [f'<META {k}="{n}" content="2024-03-05T10:00">' for n in names for k in ("property", "name")] + [f"<meta CONTENT='2024-03-05' name='{n.upper()}'>" for n in names]
        pages += ['{"DatePublished" : "2024-03-05"}', "<p>x<TIME class=a datetime='2024-03-05'>"] if which is signals.PUBLISHED else ['"datemodified":"2024-03-05"', "LAST \n Reviewed: March 5, 2024"]
        got = spark.createDataFrame([(p, "https://a.edu/x") for p in pages], "html string, url string").select(G.first_date(F.col("html"), F.col("url"), which)).collect()
        assert [str(r[0]) for r in got] == ["2024-03-05"] * len(pages), list(zip(pages, got))


def test_codes_that_entities_spell_are_decoded(spark):
    rows = spark.createDataFrame([("a &amp;#233; &#65; b",), ("no code &amp; x",), (None,)], "h string").select(H.text_of(F.col("h")))
    assert [r[0] for r in rows.collect()] == ["a \u00e9 A b", "no code & x", None]


def test_content_in_pieces_keeps_every_page(spark):
    pages = [(i, None if i % 50 == 7 else "" if i % 50 == 9 else f"<nav>n</nav><main>p{i}</main>") for i in range(1000)]
    rows = spark.createDataFrame(pages, "i int, html string").coalesce(1).select("i", H.main_content(F.col("html")).alias("m")).collect()
    assert len(rows) == 1000 and all((r.m.html, r.m.used_main) == ((f"<main>p{r.i}</main>", True) if pages[r.i][1] else ("", False)) for r in rows)


def test_scores_of_a_failed_kind_are_nought(spark):
    page = ("https://a.edu/tuition", "t", "Tuition", "<main><h1>Tuition</h1><p>Tuition is $5 per year.</p></main>", "transfer")
    rows = spark.createDataFrame([page], "url string, page_id string, title string, main_html string, scope string").withColumns({
        "text": H.text_of(F.col("main_html")), "headings": H.headings_of(F.col("main_html")), "audience": F.lit("transfer"), "temporal_status": F.lit("current"),
        "article_segments": F.lit(0), "blog_body": F.lit(False), "blog_like": F.lit(False)})
    got = G.kind_scores(rows).collect()
    assert len(got) == 12 and all((r.failed, r.content, r.relevance, r.authority, r.score, r.role, r.accepted) == ("scope", 0.0, 0.0, 0.0, 0.0, "fallback", False) for r in got)


def test_terms_found_by_their_words_are_those_that_a_search_finds(spark):
    terms = G.CORPUS_TERMS
    hays = [" ", "  ", " the net price calculator ", " ".join(["", *terms, ""]), " ".join(["", *reversed(terms), ""]), " full  ride financial  aid ", " financial financial aid ", " unfinancial aids "]
    hays += [f" x {t} y " for t in terms] + [f" {t}s x{t} {t.replace(' ', '  ')} " for t in terms]
    rows = spark.createDataFrame([(h,) for h in hays], "hay string").select("hay", R.terms_in(F.col("hay"), terms).alias("found")).collect()
    for r in rows:
        assert set(r.found) & set(terms) == {t for t in terms if f" {t} " in r.hay}


def test_text_is_searched_for_the_terms_of_all_kinds_at_once(spark):
    rows = content(spark, "<p>Tuition is due.</p>")
    plan = G.kind_scores(G.with_temporal(rows, "2026-09-01").drop("kind"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_corpus") + plan.count("contains(_corpus") <= 2


def test_tags_that_a_page_lacks_are_not_scanned_for(monkeypatch):
    sought, real = [], H.re.finditer
    monkeypatch.setattr(H.re, "finditer", lambda p, *rest: sought.append(p) or real(p, *rest))
    assert H._main("<NAV>x</NAV><p>y</p></div>") == (" <p>y</p></div>", False) and len(sought) == 1
    # the long s folds into an s
    assert H._main("<aſide>x</aſide>y") == (" y", False)


@pytest.mark.parametrize("html, text", [
    ("a<SCRIPT>x</script>b<sTyle >y</STYLE>c<!-- z -->d", "a b c d"), ("<scr<script></script>ipt>q</script>", "q"), ("a  b\tc \t d e", "a b c d e"),
    ("a\n\n\n\nb \n", "a\n\nb"), ("&amp;lt;&nbsp;&#65;", "< A"), ("1 &lt; 2 &gt; 1", "1 < 2 > 1"), ("", ""), (" x", "x"),
])
def test_text_without_markup_is_cleaned_like_any(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(H.text_of(F.col("h")).alias("t")).first().t == text


def test_stated_years_and_dates_on_odd_texts(spark):
    got = spark.createDataFrame([("2025-26, 2026/2027, 2026 – 27, 12026-27, 2026-28, 2026-271",), (None,), ("",)], "t string").select(G.academic_years(F.col("t")).alias("y")).collect()
    assert [r.y for r in got] == [["2025-26", "2026-27"], None, []]
    dates = spark.createDataFrame([("",), ("May 4, 2026",), ("2026-05-04T01",), ("soon",), (None,)], "t string").select(G.as_date(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in dates] == [None, "2026-05-04", "2026-05-04", None, None]
