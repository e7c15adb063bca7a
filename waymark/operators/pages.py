"""Fetched pages to content, structure, scope, dates and kind scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import signals
from waymark.functions import html as H, scalar as S, urls as U
from waymark.operators import registry as R

YEAR = r"\b(20\d{2})\s*[-–/]\s*(\d{2}|20\d{2})\b"


def academic_years(text: Column) -> Column:
    """Distinct consecutive academic years in a text, ascending."""
    # a match begins with the first year and ends with the last two digits of the second
    pairs = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), lambda m: F.named_struct(F.lit("a"), F.left(m, F.lit(4)), F.lit("b"), F.right(m, F.lit(2))))
    kept = F.filter(pairs, lambda p: (F.right(p["a"], F.lit(2)).cast("int") + 1) % 100 == p["b"].cast("int"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: F.concat(p["a"], F.lit("-"), p["b"]))))


def current_academic_year(as_of: str) -> str:
    year, month = int(as_of[:4]), int(as_of[5:7])
    start = year if month >= 7 else year - 1
    return f"{start}-{(start + 1) % 100:02d}"


def with_content(pages: DataFrame) -> DataFrame:
    """The html column is read where it lies, once, and not carried past this step."""
    main = pages.withColumn("main", H.main_content(F.col("html")))
    return main.withColumns({
        "content_hash": F.sha2(F.col("html").cast("binary"), 256), "title": H.title_of(F.col("html")), "main_html": F.col("main.html"), "used_main": F.col("main.used_main"),
        "published": first_date(F.col("html"), F.col("url"), signals.PUBLISHED), "updated": first_date(F.col("html"), F.col("url"), signals.UPDATED),
    }).withColumns({
        "text": H.text_of(F.col("main_html")), "headings": H.headings_of(F.col("main_html")),
    }).drop("html", "main")


def as_date(raw: Column) -> Column:
    # each text that is no date costs an exception, and most pages state none
    return F.when(raw != "", F.coalesce(F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.replace(raw, F.lit(","), F.lit("")), "MMMM d yyyy")))


def first_date(html: Column, url: Column, patterns) -> Column:
    found = []
    for p in patterns:
        if p == "path":
            part = F.regexp_extract(U.path(url), r"/(20\d{2}/\d{2}(?:/\d{2})?)/", 1)
            whole = F.when(F.length(part) == 7, F.concat(part, F.lit("/01"))).otherwise(part)
            found.append(F.when(part != "", F.try_to_date(whole, "yyyy/MM/dd")))
        else:
            # the patterns back off from every tag of a page; a plain search tells whether one can match
            stated = as_date(F.regexp_extract(html, p, 1))
            found.append(F.when(F.lower(html).contains(signals.DATE_SIGNS[p]), stated) if p in signals.DATE_SIGNS else stated)
    return F.coalesce(*found)


def with_scope(content: DataFrame) -> DataFrame:
    """Applicant scope: excluding levels only from path, title and first headings; the body may confirm an including one."""
    structural = U.words(F.concat_ws(" ", U.path(F.col("url")), F.coalesce("title", F.lit("")), F.array_join(F.slice("headings", 1, 6), " ")))
    out = content.withColumns({"_structural": structural, "_body": U.words(F.col("text"))})
    out = out.withColumns({"scope_level": R.scope_level(F.col("_structural"), F.col("_body")), "international": R.any_hit(F.col("_structural"), signals.INTERNATIONAL_MARKERS)})
    out = out.withColumn("scope", F.when((F.col("scope_level") == "first_year") & F.col("international"), F.lit("international_first_year")).otherwise(F.col("scope_level")))
    return out.withColumn("audience", R.audience_of(F.col("scope"), F.col("international"))).drop("_structural", "_body")


def with_temporal(scoped: DataFrame, as_of: str) -> DataFrame:
    """current / dated / historical / unknown from stated years, dates and announcement wording."""
    today, current = F.to_date(F.lit(as_of)), current_academic_year(as_of)
    segs = U.segments(F.col("url"))
    out = scoped.withColumns({
        "_hay": U.words(F.col("text")), "article_segments": R.article_hits(segs), "years": academic_years(F.col("text")),
    }).withColumns({
        "blog_body": hits_any("_hay", signals.BLOG_MARKERS), "announces": hits_any("_hay", signals.ANNOUNCEMENT_MARKERS),
        "academic_year": F.get("years", F.size("years") - 1), "year_ambiguous": F.size("years") > 1,
        "newest": F.coalesce("updated", "published"),
    }).drop("_hay")
    blog = (F.col("article_segments") > 0) | F.col("blog_body")
    age = F.datediff(today, F.col("newest")).cast("double") / F.lit(30.44)
    now = F.coalesce(F.col("academic_year") >= current, F.lit(False)) | (F.coalesce(age <= 12, F.lit(False)) & ~blog)
    status = (
        F.when(blog & F.col("announces"), "historical").when(age > 24, "historical").when(~now & (age > 12), "dated")
        .when(~now & (F.col("academic_year") < current), "dated").when(now, "current").otherwise("unknown")
    )
    return out.withColumns({"blog_like": blog, "temporal_status": status})


def hits_any(hay: str, terms) -> Column:
    return R.any_hit(F.col(hay), terms)


hit_list, weight_of = R.hit_list, R.weight_of


def places(sections: Column, text: Column) -> Column:
    """The words of each place where two terms stand together: a section, or where a page has none, a 300-character window stepping 150."""
    # a window inside a section could add nothing to the section
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(150))
    windows = F.transform(starts, lambda i: U.words(F.substring(text, i, F.lit(300))))
    own = F.transform(sections, lambda s: U.words(F.concat(s["heading"], F.lit(" "), s["body"])))
    return F.when(F.size(sections) == 0, windows).otherwise(own)


def together(a, b, title: Column, hays: Column) -> Column:
    """Two term groups in the words of one title or one place; words are made once per place, not per term."""
    def both(hay):
        return R.any_hit(hay, a) & R.any_hit(hay, b)

    return both(title) | F.exists(hays, both)


#: Every term that a kind seeks in all that a page says.
CORPUS_TERMS = sorted({t for sig in signals.KIND_SIGNALS.values() for terms in (
    sig.get("hard") or [], *sig["require"], *(sig.get("one_of") or []), sig["text"], sig["negative"]) for t in terms})


def kind_scores(temporal: DataFrame, context: str | None = None) -> DataFrame:
    """Every page against the twelve kinds: gates with the first failed reason, content, relevance, authority, acceptance."""
    base = R.with_path(temporal).withColumns({
        "_title": U.words(F.col("title")), "_heads": U.words(F.array_join("headings", " . ")), "_text": U.words(F.col("text")),
        "_path": F.col("_hay"),
        "_context": U.words(F.col(context)) if context else F.lit("  "),
    }).withColumns({
        "_corpus": F.concat("_title", "_heads", "_text", "_path"), "_titlepath": F.concat("_title", "_path"),
        "_served": F.col("scope").isin(*signals.FIRST_YEAR_SCOPES),
    }).withColumns({
        # pages that aren't served fail every kind by their scope
        "_found": F.when(F.coalesce("_served", F.lit(True)), R.terms_in(F.col("_corpus"), CORPUS_TERMS)),
        "_refused": F.size(hit_list(F.col("_titlepath"), signals.GLOBAL_NEGATIVE)),
    })
    found = F.col("_found")
    calculator = hits_any("_titlepath", signals.CALCULATOR_MARKERS) & ~F.col("text").rlike(signals.STATES_FIGURES)
    audience_adjust = F.element_at(S.lit_map(signals.AUDIENCE_ADJUST), F.col("audience"))
    temporal_adjust = F.element_at(S.lit_map(signals.TEMPORAL_ADJUST), F.col("temporal_status"))

    def failure(kind: str) -> Column:
        sig = signals.KIND_SIGNALS[kind]
        reason = F.when(~F.col("_served"), F.lit("scope"))
        if sig.get("hard"):
            reason = reason.when(F.arrays_overlap(found, S.str_array(sig["hard"])), F.lit("hard negative"))
        for group in sig["require"]:
            reason = reason.when(~F.arrays_overlap(found, S.str_array(group)), F.lit("missing required term"))
        if sig.get("one_of"):
            clauses = F.expr("array(" + ", ".join(S.sql_array(c) for c in sig["one_of"]) + ")")
            reason = reason.when(~F.exists(clauses, lambda c: F.forall(c, lambda t: F.array_contains(found, t))), F.lit("no specific statement"))
        return reason

    def apart(i: int, kind: str) -> Column:
        terms = signals.KIND_SIGNALS[kind].get("together")
        so_far = F.col(f"_failed{i}")
        return F.coalesce(so_far, F.when(~together(*terms, F.col("_title"), F.col("_places")), F.lit("never together"))) if terms else so_far

    def one(i: int, kind: str) -> Column:
        sig, failed = signals.KIND_SIGNALS[kind], F.col(f"_failed{i}")
        in_text = F.filter(F.array_intersect(S.str_array(sig["text"]), found), lambda t: F.contains(F.col("_text"), F.concat(F.lit(" "), t, F.lit(" "))))
        text_hits = F.transform(F.slice(in_text, 1, signals.TEXT_HIT_CAP), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
        content = (
            weight_of(hit_list(F.col("_title"), sig["title"])) * signals.TITLE_WEIGHT + weight_of(hit_list(F.col("_heads"), sig["heading"])) * signals.HEADING_WEIGHT
            + weight_of(text_hits) * signals.TEXT_WEIGHT
        )
        negatives = F.col("_refused") + (F.size(F.array_intersect(S.str_array(sig["negative"]), found)) if sig["negative"] else F.lit(0))
        extra = (
            weight_of(hit_list(F.col("_path"), sig["path"])) * signals.PATH_WEIGHT + weight_of(hit_list(F.col("_context"), sig["path"])) * signals.SITEMAP_WEIGHT
            + negatives * signals.NEGATIVE_WEIGHT
        )
        authority = (
            R.path_authority(kind) + F.when(F.col("blog_body"), signals.BLOG_CONTENT).otherwise(0) + temporal_adjust
            + (audience_adjust if sig["audience"] else F.lit(0))
        )
        canonical = (F.col("article_segments") == 0) & (R.canonical_hits(F.col("_marked"), kind) > 0)
        # a page that fails a kind has no score for it, so its terms aren't sought
        worth = lambda c: F.when(failed.isNull(), c)
        return F.struct(
            F.lit(i).alias("kind_ordinal"), F.lit(kind).alias("kind"), failed.alias("failed"), worth(content).alias("content"), worth(extra).alias("extra"),
            worth(authority.cast("double")).alias("authority"), worth(canonical).alias("canonical"), F.lit(sig["critical"]).alias("critical"),
        )

    keep = [c for c in temporal.columns if c not in ("main_html", "text", "headings")]
    judged = base.withColumn("_calc", calculator).withColumns({f"_failed{i}": failure(k) for i, k in enumerate(signals.KINDS)})
    # sections are only read on pages that a kind still asks them of
    asked = S.any_of([F.col(f"_failed{i}").isNull() for i, k in enumerate(signals.KINDS) if signals.KIND_SIGNALS[k].get("together")])
    judged = judged.withColumn("_places", F.when(asked, places(H.sections_of(F.col("main_html")), F.col("text"))))
    judged = judged.withColumns({f"_failed{i}": apart(i, k) for i, k in enumerate(signals.KINDS)})
    rows = judged.select(*keep, "_calc", F.inline(F.array(*[one(i, k) for i, k in enumerate(signals.KINDS)])))
    passed = F.col("failed").isNull()
    return rows.withColumns({
        "content": F.when(passed, F.col("content")).otherwise(0.0),
        "relevance": F.when(passed, F.col("content") + F.col("extra")).otherwise(0.0),
        "authority": F.when(passed, F.col("authority")).otherwise(0.0),
        "role": F.when(~passed, "fallback").when(F.col("blog_like") & (F.col("temporal_status") == "historical"), "historical").when(F.col("blog_like"), "fallback")
        .when(F.col("canonical") & ~F.col("_calc"), "canonical").otherwise("supporting"),
    }).withColumn("score", F.col("relevance") + F.col("authority")).withColumns({
        "accepted": passed & (F.col("content") >= signals.CONTENT_BAR) & (F.col("score") >= signals.ACCEPT_BAR),
    }).drop("_calc", "extra", "canonical")


# ---- selection ------------------------------------------------------------

def selection_order():
    role = F.element_at(S.lit_map(signals.ROLE_RANK), F.col("role"))
    scope = F.coalesce(F.try_element_at(S.lit_map(signals.SCOPE_RANK), F.col("scope")), F.lit(1))
    audience = F.coalesce(F.try_element_at(S.lit_map(signals.AUDIENCE_RANK), F.col("audience")), F.lit(3))
    return [role.desc(), scope.desc(), F.col("score").desc(), audience.desc(), F.col("page_id").asc()]


def ranked_pages(scored: DataFrame) -> DataFrame:
    """Accepted pages per (institution, kind), one row per normalised url, in selection order."""
    key = ["institution_id", "kind"]
    unique = Window.partitionBy(*key, "page_url").orderBy(F.col("score").desc(), "page_id")
    dedup = scored.where("accepted").withColumn("page_url", U.normalize(F.col("url"))).withColumn("_n", F.row_number().over(unique)).where("_n = 1").drop("_n")
    return dedup.withColumn("page_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*selection_order())))


def best_pages(ranked: DataFrame) -> DataFrame:
    """Winner per kind with its runner-up and why that lost; only two rows per kind travel."""
    key = ["institution_id", "kind"]
    top = ranked if "temporal_status" in ranked.columns else ranked.withColumn("temporal_status", F.lit("unknown"))
    top = top.where("page_rank <= 2")
    rival = F.lead(F.struct("page_url", "role", "scope", "score", "audience", "temporal_status")).over(Window.partitionBy(*key).orderBy("page_rank"))
    won = top.withColumn("runner_up", rival).where("page_rank = 1")

    def rank(mapping, c, default):
        return F.coalesce(F.try_element_at(S.lit_map(mapping), c), F.lit(default))

    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    ru = F.col("runner_up")
    worth = lambda c: S.num_text(F.element_at(S.lit_map(signals.TEMPORAL_ADJUST), c))
    status = S.fill(signals.WHY_STATUS, a=F.col("temporal_status"), b=ru["temporal_status"], x=worth(F.col("temporal_status")), y=worth(ru["temporal_status"]))
    score = S.fill(signals.WHY_SCORE, a=S.num_text(F.col("score")), b=S.num_text(ru["score"]))
    why = (
        F.when(ru.isNull(), signals.WHY_ALONE)
        .when(rank(signals.ROLE_RANK, F.col("role"), 0) != rank(signals.ROLE_RANK, ru["role"], 0), S.fill(signals.WHY_ROLE, a=F.col("role"), b=ru["role"]))
        .when(rank(signals.SCOPE_RANK, F.col("scope"), 1) != rank(signals.SCOPE_RANK, ru["scope"], 1),
              S.fill(signals.WHY_SCOPE, a=spaced(F.col("scope")), b=spaced(ru["scope"])))
        .when(F.col("score") != ru["score"], F.concat(score, F.when(F.col("temporal_status") != ru["temporal_status"], status).otherwise("")))
        .when(rank(signals.AUDIENCE_RANK, F.col("audience"), 3) != rank(signals.AUDIENCE_RANK, ru["audience"], 3),
              S.fill(signals.WHY_AUDIENCE, a=F.col("audience"), b=ru["audience"]))
        .otherwise(S.fill(signals.WHY_ORDER, a=S.num_text(F.col("score"))))
    )
    return won.withColumn("why_it_won", why)


def quality_gate(best: DataFrame, institutions: DataFrame) -> DataFrame:
    """found / rejected / not_found for every institution and kind, and why a winner is refused."""
    weak = (F.col("role") == "fallback") & (F.col("score") < signals.FALLBACK_BAR)
    reason = F.when(F.col("critical") & (F.col("role") == "historical"), signals.REFUSED_HISTORICAL).when(
        F.col("critical") & weak, S.fill(signals.REFUSED_FALLBACK, score=S.num_text(F.col("score")), bar=F.lit(str(signals.FALLBACK_BAR))),
    )
    every = institutions.select("institution_id", F.explode(S.str_array(signals.KINDS)).alias("kind"))
    return every.join(best.select("institution_id", "kind", "page_url", "role", "score", "critical"), ["institution_id", "kind"], "left").withColumn("reason", reason).withColumn(
        "outcome", F.when(F.col("page_url").isNull(), "not_found").when(F.col("reason").isNotNull(), "rejected").otherwise("found"),
    )


def run_status(gated: DataFrame) -> DataFrame:
    """Kinds not found and complete / partial / failed per institution."""
    found = F.count(F.when(F.col("outcome") == "found", 1))
    return gated.groupBy("institution_id").agg(found.alias("found"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("outcome") != "found", F.col("kind")))), ",").alias("missing")).withColumn(
        "status", F.when(F.col("found") == len(signals.KINDS), "complete").when(F.col("found") > 0, "partial").otherwise("failed"),
    )
