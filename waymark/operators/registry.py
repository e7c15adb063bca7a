"""Institution registry, URL policy joins, candidate ranking, fetch decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import signals
from waymark.functions import scalar as S, urls as U
from waymark.session import spread


def clean_domain(d: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(d), r"^\.+", ""), r"\.+$", "")


def allowed_domains(official: Column, subdomains: Column) -> Column:
    both = F.concat(F.coalesce(official, S.str_array([])), F.coalesce(subdomains, S.str_array([])))
    return F.filter(F.array_distinct(F.transform(both, clean_domain)), lambda d: d != "")


def domain_matches(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """(institution_id, url) whose host equals, or is under, an allowed domain: an equi-join on host suffixes."""
    suffixes = pages.select("institution_id", "url", F.explode(U.host_suffixes(U.host(F.col("url")))).alias("domain"))
    return suffixes.join(allowed.select("institution_id", "domain"), ["institution_id", "domain"], "left_semi").select(
        "institution_id", "url",
    ).distinct()


def url_policy(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every url with ``ok`` and the first policy it breaks."""
    matched = domain_matches(pages, allowed).withColumn("_m", F.lit(True))
    reason = U.policy_reason(F.col("url"), F.coalesce("_m", F.lit(False)))
    return pages.join(matched, ["institution_id", "url"], "left").withColumn("reason", reason).drop("_m").withColumn("ok", F.col("reason").isNull())


def variants_with_status(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every rewrite of the parseable urls (institution_id, url_id, url), and whether its host is one of the institution's or under it."""
    rewritten = pages.where(U.parseable(F.col("url"))).select("institution_id", "url_id", F.explode(U.variants(F.col("url"))).alias("variant"))
    inside = domain_matches(rewritten.withColumnRenamed("variant", "url"), allowed).select("institution_id", F.col("url").alias("variant"), F.lit(True).alias("_in"))
    return rewritten.join(inside, ["institution_id", "variant"], "left").select("institution_id", "url_id", "variant", F.coalesce("_in", F.lit(False)).alias("allowed"))


def with_sitemap_context(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """The fetch list (institution_id, url) with ``context``: the last path segment of the sitemap (sitemap_url, loc) that lists a url.

    Of several sitemaps the first by its url counts; a url that none lists has
    no context. Rows are narrow here, before anything is fetched.
    """
    listed = entries.select("institution_id", U.normalize(F.col("loc")).alias("_url"), "sitemap_url").groupBy("institution_id", "_url").agg(F.min("sitemap_url").alias("_by"))
    parts = F.filter(F.split(U.path(F.col("_by")), "/"), lambda s: s != "")
    joined = urls.withColumn("_url", U.normalize(F.col("url"))).join(listed, ["institution_id", "_url"], "left")
    return joined.withColumn("context", F.get(parts, F.size(parts) - 1)).drop("_url", "_by")


def challenge(html: Column) -> Column:
    low = F.lower(html)
    marked = S.any_of([low.contains(m) for m in signals.CHALLENGE_MARKERS])
    return F.coalesce(marked | (low.contains("captcha") & (F.length(html) < signals.CHALLENGE_CAPTCHA_LENGTH)), F.lit(False))


def merge_registry(built: DataFrame, previous: DataFrame) -> DataFrame:
    """Rebuilt entries over earlier ones: kept pages, united domains, earlier discovery state."""
    p = previous.select(
        "id", F.col("pages").alias("p_pages"), F.col("official_domains").alias("p_official"), F.col("trusted_subdomains").alias("p_trusted"),
        F.col("discovery_status").alias("p_status"),
    )
    kept = F.map_filter("p_pages", lambda k, u: u.isNotNull() & U.non_content_reason(u).isNull())
    base = F.map_filter("pages", lambda k, u: ~F.array_contains(F.map_keys(kept), k))
    official = F.array_distinct(F.concat("official_domains", F.coalesce("p_official", S.str_array([]))))
    trusted = F.array_distinct(F.coalesce("p_trusted", "trusted_subdomains"))
    return built.join(p, "id", "left").select(
        "id", F.when(F.col("p_pages").isNotNull(), F.map_concat(base, kept)).otherwise(F.col("pages")).alias("pages"),
        official.alias("official_domains"), trusted.alias("trusted_subdomains"), allowed_domains(official, trusted).alias("allowed_domains"),
        F.coalesce("p_status", "discovery_status").alias("discovery_status"),
    )


# ---- phrase hits ----------------------------------------------------------

def phrase_weight(term: str) -> float:
    return min(2.0, 1.0 + 0.5 * (len(term.split(" ")) - 1))


def hit(hay: Column, term: str) -> Column:
    return hay.contains(f" {term} ")


def padded(terms) -> Column:
    return S.str_array([f" {t} " for t in terms])


def hit_list(hay: Column, terms) -> Column:
    return F.filter(padded(terms), lambda t: F.contains(hay, t))


def weight_of(hits: Column) -> Column:
    """Longer phrases count more: 1, then 1.5, then 2 at most."""
    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - 2
    return F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + F.least(F.lit(2.0), F.lit(1.0) + F.lit(0.5) * spaces(t)))


def weigh(hay: Column, terms) -> Column:
    """What the hits of ``terms`` weigh in all; each term is a plain test, which Spark compiles."""
    return reduce(lambda a, b: a + b, [F.when(hit(hay, t), F.lit(phrase_weight(t))).otherwise(F.lit(0.0)) for t in terms], F.lit(0.0))


def any_hit(hay: Column, terms) -> Column:
    return S.any_of([hit(hay, t) for t in terms]) if terms else F.lit(False)


def terms_in(hay: Column, terms) -> Column:
    """Those of ``terms`` that occur in ``hay``; its words are looked up in one pass, however many the terms.

    A phrase is sought where its longest word stands. Such words may be listed
    too.
    """
    phrases: dict[str, list[str]] = {}
    for t in terms:
        if " " in t:
            phrases.setdefault(max(t.split(" "), key=len), []).append(t)
    keys = sorted({*phrases, *(t for t in terms if " " not in t)})
    known = F.expr("map(" + ", ".join(f"{S.sql_lit(k)}, {S.sql_array(v)}" for k, v in phrases.items()) + ")") if phrases else None
    words = F.array_intersect(S.str_array(keys), F.split(hay, " "))
    if known is None:
        return words
    begun = lambda w: F.coalesce(F.try_element_at(known, w), S.str_array([]))
    # one list per word: the word itself, then its phrases that are there
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(begun(w), lambda t: F.contains(hay, F.concat(F.lit(" "), t, F.lit(" ")))))))


def term_hits(docs: DataFrame, terms: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Weighted hits per document and term group; the words are normalised once."""
    groups = F.array(*[
        F.struct(F.lit(name).alias("term_group"), weigh(F.col("_hay"), items).alias("weight")) for name, items in terms.items()
    ])
    return docs.withColumn("_hay", U.words(F.col(text))).select("doc_id", F.inline(groups)).where(F.col("weight") > 0)


# ---- URL-only scoring -----------------------------------------------------

def with_path(urls: DataFrame) -> DataFrame:
    """Path words, segments, depth, article segments and dated permalinks, once per url."""
    u = F.col("url")
    out = urls.withColumn("_p", U.path(u)).withColumns({
        "_hay": U.words(F.col("_p")), "_segs": U.segments(u), "_dated": F.col("_p").rlike(r"/20\d{2}/"),
        "_deep": F.size(F.filter(F.split("_p", "/"), lambda s: s != "")) > 5,
    })
    return out.withColumns({"_bad": article_hits(F.col("_segs")), "_marked": F.concat(F.lit("/"), F.array_join("_segs", "/"), F.lit("/"))}).drop("_p")


def path_relevance(kind: str) -> Column:
    score = weigh(F.col("_hay"), signals.KIND_SIGNALS[kind]["path"]) * F.lit(float(signals.PATH_WEIGHT)) - F.when(F.col("_deep"), 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def article_hits(segs: Column) -> Column:
    return F.size(F.array_intersect(segs, S.str_array(signals.ARTICLE_SEGMENTS)))


def canonical_hits(marked: Column, kind: str) -> Column:
    """How many of a kind's names a segment is, or begins with; each segment stands between slashes."""
    names = signals.KIND_SIGNALS[kind]["canonical"]
    return reduce(lambda a, b: a + b, [F.when(marked.contains(f"/{t}/") | marked.contains(f"/{t} "), 1).otherwise(0) for t in names])


def path_authority(kind: str) -> Column:
    bad, good = F.col("_bad"), canonical_hits(F.col("_marked"), kind)
    bonus = F.when(bad == 0, F.least(F.lit(signals.CANONICAL_CAP), good * signals.CANONICAL_SEGMENT)).otherwise(0)
    penalty = F.when(bad > 0, F.greatest(F.lit(signals.ARTICLE_CAP), F.lit(signals.ARTICLE_FIRST) + (bad - 1) * signals.ARTICLE_EXTRA)).otherwise(0)
    return bonus + penalty + F.when(F.col("_dated"), F.lit(signals.DATED_PATH)).otherwise(0)


def scope_level(structural: Column, body: Column | None = None) -> Column:
    level = None
    for name, terms in signals.SCOPE_MARKERS:
        cond = any_hit(structural, terms)
        level = F.when(cond, F.lit(name)) if level is None else level.when(cond, F.lit(name))
    if body is not None:
        for name in signals.BODY_SCOPES:
            level = level.when(any_hit(body, dict(signals.SCOPE_MARKERS)[name]), F.lit(name))
    return level.otherwise("unknown")


def audience_of(scope: Column, international: Column) -> Column:
    return (
        F.when(scope.isin("first_year", "international_first_year"), F.lit("first_year"))
        .when(scope == "general_undergraduate", "all_undergraduate").when(scope != "unknown", scope)
        .when(international, "international").otherwise("unknown")
    )


def candidate_scores(urls: DataFrame) -> DataFrame:
    """Every url with each kind's relevance, authority and priority, from the URL alone.

    Where ``urls`` has a kind, a url is scored for that one only.
    """
    hay = F.col("_hay")
    base = with_path(spread(urls, "institution_id", "url")).withColumns({"_level": scope_level(hay), "_intl": any_hit(hay, signals.INTERNATIONAL_MARKERS)})
    base = base.withColumn("audience", audience_of(F.col("_level"), F.col("_intl")))
    adjust = F.element_at(S.lit_map(signals.AUDIENCE_ADJUST), F.col("audience"))
    scores = {
        kind: F.struct(
            F.lit(i).alias("kind_ordinal"), F.lit(kind).alias("kind"), path_relevance(kind).alias("relevance"), path_authority(kind).alias("authority"),
            (adjust if signals.KIND_SIGNALS[kind]["audience"] else F.lit(0)).alias("audience_adjust"),
        ) for i, kind in enumerate(signals.KINDS)
    }
    keep = [c for c in urls.columns if c != "kind"]
    if "kind" in urls.columns:
        own = reduce(lambda so_far, kind: so_far.when(F.col("kind") == kind, scores[kind]), signals.KINDS, F)
        rows = F.array(own)
        base = base.where(F.col("kind").isin(list(signals.KINDS)))
    else:
        rows = F.array(*scores.values())
    return base.select(*keep, "audience", F.inline(rows)).withColumn(
        "priority", F.col("relevance") + F.col("authority") + F.col("audience_adjust"),
    )


def top_per_kind(scored: DataFrame, limit: int = signals.CANDIDATES_PER_KIND) -> DataFrame:
    order = Window.partitionBy("institution_id", "kind").orderBy(F.col("priority").desc(), F.length("url"), "url")
    return scored.where(F.col("relevance") > 0).withColumn("kind_rank", F.row_number().over(order)).where(F.col("kind_rank") <= limit)


def guess_paths(institutions: DataFrame, top: DataFrame) -> DataFrame:
    """Conventional paths for the kinds with too few strong candidates."""
    strong = top.where(F.col("priority") >= signals.STRONG_SCORE).groupBy("institution_id", "kind").count().where(F.col("count") >= signals.STRONG_NEEDED)
    known = F.array(*[F.struct(F.lit(k).alias("kind"), S.str_array(p).alias("paths")) for k, p in signals.CANDIDATE_PATHS.items()])
    every = institutions.select("institution_id", "root_url", F.inline(known))
    return every.join(strong.select("institution_id", "kind"), ["institution_id", "kind"], "left_anti").select(
        "institution_id", "kind", "root_url", F.explode("paths").alias("path"),
    ).select("institution_id", "kind", F.concat(F.regexp_replace("root_url", "/+$", ""), F.col("path")).alias("url"))


#: What a site publishes is fetched before what its URLs are guessed to be.
DISCOVERED, GUESSED = 0, 1


def fetch_order(candidates: DataFrame, budget: int = signals.FETCH_BUDGET) -> DataFrame:
    """One row per url: best priority, best tier, kinds united; published before guessed; within budget."""
    merged = candidates.groupBy("institution_id", "url").agg(
        F.max("priority").alias("priority"), F.min("tier").alias("tier"), F.sort_array(F.collect_set("kind")).alias("kinds"),
    )
    order = Window.partitionBy("institution_id").orderBy("tier", F.col("priority").desc(), "url")
    return merged.withColumn("fetch_rank", F.row_number().over(order)).where(F.col("fetch_rank") <= budget)


def fetch_manifest(wanted: DataFrame, snapshots: DataFrame, policy: DataFrame) -> DataFrame:
    """Configured (institution, kind, url) against fetched bodies: a document, or the first reason it is refused."""
    joined = wanted.join(policy.select("institution_id", "url", F.col("reason").alias("_policy")), ["institution_id", "url"], "left").join(
        snapshots.select("url", "html", "content_type"), "url", "left",
    )
    non_content = U.non_content_reason(F.col("url"))
    reason = (
        F.when(non_content.isNotNull(), F.concat(F.lit("not a page: "), non_content))
        .when(F.col("_policy").isNotNull(), F.concat(F.lit("blocked: "), F.col("_policy")))
        .when(F.col("html").isNull(), F.lit("not fetched"))
        .when(challenge(F.col("html")), F.lit("bot challenge page, not real content"))
        .when(F.col("content_type").isin("application/xml", "text/xml"), F.concat(F.col("content_type"), F.lit(" is a machine-readable index, not a page")))
    )
    body = F.col("html").cast("binary")
    return joined.select(
        "institution_id", "kind", "url", reason.alias("failure"),
        F.when(reason.isNull(), F.octet_length("html")).cast("bigint").alias("bytes"), F.when(reason.isNull(), F.sha2(body, 256)).alias("content_hash"),
    )


# ---- linked hosts ---------------------------------------------------------

def academic(host: Column) -> Column:
    parts = F.filter(F.split(host, "\\."), lambda p: p != "")
    n = F.size(parts)
    second = F.element_at(parts, F.when(n >= 2, n - 1).otherwise(1))
    return ((n >= 2) & (F.element_at(parts, -1) == "edu")) | ((n >= 3) & second.isin(signals.ACADEMIC_SECOND_LEVELS))


def related_hosts(hosts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Academic hosts whose registrable label is a token of the institution, or the stem of one.

    A token is expanded to its prefixes, so the stem test is an equi-join.
    """
    label = F.substring_index(U.registrable(F.col("host")), ".", 1)
    stems = tokens.where(F.length("token") >= 3).select(
        "institution_id", "token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substring("token", F.lit(1), n))).alias("label"),
    )
    best = stems.groupBy("institution_id", "label").agg(F.min("token").alias("token"))
    return hosts.withColumn("label", label).join(best, ["institution_id", "label"], "left").withColumn(
        "related", academic(F.col("host")) & F.col("token").isNotNull(),
    )


LINK = r"(?is)<a\b[^>]*href=[\"'](https://[^\"'#?]+)[\"'][^>]*>"


def linked_hosts(pages: DataFrame, allowed: DataFrame, tokens: DataFrame, top_candidates: int = 10, top_external: int = 25) -> DataFrame:
    """Foreign hosts linked from an institution's pages, counted and split into candidates and external links."""
    links = pages.select("institution_id", "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("pos", "url"))
    foreign = links.join(domain_matches(links.select("institution_id", "url"), allowed), ["institution_id", "url"], "left_anti")
    # occurrences are summed per (host, url) first, so a heavily linked host shuffles as few rows as it has urls
    per_url = foreign.withColumn("host", U.host(F.col("url"))).groupBy("institution_id", "host", "url").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "pos")).alias("first_seen"),
    )
    order = Window.partitionBy("institution_id", "host").orderBy("first_seen")
    ranked = per_url.withColumn("_r", F.row_number().over(order))
    counted = ranked.groupBy("institution_id", "host").agg(
        F.sum("n").alias("occurrences"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= 3, F.struct("_r", "url")))), lambda x: x["url"]), " ").alias("examples"),
    )
    judged = related_hosts(counted, tokens).withColumn("bucket", F.when(F.col("related"), "candidate").otherwise("external"))
    best = Window.partitionBy("institution_id", "bucket").orderBy(F.col("occurrences").desc(), "host")
    limit = F.when(F.col("bucket") == "candidate", top_candidates).otherwise(top_external)
    return judged.withColumn("bucket_rank", F.row_number().over(best)).where(F.col("bucket_rank") <= limit)
