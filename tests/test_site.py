"""Catalogue rules and URL rewrites on small hand-made rows."""

from pyspark.sql import functions as F

from waymark import signals
from waymark.operators import evidence as E, registry as R
from waymark.plans import bindings as B


def test_rules_in_one_pass(spark):
    rows = [(1, "Alpha", 5), (2, " alpha ", 50), (3, "Beta", None), (4, None, 500), (5, None, 501), (6, "BETA", 502), (7, "beta", 503), (8, "x", 504), (9, "y", 505)]
    df = spark.createDataFrame(rows, "option_id bigint, name string, v int")
    rules = {"small": F.col("v") < 100, "kept": F.col("option_id") > 0}
    got = {r.rule: (r.violations, r.first_id, r.sample_ids) for r in E.expectations(df, rules, ["name", "option_id"], 10).collect()}
    # null keys are equal to nothing; a shared key counts once, by its smallest id
    assert got == {"small": (6, 4, "4,5,6,7,8"), "kept": (0, None, None), "unique_name": (2, 1, "1,3"), "unique_option_id": (0, None, None), "record_count": (1, None, None)}
    twice = {r.rule: r.violations for r in E.expectations(df.unionByName(df), rules, ["option_id"], 10).collect()}
    assert twice == {"small": 12, "kept": 0, "unique_option_id": 9, "record_count": 0}
    none = {r.rule: (r.violations, r.sample_ids) for r in E.expectations(df.limit(0), rules, ["name"], 1).collect()}
    assert none == {"small": (0, None), "kept": (0, None), "unique_name": (0, None), "record_count": (1, None)}


def test_variants_say_whether_they_are_allowed(spark):
    pages = spark.createDataFrame([(1, 10, "https://www.uni.edu/x"), (1, 11, "https://a.b.other.org"), (2, 12, "https://www.uni.edu/x"), (1, 13, "no url")], "institution_id bigint, url_id bigint, url string")
    allowed = spark.createDataFrame([(1, "uni.edu"), (2, "else.edu")], "institution_id bigint, domain string")
    got = {(r.url_id, r.variant): r.allowed for r in R.variants_with_status(pages, allowed).collect()}
    assert got[10, "https://uni.edu/x"] and not got[12, "https://uni.edu/x"] and {k[0] for k in got} == {10, 11, 12}
    assert {v for (i, v) in got if i == 11} == {"https://www.a.b.other.org", "https://b.other.org", "https://www.b.other.org", "https://other.org", "https://www.other.org"} and not any(ok for (i, _), ok in got.items() if i == 11)


def test_approval_never_broadcasts_the_proposals(spark, sf):
    from waymark.plans import site_queries as Q
    for name in ("approve", "status_summary"):
        df = Q.QUERIES[name](spark, sf)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert df.where("metric = 'approved_records'").first().n == B.table(spark, sf, "part").count()


def test_a_guess_is_scored_for_its_own_kind_alone(spark):
    paths = ["/admissions/international/", "/blog/2024/05/tuition-news", "/a/b/c/d/e/f/testing", "/financial-aid/scholarships", "/cost-of-attendance/costs", "/news/blog/apply", "", "/Graduate/First-Year"]
    urls = [(i, f"https://uni.edu{p}") for i, p in enumerate(paths)] + [(8, None), (9, "no url"), (None, "https://uni.edu/fees")]
    every = R.candidate_scores(spark.createDataFrame(urls, "institution_id bigint, url string"))
    wanted = spark.createDataFrame([(*u, k) for u in urls for k in [*signals.KINDS, "no kind", None]], "institution_id bigint, url string, kind string")
    rows = lambda df: sorted((tuple(r) for r in df.select(*every.columns).collect()), key=str)
    assert rows(R.candidate_scores(wanted)) == rows(every) and every.count() == len(urls) * len(signals.KINDS)


def test_names_count_where_a_segment_is_or_begins_with_them(spark):
    rows = [["cost of attendance"], ["costs"], ["costly", "my cost"], ["cost", "cost of living", "tuition fees"], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, segs array<string>").withColumn("marked", F.concat(F.lit("/"), F.array_join("segs", "/"), F.lit("/")))
    names = signals.KIND_SIGNALS["cost_of_attendance"]["canonical"]
    want = [sum(any(s == n or s.startswith(n + " ") for s in r or []) for n in names) for r in rows]
    assert want[0] == 2 and [r.n for r in df.select("i", R.canonical_hits(F.col("marked"), "cost_of_attendance").alias("n")).orderBy("i").collect()] == want


def test_published_urls_are_scored_once(spark, sf):
    """The ranking of what is published is a written stage; the scan of its urls stands in no later plan."""
    from waymark.plans import site_queries as Q
    files = Q.QUERIES["fetch_order"](spark, sf).inputFiles()
    assert any("top-candidates" in f for f in files) and not any("orders.parquet" in f for f in files)


def test_missing_evidence_is_matched_without_a_broadcast(spark, sf):
    """Both sides have a row per record and field; neither may go through the driver."""
    from waymark.plans import site_queries as Q
    got = Q.QUERIES["no_evidence_minus_accounted"](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = got.collect()
    assert rows and len(set(rows)) == len(rows)
