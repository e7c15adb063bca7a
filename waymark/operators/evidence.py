"""Evidence values: invariants, primary source, reconciliation, derivation, approval, coverage, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark import signals
from waymark.functions import scalar as S
from waymark.session import materialize


def rank_of(mapping: dict, c: Column) -> Column:
    return F.element_at(S.lit_map(mapping), c)


def value_issues(values: DataFrame) -> DataFrame:
    """Broken invariants per value: ``status, value, confidence, derived_from, evidence array``."""
    v, status, evidence = F.col("value"), F.col("status"), F.col("evidence")
    empty = F.size(F.coalesce(evidence, F.expr("array()"))) == 0
    own = S.texts(
        F.when((status == "unverified") & v.isNotNull(), F.lit(signals.UNVERIFIED_VALUE)),
        F.when((status == "verified") & empty, F.lit(signals.VERIFIED_BARE)),
        F.when((status == "verified") & v.isNull(), F.lit(signals.VERIFIED_NULL)),
        F.when((status == "derived") & (F.size(F.coalesce("derived_from", S.str_array([]))) == 0), F.lit(signals.DERIVED_BARE)),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.concat(F.lit("confidence "), S.num_text(F.col("confidence")), F.lit(" is outside 0-1"))),
    )

    def per_item(e, i):
        n = i.cast("string")
        return F.array_compact(F.array(
            F.when(~e["url"].rlike("^https://"), F.concat(F.lit("evidence["), n, F.lit("] url is not https: "), e["url"])),
            F.when(F.expr("1=1") & F.try_to_timestamp(e["retrieved_at"]).isNull(), F.concat(F.lit("evidence["), n, F.lit("] retrievedAt is not a valid date"))),
            F.when((e["academic_year"] != "") & ~e["academic_year"].rlike(r"^\d{4}-\d{2}$"),
                   F.concat(F.lit("evidence["), n, F.lit('] academicYear "'), e["academic_year"], F.lit('" is not in YYYY-YY form'))),
        ))

    issues = F.concat(own, F.coalesce(F.flatten(F.transform(evidence, per_item)), S.str_array([])))
    return values.withColumn("issues", issues)


def primary_evidence(items: DataFrame, keys) -> DataFrame:
    """Strongest source type, then most recent, then first."""
    best = F.max_by(F.struct(*[c for c in items.columns if c not in keys]),
                    F.struct(rank_of(signals.SOURCE_RANK, F.col("source_type")), F.col("retrieved_at"), -F.col("ordinal")))
    return items.groupBy(*keys).agg(best.alias("primary"))


def reconcile(sources: DataFrame, keys=("record_id", "field")) -> DataFrame:
    """One decision per field over any number of sources.

    All equal: agree. One-sided evidence: that side. Otherwise the highest
    source type, then the newest academic year; several values left at the top
    escalate with no winner. Every step is a mergeable aggregate.
    """
    rank = F.coalesce(rank_of(signals.SOURCE_RANK, F.col("source_type")), F.lit(0))
    year = F.coalesce("academic_year", F.lit(""))
    # one row per distinct (value, source type, year) first: a hot field collapses before it shuffles
    small = sources.groupBy(*keys, "value", rank.alias("rank"), year.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    top = small.groupBy(*keys).agg(F.max(F.struct("rank", "year")).alias("top"))
    joined = small.join(top, list(keys))
    at_top = (F.col("rank") == F.col("top.rank")) & (F.col("year") == F.col("top.year"))
    mine = F.when(at_top, F.col("value"))
    agg = joined.groupBy(*keys).agg(
        F.sum("n").alias("sources"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min(mine).alias("_tlo"), F.max(mine).alias("_thi"),
        F.max("rank").alias("_r"), F.min("rank").alias("_rmin"), F.min(F.when(F.col("rank") == F.col("top.rank"), F.col("year"))).alias("_ymin"),
        F.max(F.when(F.col("rank") == F.col("top.rank"), F.col("year"))).alias("_ymax"),
        F.max(F.when(F.col("rank") == F.col("top.rank"), F.col("value"))).alias("_rhi"), F.min(F.when(F.col("rank") == F.col("top.rank"), F.col("value"))).alias("_rlo"),
    )
    reason = (
        F.when(F.col("_lo") == F.col("_hi"), "sources agree")
        .when(F.col("_tlo") != F.col("_thi"), "equally authoritative sources disagree; escalating to human review")
        .when((F.col("_rmin") == 0) & (F.col("_r") > 0) & (F.col("_rlo") == F.col("_rhi")), "only one side carries evidence")
        .when(F.col("_rlo") == F.col("_rhi"), "higher source type")
        .otherwise("newer academic year")
    )
    return agg.select(*keys, "sources", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).when(F.col("_tlo") == F.col("_thi"), F.col("_tlo")).alias("winner"), reason.alias("reason"))


def derive(inputs: DataFrame, key: str = "record_id") -> DataFrame:
    """A computed value inherits its weakest input; a missing input makes it unverified."""
    rank = rank_of(signals.STATUS_RANK, F.col("status"))
    agg = inputs.groupBy(key).agg(
        F.min(rank).alias("_weakest"), F.bool_or(F.col("value").isNull()).alias("_missing"), F.sum("value").alias("_sum"),
        F.count(F.lit(1)).alias("inputs"), F.sum("evidence_count").alias("evidence_count"),
    )
    status = (
        F.when(F.col("_missing") | (F.col("_weakest") == 0), "unverified").when(F.col("_weakest") == 3, "derived")
        .when(F.col("_weakest") == 2, "derived").otherwise("curated")
    )
    return agg.withColumn("status", status).select(
        key, "status", F.when(F.col("status") != "unverified", F.col("_sum")).alias("value"), "inputs", "evidence_count",
    )


def verdict(has_error: Column, has_evidence: Column, has_warning: Column, confidence: Column) -> Column:
    return (
        F.when(has_error, "REJECT").when(~has_evidence, "REJECT")
        .when(has_warning | (F.coalesce(confidence, F.lit(0.0)) < 0.9), "REVIEW_REQUIRED").otherwise("ACCEPT")
    )


def approve(proposals: DataFrame, wanted: DataFrame, at: Column, by: str, confirm: bool = False) -> DataFrame:
    """Approval events for wanted fields; refuses to run without confirmation."""
    if not confirm:
        raise PermissionError("approval writes to the approved stage; pass confirm=True deliberately")
    p = proposals.select("record_id", "field", "value", "evidence_count", F.lit(True).alias("_p"))
    reason = (
        F.when(F.col("_p").isNull(), "no such proposal").when(F.coalesce("evidence_count", F.lit(0)) == 0, "no evidence attached")
        .when(F.col("value").isNull(), "value is null")
    )
    # proposals are exploded from few bytes, so their size is underrated: as a broadcast they would pass whole through the driver
    return wanted.join(p.hint("merge"), ["record_id", "field"], "left").select(
        "record_id", "field", F.when(reason.isNull(), F.col("value")).alias("value"), reason.isNull().alias("accepted"), reason.alias("reason"),
        at.alias("at"), F.lit(by).alias("approved_by"),
    )


def latest_approved(events: DataFrame) -> DataFrame:
    """The current approved value per field out of the append-only events."""
    return events.where("accepted").groupBy("record_id", "field").agg(F.max_by("value", "at").alias("approved_value"))


def long_options(options: DataFrame) -> DataFrame:
    """The catalogue as (option_id, field, current_value) rows."""
    columns = {
        "tuition": "tuition", "livingCost": "living_cost", "minimumIELTS": "minimum_ielts", "satPolicy": "sat_policy",
        "applicationDeadline": "application_deadline", "scholarshipDeadline": "scholarship_deadline", "applicationPlatform": "application_platform",
        "fullRidePossible": "full_ride_possible", "fullTuitionPossible": "full_tuition_possible", "needBasedAidForInternationals": "need_based_aid",
        "aidCertainty": "aid_certainty",
    }
    def text(c):
        return S.num_text(F.col(c)) if c == "minimum_ielts" else F.col(c).cast("string")
    items = F.array(*[F.struct(F.lit(f).alias("field"), text(c).alias("current_value")) for f, c in columns.items()])
    return options.select("option_id", F.inline(items))


def overlay(options: DataFrame, approved: DataFrame) -> DataFrame:
    """Catalogue values with approved ones beside them; approved wins, and says so."""
    a = approved.select(F.col("record_id").alias("option_id"), "field", "approved_value")
    return long_options(options).join(a, ["option_id", "field"], "left").withColumns({
        "effective_value": F.coalesce("approved_value", "current_value"),
        "status": F.when(F.col("approved_value").isNotNull(), "verified").otherwise("curated"),
    })


def hash_changes(snapshots: DataFrame, evidence: DataFrame) -> DataFrame:
    """Snapshot hash against the first approved evidence of the same URL."""
    known = evidence.where(F.col("content_hash").isNotNull()).groupBy("url").agg(F.min_by("content_hash", "ordinal").alias("known_hash"))
    return snapshots.join(known, "url", "left").withColumn(
        "changed", F.coalesce(F.col("known_hash") != F.col("content_hash"), F.lit(False)),
    )


def freshness(pages: DataFrame) -> DataFrame:
    """current / review / broken / unconfigured per configured page, from a failure reason and a changed flag."""
    return pages.withColumn(
        "freshness",
        F.when(F.col("url").isNull(), "unconfigured").when(F.col("failure").isNotNull(), "broken").when(F.col("changed"), "review").otherwise("current"),
    )


def coverage(options: DataFrame) -> DataFrame:
    """Counts by country, region, aid certainty and cost band in one grouping-sets pass."""
    cost = F.coalesce("tuition", F.lit(0)) + F.coalesce("living_cost", F.lit(0))
    band = F.when(cost < 5000, "<5k").when(cost < 15000, "5-15k").when(cost < 30000, "15-30k").when(cost < 50000, "30-50k").otherwise("50k+")
    keys = ["country", "region", "aid_certainty", "cost_band"]
    rows = options.withColumn("cost_band", band).groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    group = F.when(F.col("g") == 7, "country").when(F.col("g") == 11, "region").when(F.col("g") == 13, "aid_certainty").otherwise("cost_band")
    return rows.select(group.alias("grouping"), F.coalesce(*keys).alias("key"), "n", (F.col("n") == 1).alias("singleton"))


def evidence_coverage(records: DataFrame, values: DataFrame) -> DataFrame:
    verified = values.where((F.col("status") == "verified") & F.col("field").isin(*signals.EVIDENCE_FIELDS)).select("record_id", "field").distinct()
    total = len(signals.EVIDENCE_FIELDS)
    counted = verified.groupBy("record_id").agg(F.count(F.lit(1)).alias("verified"))
    return records.join(counted, "record_id", "left").select(
        "record_id", F.coalesce("verified", F.lit(0)).alias("verified"), F.lit(total).alias("total"),
        S.js_round(F.coalesce("verified", F.lit(0)).cast("double") / F.lit(float(total)) * F.lit(100.0)).cast("int").alias("percent"),
    )


#: Offending ids that a report shows.
SAMPLE_IDS = 5


def normal_key(column: str) -> Column:
    """What a key is compared by: its text in lower case, without blanks around it."""
    return F.trim(F.lower(F.col(column).cast("string")))


def expectations(rows: DataFrame, rules: dict[str, Column], unique: list[str] = (), least_rows: int | None = None, id_col: str = "option_id") -> DataFrame:
    """Violations per rule, with the first few offending ids: rule, violations, first_id, sample_ids.

    All rules are one grouping pass over one scan. A row gives its keys, and
    itself for each row rule that it breaks; rows that keep all rules give no
    more than their keys. A row rule that comes out null is kept. Of a key that
    several rows share the smallest id is shown, and such a key counts once;
    null keys are equal to nothing. ``least_rows`` adds a rule on the number of
    rows. Rules that nothing breaks have zero violations, on no rows too.
    """
    spark, own = rows.sparkSession, F.col(id_col).cast("string")
    kinds = [F.when(~F.coalesce(rule, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.coalesce(own, F.lit("")).alias("key"), F.lit(1).alias("many"))) for name, rule in rules.items()]
    kinds += [F.when(normal_key(c).isNotNull(), F.struct(F.lit(f"unique_{c}").alias("rule"), normal_key(c).alias("key"), F.lit(2).alias("many"))) for c in unique]
    if least_rows is not None:
        # the rows themselves are counted in the same pass, once per task
        kinds.append(F.struct(F.lit("record_count").alias("rule"), F.lit("").alias("key"), F.lit(0).alias("many")))
    given = rows.select(F.col(id_col).alias("_id"), F.inline(F.array_compact(F.array(*kinds))))
    grouped = materialize(given.groupBy("rule", "key", "many").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("id")), "expectations")
    broken = grouped.where("many > 0 AND n >= many").withColumn("n", F.when(F.col("many") == 1, F.col("n")).otherwise(1))
    few = broken.select("rule", "id", F.row_number().over(Window.partitionBy("rule").orderBy("id")).alias("place")).where(F.col("place") <= SAMPLE_IDS)
    ids = few.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("sample_ids"))
    counts = broken.groupBy("rule").agg(F.sum("n").alias("violations"), F.min("id").alias("first_id"))
    names = spark.createDataFrame([(n,) for n in [*rules, *(f"unique_{c}" for c in unique)]], "rule string")
    none = F.lit(0).cast("bigint")
    found = names.join(counts, "rule", "left").join(ids, "rule", "left").select("rule", F.coalesce("violations", none).alias("violations"), "first_id", "sample_ids")
    if least_rows is None:
        return found
    total = grouped.where("many = 0").agg((F.coalesce(F.sum("n"), none) < least_rows).cast("bigint").alias("violations"))
    return found.unionByName(total.select(F.lit("record_count").alias("rule"), "violations", F.lit(None).cast(rows.schema[id_col].dataType).alias("first_id"), F.lit(None).cast("string").alias("sample_ids")))
