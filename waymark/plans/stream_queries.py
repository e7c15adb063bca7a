"""Streaming keys, drained over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import scalar as S
from waymark.plans import bindings as B, oracle_match as O, page_bindings as V
from waymark.session import run_folder
from waymark.streaming import freshness as FR, progress as PR, refresh as RF

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("stream_progress", f"""SELECT user_id AS profile_id, {O.lst(B.TASK_IDS)}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 + 1] AS task_id, count(*) % 2 = 1 AS done FROM events WHERE event_type = 'click' GROUP BY ALL""")
def stream_progress(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    toggles = PR.toggle_stream(spark, f"{sf}/events*.parquet").where(F.col("event_type") == "click").select(
        "event_id", "ts", F.col("user_id").alias("profile_id"), S.pick(B.TASK_IDS, k % 12).alias("task_id"),
    )
    return PR.latest(PR.run_to_table(toggles, "progress"))


def _snapshots(events):
    return events.select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".edu/")).alias("url"), "ts", F.sha2(F.floor(F.col("value") / 20).cast("string"), 256).alias("content_hash"))


@query("stream_freshness", """WITH s AS (SELECT user_id, ts, CAST(floor(value / 20) AS BIGINT) AS v FROM events), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts, sha256(CAST(v AS VARCHAR))) AS b FROM s)
SELECT 'https://u' || user_id || '.edu/' AS url, ts, sha256(CAST(b AS VARCHAR)) AS before_hash, sha256(CAST(v AS VARCHAR)) AS after_hash FROM l WHERE b <> v""")
def stream_freshness(spark, sf):
    stream = _snapshots(PR.toggle_stream(spark, f"{sf}/events*.parquet"))
    found = FR.latest_changes(FR.run_to_table(FR.change_stream(stream), "freshness"))
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("refresh_candidates", V.OUTCOMES.replace("WITH", O.with_(V.RENDERED_SQL).rstrip() + ",", 1) + """
SELECT page_id, field, value, academic_year, year_source, cand_kind, CAST(CASE WHEN page_id % 20 = 3 THEN 1 ELSE 0 END AS BIGINT) AS version FROM v_candidate""")
def refresh_candidates(spark, sf):
    """All pages, first with some that say something else, then as they are: the second turn extracts those alone."""
    now = V.rendered(spark, sf).unionByName(V.cds_rendered(spark, sf))
    other = "<html><head><title>Fees</title></head><body><main><h1>Fees</h1><p>Tuition is $1,234 per year for 2026-27.</p></main></body></html>"
    base = run_folder(spark, "refresh")
    RF.refresh(now.withColumn("html", F.when(F.col("page_id") % 20 == 3, F.lit(other)).otherwise(F.col("html"))).withColumn("retrieved_at", F.lit("2026-01-01")), base, 0)
    RF.refresh(now.withColumn("retrieved_at", F.lit("2026-02-01")), base, 1)
    return RF.current(spark, base).select("page_id", "field", "value", "academic_year", "year_source", "cand_kind", "version")
