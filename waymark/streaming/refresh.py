"""Incremental refresh of page candidates: only pages whose content changed are extracted again.

A refresh writes two tables below its folder, a part per turn. ``known`` says
which content each page showed last and which version of its candidates holds;
``candidates`` has the values of the pages that a turn extracted. Nothing is
rewritten: a page's new version replaces its old one because ``known`` points to
it, and it does so only once the candidates are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.operators import extract as X, pages as G
from waymark.session import materialize

#: Time of a snapshot that has none: before all others.
NO_TIME = "0001-01-01 00:00:00"


def extracted(pages: DataFrame) -> DataFrame:
    """Candidates of raw pages, content read once."""
    return X.extract_candidates(materialize(G.with_scope(G.with_content(pages)), "refresh-content"))


def _hash_of(pages: DataFrame) -> Column:
    return F.col("content_hash") if "content_hash" in pages.columns else F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def _last_known(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """Per page the newest snapshot seen: page_id, seen (time, hash), version. Of turns below ``before``, if given."""
    known = _table(spark, f"{base}/known")
    if known is None:
        return None
    known = known if before is None else known.where(F.col("turn") < before)
    newest = F.max(F.struct("seen", "turn", "version")).alias("last")
    return known.groupBy("page_id").agg(newest).select("page_id", F.col("last.seen").alias("seen"), F.col("last.version").alias("version"))


def refresh(pages: DataFrame, base: str, turn: int, extract: Callable[[DataFrame], DataFrame] = extracted) -> None:
    """One turn over ``pages`` (page_id, html, and what ``extract`` reads; retrieved_at and content_hash if there).

    Of a page's snapshots the newest counts, equal times go by hash, and one
    without a time comes first; so turns may come in any split. A snapshot that
    is newer and of the same content moves the page's time on, and nothing is
    extracted; an older one changes nothing. Null html is empty content, whose
    candidates replace earlier ones by none. Repeated rows count once; rows
    without a page_id are left out. A turn that is run again, after a failure,
    gives the same tables.
    """
    spark = pages.sparkSession
    time = F.col("retrieved_at").cast("timestamp") if "retrieved_at" in pages.columns else F.lit(None).cast("timestamp")
    at = F.struct(F.coalesce(time, F.lit(NO_TIME).cast("timestamp")).alias("at"), _hash_of(pages).alias("hash"))
    given = pages.where("page_id IS NOT NULL").withColumn("_at", at)
    # only ids, times and hashes are compared
    newest = given.groupBy("page_id").agg(F.max("_at").alias("seen"))
    before = _last_known(spark, base, turn)
    if before is not None:
        was = before.select("page_id", F.col("seen").alias("was"), "version")
        newest = newest.join(was, "page_id", "left").where("was IS NULL OR seen > was")
        same = F.coalesce(F.col("was.hash") == F.col("seen.hash"), F.lit(False))
        newest = newest.select("page_id", "seen", F.when(same, F.col("version")).otherwise(F.lit(turn)).cast("bigint").alias("version"))
    else:
        newest = newest.withColumn("version", F.lit(turn).cast("bigint"))
    newest = materialize(newest, "refresh-newest")

    changed = newest.where(F.col("version") == turn).select("page_id", F.col("seen").alias("_at"))
    fresh = given.join(changed, ["page_id", "_at"]).dropDuplicates(["page_id"]).select(*[F.col(f"`{c}`") for c in pages.columns])
    # the changed pages are a table of their own: extraction reads them several times
    extract(materialize(fresh, "refresh-pages")).write.mode("overwrite").parquet(f"{base}/candidates/version={turn}")
    newest.write.mode("overwrite").parquet(f"{base}/known/turn={turn}")


def current(spark: SparkSession, base: str) -> DataFrame:
    """The candidates that hold now, with the version (turn) that each page's come from."""
    holds = _last_known(spark, base)
    if holds is None:
        raise ValueError(f"no turn of a refresh is in {base}")
    found = spark.read.parquet(f"{base}/candidates").withColumn("version", F.col("version").cast("bigint"))
    return found.join(holds.select("page_id", "version"), ["page_id", "version"])


def refresh_stream(pages: DataFrame, base: str, extract: Callable[[DataFrame], DataFrame] = extracted) -> None:
    """Take what a stream of pages has, a turn per batch. A batch that fails is taken again under its own number."""
    run = pages.writeStream.foreachBatch(lambda batch, number: refresh(batch, base, number, extract))
    run.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
