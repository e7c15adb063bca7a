"""Page snapshots as a stream: an event whenever a URL's content hash changes."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.session import run_folder

CHANGE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("before_hash", T.StringType()), T.StructField("after_hash", T.StringType()),
])
#: The snapshots a later one may still fall between, oldest first, as one JSON list.
STATE = T.StructType([T.StructField("snapshots", T.StringType())])
#: Snapshots may come this much later than the newest one. Of older ones, a URL's state keeps the last, whatever its age.
LATENESS = "90 days"


def _changes(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Put the new snapshots among those seen and give every snapshot whose predecessor is new, with its predecessor.

    A later batch may give the same snapshot another predecessor; the newest
    batch counts. Rows are taken as a whole, so Arrow chunks make no difference.
    """
    before = [tuple(s) for s in json.loads(state.get[0])] if state.exists else []
    if state.hasTimedOut:
        # nothing can fall before the last one any more, and it is the predecessor of whatever comes next
        state.update((json.dumps(before[-1:]),))
        return
    new = sorted({(int(ts.value), value) for chunk in chunks for ts, value in chunk[["ts", "content_hash"]].itertuples(index=False)} - set(before))
    horizon = state.getCurrentWatermarkMs() * 1_000_000
    seen = sorted(set(before) | set(new))
    moved = {i for s in new for i in (bisect_left(seen, s), bisect_left(seen, s) + 1) if 0 < i < len(seen)}
    if moved:
        yield pd.DataFrame([(key[0], pd.Timestamp(seen[i][0]), seen[i - 1][1], seen[i][1]) for i in sorted(moved)], columns=CHANGE.names)
    # the last one at the horizon stays: it is the predecessor of what comes next
    first = max(0, bisect_left(seen, (horizon,)) - 1)
    state.update((json.dumps(seen[first:]),))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), seen[-1][0] // 1_000_000) + 1 + _milliseconds(LATENESS))


def _milliseconds(days: str) -> int:
    return int(days.split()[0]) * 86_400_000


def change_stream(snapshots: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``snapshots`` streams url, ts, content_hash in any order within the lateness.

    Emits url, ts, before_hash, after_hash whenever a snapshot gets a
    predecessor; ``latest_changes`` keeps the newest per snapshot. A URL that
    is fetched again after any gap is compared with its last snapshot: once a
    URL has been quiet for the lateness, its state is that one snapshot.
    """
    return snapshots.withWatermark("ts", lateness).groupBy("url").applyInPandasWithState(_changes, CHANGE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def change_batch(snapshots: DataFrame) -> DataFrame:
    """The same events from a complete table; equal times go by hash."""
    before = F.lag("content_hash").over(Window.partitionBy("url").orderBy("ts", "content_hash"))
    return snapshots.withColumn("before_hash", before).where(F.col("before_hash") != F.col("content_hash")).select(
        "url", "ts", "before_hash", F.col("content_hash").alias("after_hash"),
    )


def run_to_table(changes: DataFrame, name: str) -> DataFrame:
    """Drain the available input; each batch appends what it found, with its number."""
    spark = changes.sparkSession
    base = run_folder(spark, name)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")

    stream = (
        changes.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return spark.read.schema(T.StructType([*CHANGE.fields, T.StructField("batch_id", T.IntegerType())])).parquet(f"{base}/out")


def latest_changes(out: DataFrame) -> DataFrame:
    """Per snapshot the newest predecessor found; an equal one is no change."""
    newest = out.groupBy("url", "ts", "after_hash").agg(F.max_by("before_hash", "batch_id").alias("before_hash"))
    return newest.where("before_hash <> after_hash").select("url", "ts", "before_hash", "after_hash")
