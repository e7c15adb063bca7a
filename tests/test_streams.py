"""Streams over several unsorted files and tiny Arrow batches give what the whole table gives."""

import datetime
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.plans.stream_queries import _snapshots
from waymark.streaming import freshness as FR, progress as PR


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """The events in six files without order, a seventh of them twice."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 5 = 0")
    again = events.where("event_id % 7 = 0")
    events.unionByName(again).repartition(6, F.rand(3)).write.parquet(path)
    return path


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_freshness(spark, files, tiny_batches):
    stream = FR.change_stream(_snapshots(PR.toggle_stream(spark, files, 1)))
    out = FR.run_to_table(stream, "test-freshness")
    assert out.select("batch_id").distinct().count() > 3
    streamed = FR.latest_changes(out)
    batch = FR.change_batch(_snapshots(spark.read.parquet(files).withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"])))
    rows = [sorted(map(tuple, df.select("url", "ts", "before_hash", "after_hash").collect())) for df in (streamed, batch)]
    assert len(rows[1]) > 50 and rows[0] == rows[1]


def test_progress(spark, files):
    toggles = PR.toggle_stream(spark, files, 1).select("event_id", F.col("user_id").alias("profile_id"), F.col("event_type").alias("task_id"))
    streamed = {(r.profile_id, r.task_id): r.done for r in PR.latest(PR.run_to_table(toggles, "test-progress")).collect()}
    once = spark.read.parquet(files).dropDuplicates(["event_id"])
    whole = {(r.user_id, r.event_type): r["count"] % 2 == 1 for r in once.groupBy("user_id", "event_type").count().collect()}
    assert streamed == whole and set(whole.values()) == {True, False}


def test_changes_across_long_gaps(spark, tmp_path):
    """Four batches, each 200 days after the one before; between them other URLs move the watermark on."""
    start, schema = datetime.datetime(2024, 1, 1), "url string, ts timestamp, content_hash string"
    rows = [[("a", start + datetime.timedelta(days=200 * k + d), h) for d, h in ((0, f"h{k // 2}"), (1, f"h{k // 2}"))] + [(f"other{k}", start + datetime.timedelta(days=200 * k + 150), "x")] for k in range(4)]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the source takes files in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = FR.run_to_table(FR.change_stream(stream), "test-gaps")
    assert out.count() and len(spark.read.parquet(str(tmp_path / "in")).inputFiles()) == 4
    streamed = sorted(map(tuple, FR.latest_changes(out).collect()))
    batch = sorted(map(tuple, FR.change_batch(spark.createDataFrame([r for b in rows for r in b], schema)).select("url", "ts", "before_hash", "after_hash").collect()))
    assert [r[0] for r in batch] == ["a"] and streamed == batch


def test_state_of_quiet_urls_is_one_snapshot():
    """The state function alone, with a stand-in for the state."""
    class Held:
        exists, hasTimedOut, value, timeout = False, False, None, None
        get = property(lambda self: self.value)

        def update(self, value):
            self.value, self.exists = value, True

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    state = Held()
    days = [pd.Timestamp("2024-01-01") + pd.Timedelta(days=d) for d in range(50)]
    frame = pd.DataFrame({"ts": days, "content_hash": [f"h{d}" for d in range(50)]})
    assert len(list(FR._changes(("a",), iter([frame]), state))[0]) == 49 and len(json.loads(state.value[0])) == 50
    state.hasTimedOut = True
    assert list(FR._changes(("a",), iter([]), state)) == [] and json.loads(state.value[0]) == [[days[-1].value, "h49"]]
