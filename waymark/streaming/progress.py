"""Task toggles as a stream: latest completion per user and task."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.session import run_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def toggle_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(toggles: DataFrame, name: str) -> DataFrame:
    """Drain the available input; each batch appends its toggles (event_id, profile_id, task_id).

    The stream keeps no state: a replayed event, in whatever batch, is told by
    its id when the table is read, so no event is ever too late to count.
    """
    spark = toggles.sparkSession
    base = run_folder(spark, name)
    once = toggles.select("event_id", "profile_id", "task_id")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.distinct().write.mode("append").parquet(f"{base}/out")

    stream = once.writeStream.foreachBatch(append).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{base}/out")


def latest(out: DataFrame) -> DataFrame:
    """A task is done after an odd number of distinct toggles, so arrival order does not matter."""
    once = out.dropDuplicates(["event_id"])
    return once.groupBy("profile_id", "task_id").agg((F.count(F.lit(1)) % 2 == 1).alias("done"))
