"""Session defaults shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "waymark", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "20g").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A scratch one is made only in local mode, where all tasks share the machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = os.environ.get("WAYMARK_SCRATCH") or tempfile.mkdtemp(prefix="waymark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


_FOLDERS: dict[tuple[str, str], str] = {}


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one stage in the application's own part of the shared folder, which goes when the driver ends."""
    shared = checkpoint_dir(spark).rstrip("/")
    key = (spark.sparkContext.applicationId, shared)
    if key not in _FOLDERS:
        # only a folder that is there can be marked to go
        own = f"{shared}/waymark-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)
        _FOLDERS[key] = own
    return f"{_FOLDERS[key]}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once to the shared folder and read it back.

    A stage feeds several jobs; as a table it is computed once, survives lost
    executors, and keeps later filters from re-evaluating what built it.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash narrow rows on a key before they fan out.

    A profile becomes many pairs. Later windows on the same key run where the
    rows already are: what the rows grow into never shuffles. The number of
    partitions follows the data, up to the session's shuffle partitions, or is
    ``parts`` where the caller knows how much the rows become.
    """
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="waymark-"), "waymark"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on, for sessions built elsewhere.

    Generated methods above the JVM's compile limit run interpreted, so wide
    scoring projections fall back to split methods instead.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # narrow rows that fan out are few bytes and much work
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    # a batch is held by the JVM and by a Python worker, more than once by each
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    return spark
