"""Files that tasks write and read themselves, in the folder that the driver and all executors share."""

from __future__ import annotations

import re

import pyarrow.fs
from pyspark.sql import SparkSession

#: Schemes that Hadoop and Arrow name differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark gives it, so that tasks open the same place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified path and the place in it. A path without a scheme is refused: each executor would open its own disk."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", uri)
    if not found:
        raise ValueError(f"{uri} has no scheme; qualify it on the driver")
    scheme, rest = ARROW_SCHEMES.get(found[1].lower(), found[1]), found[2]
    return pyarrow.fs.FileSystem.from_uri("file://" + re.sub(r"^/*", "/", rest) if scheme == "file" else f"{scheme}:{rest}")
