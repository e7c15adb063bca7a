"""Dictionaries of segments: what a segment's entries are in the whole corpus, without a broadcast.

A segment is a run of texts that one task read at a time. It names its distinct
entries (words, pairs) by small numbers of its own, so that its stream is short,
and only the entries meet the corpus, once per segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F


def numbers() -> Iterator[int]:
    """Numbers of the segments of the running task; no two tasks of a job share one."""
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def entries(segments: DataFrame, lists: dict[str, str], same: list[str] | None = None) -> DataFrame:
    """A row per dictionary entry: segment, number from 0, the ``same`` columns, and an element of each list under its new name."""
    zipped = F.arrays_zip(*[F.col(c).alias(name) for c, name in lists.items()])
    rows = segments.select("segment", *(same or []), F.posexplode(zipped).alias("number", "entry"))
    return rows.select("segment", "number", *(same or []), *[F.col(f"entry.{name}").alias(name) for name in lists.values()])


def with_resolved(segments: DataFrame, resolved: DataFrame, columns: list[str]) -> DataFrame:
    """``segments`` with what became of their entries: ``numbers`` and the ``columns`` as lists; empty where nothing did.

    Entries whose first column is null are left out. A list holds at most the
    distinct entries of one segment.
    """
    listed = resolved.groupBy("segment").agg(F.collect_list(F.when(F.col(columns[0]).isNotNull(), F.struct("number", *columns))).alias("_found"))
    found = F.coalesce("_found", F.array().cast(listed.schema["_found"].dataType))
    joined = segments.join(listed, "segment", "left")
    return joined.select(*[F.col(c) for c in segments.columns], *[found[c].alias(c if c != "number" else "numbers") for c in ("number", *columns)])


def flat(column: pa.Array) -> tuple[pa.Array, list[int]]:
    """The elements of a list column in a row, and how many each row has."""
    import pyarrow.compute as pc

    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_pylist()
