"""Helpers of the operators: written stages, packed rows and byte-level words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm.files import qualified
from waymark.session import run_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path, with its scheme, in the folder that the driver and all executors share; it goes when the driver ends."""
    return qualified(spark, run_folder(spark, name))


def stage(df: DataFrame, name: str, *partition_by: str, most_rows: int | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back: it is computed once and outlives executors.

    Parquet weighs what it holds only after a hundred rows, and is read a row
    group at a time; rows of megabytes need ``most_rows`` of a row group.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if most_rows:
        writer = writer.option("parquet.block.row.count.limit", most_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a row group where each is a segment of texts.
SEGMENT_ROWS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unpack(packed: str, added: dict[str, Column], columns: list[str]) -> list[Column]:
    """The packed input row's columns, then the added ones; an added name replaces an input column of that name."""
    fresh = {name.lower() for name in added}
    return [F.col(f"{packed}.`{c}`").alias(c) for c in columns if c.lower() not in fresh] + [c.alias(name) for name, c in added.items()]


# ---- words as 64-bit values -----------------------------------------------

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_CHUNK = 1 << 20


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of a word once A-Z are a-z: all but the excluded inclusive ranges."""
    table_ = np.ones(256, dtype=bool)
    for low, high in excluded:
        table_[low:high + 1] = False
    table_[ord("A"):ord("Z") + 1] = table_[ord("a"):ord("z") + 1]
    return table_


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1]
_TABLES: dict[str, np.ndarray] = {}


def _powered(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _TABLES["up"], _TABLES["down"] = _powers(_ODD, size), _powers(_INVERSE, size)
    return _TABLES["up"], _TABLES["down"]


def word_values(data: bytes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and 64-bit value of every word; A-Z count as a-z.

    The value is a polynomial over the word's bytes, so all words of a buffer
    come from one running sum. Long buffers are cut between words.
    """
    starts, values, done = [], [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while done < len(raw):
        end = min(len(raw), done + _CHUNK)
        while end < len(raw):
            gap = np.flatnonzero(~kind[raw[max(done, end - 4096):end]])
            if len(gap):
                end = max(done, end - 4096) + int(gap[-1]) + 1
                break
            end = min(len(raw), end + 4096)
        part = raw[done:end]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = kind[part]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            up, down = _powered(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_LETTER[part] * up[:len(part)], out=total[1:])
            values.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(first + done)
        done = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(values)


def joined_words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of all texts in order, and how many each text has. A blank must not be a word byte."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts, values = word_values(b" ".join(texts) + b" ", kind)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return values, np.diff(bounds)


def shingle_values(values: np.ndarray, n: int) -> np.ndarray:
    """Value of every run of n words; of a shorter text, that of the whole run, which equals no full one."""
    if len(values) < n:
        return whole_value(values) if len(values) else values
    out = np.zeros(len(values) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(_ODD) + values[i:len(values) - n + 1 + i]
    return mix(out)


def whole_value(values: np.ndarray) -> np.ndarray:
    out = np.uint64(len(values) * 0x2545F4914F6CDD1D & (2**64 - 1))
    with np.errstate(over="ignore"):
        for v in values:
            out = out * np.uint64(_ODD) + v
    return mix(np.array([out], dtype=np.uint64))


def one_list(values: np.ndarray, type_: pa.DataType) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, type_))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows in runs of about most_bytes of text, with the texts in UTF-8; null counts as empty."""
    for batch in batches:
        column_ = batch.column(batch.schema.get_field_index(column))
        sizes = np.array(pc.fill_null(pc.binary_length(column_), 0), dtype=np.int64)
        begin, size = 0, 0
        for i, n in enumerate([*sizes.tolist(), most_bytes + 1]):
            if i > begin and size + n > most_bytes:
                yield pa.Table.from_batches([batch.slice(begin, i - begin)]), [b"" if t is None else t for t in column_.slice(begin, i - begin).cast(pa.binary()).to_pylist()]
                begin, size = i, 0
            size += n
        pa.default_memory_pool().release_unused()
