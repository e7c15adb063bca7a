"""Rows of megabytes lie in small row groups, so that no task holds many of them at once."""

import pyarrow.parquet as pq
import pytest

from waymark.llm import alignment, common, positional
from waymark.session import tune


def _row_groups(df):
    files = [f.removeprefix("file://").removeprefix("file:") for f in df.inputFiles()]
    return [m.row_group(i).num_rows for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"some words of number {i} " * 20) for i in range(40)] + [(None, None)], "doc_id bigint, text string").coalesce(1)


def test_segments_of_the_index_lie_in_small_row_groups(docs):
    index = positional.build_index(docs, segment_bytes=100)
    held = _row_groups(index)
    assert sum(held) == index.count() > 20 and max(held) <= common.SEGMENT_ROWS
    assert sorted(map(str, positional.indexed_documents(index).select("doc_id").collect())) == sorted(map(str, docs.select("doc_id").collect()))


def test_aligned_segments_lie_in_small_row_groups(docs, monkeypatch):
    written = {}
    monkeypatch.setattr(alignment, "SEGMENT_BYTES", 100)
    monkeypatch.setattr(alignment, "stage", lambda df, name, *by, **k: written.setdefault(name, common.stage(df, name, *by, **k)))
    whole, _ = alignment.align(docs)
    assert whole.count() == 41
    assert max(_row_groups(written["aligned"])) <= common.SEGMENT_ROWS


def test_arrow_batches_are_bounded_by_bytes(spark):
    tune(spark)
    texts = spark.createDataFrame([(i, "x" * (1 << 20)) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    sizes = texts.mapInArrow(lambda it: map(_size, it), "n bigint").collect()
    assert sum(r.n for r in sizes) == 40 << 20 and max(r.n for r in sizes) <= 18 << 20


def _size(batch):
    import pyarrow as pa
    import pyarrow.compute as pc
    return pa.RecordBatch.from_arrays([pa.array([pc.sum(pc.binary_length(batch.column(1))).as_py()], pa.int64())], ["n"])
