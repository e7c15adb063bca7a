"""Refreshes in turns give what one extraction of the newest pages gives, and extract changed pages only."""

import time

from pyspark.sql import functions as F

from waymark.plans import page_bindings as V
from waymark.streaming import refresh as RF

SCHEMA = "page_id bigint, html string, retrieved_at string"


def words(seen):
    """An extraction that notes which pages it was given."""
    def extract(pages):
        seen.append(sorted(r.page_id for r in pages.select("page_id").collect()))
        return pages.select("page_id", F.explode(F.split(F.coalesce("html", F.lit("")), " ")).alias("word")).where("word <> ''")
    return extract


def now(spark, base):
    return sorted(tuple(r) for r in RF.current(spark, base).select("page_id", "word", "version").collect())


def test_turns(spark, tmp_path):
    base, seen = str(tmp_path / "r"), []
    turns = [
        [(1, "a b", "2026-01-01"), (2, "c", "2026-01-01"), (2, "c", "2026-01-01"), (3, "d", None), (None, "x", "2026-01-01")],
        [(1, "a b", "2026-01-03"), (2, "e", "2026-01-02"), (2, "old", "2025-01-01"), (4, None, "2026-01-01")],
        # late for 1, whose content was seen again since; 2 goes empty, 3 gets a time
        [(1, "late", "2026-01-02"), (2, None, "2026-01-05"), (3, "f f", "2026-01-01")],
        [],
    ]
    for turn, rows in enumerate(turns):
        for _ in range(2 if turn == 1 else 1):  # a turn that is run again
            RF.refresh(spark.createDataFrame(rows, SCHEMA), base, turn, words(seen))
    assert seen == [[1, 2, 3], [2, 4], [2, 4], [2, 3], []]
    assert now(spark, base) == [(1, "a", 0), (1, "b", 0), (3, "f", 2), (3, "f", 2)]


def test_stream_of_pages(spark, tmp_path):
    """A second fetch in which one page of twenty differs."""
    base, seen = str(tmp_path / "r"), []
    for day, changed in ((1, 0), (2, 20)):
        rows = [(i, f"p{i} {day}" if changed and i % changed == 0 else f"p{i}", f"2026-01-0{day}") for i in range(100)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    RF.refresh_stream(stream, base, words(seen))
    assert seen == [list(range(100)), [0, 20, 40, 60, 80]]
    whole = sorted({(i, w) for i in range(100) for w in ([f"p{i}", "2"] if i % 20 == 0 else [f"p{i}"])})
    assert [r[:2] for r in now(spark, base)] == whole


def test_candidates_of_pages(spark, sf):
    from waymark.plans.stream_queries import refresh_candidates

    columns = ["page_id", "field", "value", "academic_year", "year_source", "cand_kind"]
    found = refresh_candidates(spark, sf)
    whole = RF.extracted(V.rendered(spark, sf).unionByName(V.cds_rendered(spark, sf)))
    rows = [sorted(map(str, df.select(*columns).collect())) for df in (found, whole)]
    assert len(rows[1]) > 50 and rows[0] == rows[1]
    assert {r.page_id for r in found.where("version = 1").collect()} <= {r.page_id for r in found.collect() if r.page_id % 20 == 3}
