import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from waymark.llm import mixture as M


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets of the sources in order, by sharing out what is left round by round."""
    target, weight = [0.0] * len(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    open_ = [i for i in range(len(sizes)) if sizes[i]]
    left = share * sum(sizes)
    while open_ and left > 1e-9:
        level = left / sum(weight[i] for i in open_)
        for i in list(open_):
            add = min(level * weight[i], most * sizes[i] - target[i])
            target[i] += add
            left -= add
            if target[i] >= most * sizes[i] - 1e-9:
                open_.remove(i)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_against_brute_force(documents):
    rows = documents.collect()
    names = sorted({r.source for r in rows})
    sizes = [sum(words(r.text) for r in rows if r.source == s) for s in names]
    target = dict(zip(names, filled(sizes)))
    got = {r.doc_id: r for r in M.taken_words(documents).collect()}
    for r in rows:
        g = got[r.doc_id]
        assert g["size"] == words(r.text) and g.target == pytest.approx(target[r.source])
        rate = g.target / g.source_size
        u = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        assert g.taken == g["size"] * (math.floor(rate) + (u < rate - math.floor(rate)))
    assert M.mix(documents).count() == sum(g.taken // g["size"] for g in got.values() if g["size"])


def test_targets_stop_and_are_reshared(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 20), (None, 300), ("z", 0)]
    got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(sizes, "source string, size bigint")).collect()}
    order = ["a", "b", "c", "d", "z", None]
    assert got == pytest.approx(dict(zip(order, filled([dict(sizes)[s] for s in order]))))
    assert sum(got.values()) == pytest.approx(1.5 * 1830)


def test_many_sources_come_near_their_targets(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.expr("repeat('w ', 1 + cast(id % 9 as int))").alias("text"))
    got = M.taken_words(docs).groupBy(F.col("doc_id") % 7).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.05 for r in got)


def test_ranks_run_over_all_partitions(spark):
    sizes = spark.range(1000).select(F.format_string("s%04d", "id").alias("source"), F.lit(10).cast("bigint").alias("size"))
    got = [r.target for r in M.source_targets(sizes).orderBy("source").collect()]
    assert got == pytest.approx(filled([10] * 1000))


def test_odd_rows(odd, none):
    got = M.taken_words(odd)
    assert got.count() == odd.count() and got.where("taken > 2 * size").count() == 0
    assert got.where("size IS NULL OR target IS NULL").count() == 0
    mixed = M.mix(odd)
    assert mixed.columns == odd.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, M.mix(odd).collect()))
    assert M.taken_words(none).count() == 0 and M.mix(none).count() == 0
    empty = odd.where("text IS NULL")
    assert [r.taken for r in M.taken_words(empty).collect()] == [0, 0]
