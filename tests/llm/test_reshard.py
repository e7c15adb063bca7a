import itertools
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import reshard as R


def cost_of(flow, cost):
    return sum(f * c for fs, cs in zip(flow, cost) for f, c in zip(fs, cs))


def brute_cost(supply, capacity, cost):
    """Least cost over all ways to place single units."""
    best = None
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    for places in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(places.count(j) <= c for j, c in enumerate(capacity)):
            value = sum(cost[i][j] for i, j in zip(units, places))
            best = value if best is None else min(best, value)
    return best


def test_flow_is_least():
    rng = random.Random(4)
    for _ in range(60):
        m, n = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 2) for _ in range(m)]
        capacity = [rng.randint(0, 3) for _ in range(n)]
        cost = [[rng.randint(0, 4) for _ in range(n)] for _ in range(m)]
        if sum(capacity) < sum(supply):
            with pytest.raises(ValueError):
                R.min_cost_flow(supply, capacity, cost)
            continue
        flow = R.min_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply
        assert all(sum(f[j] for f in flow) <= capacity[j] for j in range(n))
        assert cost_of(flow, cost) == brute_cost(supply, capacity, cost)


def shards(df):
    return {r.shard: r for r in df.groupBy("shard").agg(F.sum(R.size_of("text")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"), F.sum(F.when(F.col("moved"), R.size_of("text")).otherwise(0)).alias("moved")).collect()}


def test_documents_move_no_more_than_needed(spark, documents):
    docs = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(documents.withColumn("doc_id", F.col("doc_id") + 2000))
    old = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 5)
    got = R.reshard(docs, old, 5, 4, piece_bytes=20_000)
    by = shards(got)
    total = sum(r.bytes for r in by.values())
    assert set(by) == {0, 1, 2, 3} and max(r.bytes for r in by.values()) - min(r.bytes for r in by.values()) < 2 * R.SMALL_BYTES
    assert all(r.low == 0 and r.high == r.rows - 1 and r.slots == r.rows for r in by.values())
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())
    held = {r.s: r.b for r in docs.groupBy(old.alias("s")).agg(F.sum(R.size_of("text")).alias("b")).collect()}
    least = total - sum(min(held.get(j, 0), total // 4) for j in range(4))
    assert sum(r.moved for r in by.values()) < least + 8 * R.SMALL_BYTES


def test_capacities_and_costs(spark, documents):
    sizes = documents.agg(F.sum(R.size_of("text"))).first()[0]
    cost = [[0, 1, 9], [1, 0, 9]]
    got = shards(R.reshard(documents, F.col("doc_id") % 2, 2, 3, capacities=[sizes // 4, sizes, sizes], cost=cost))
    assert set(got) == {0, 1} and abs(got[0].bytes - sizes // 4) < 2 * R.SMALL_BYTES


def test_odd_rows(odd, none):
    got = R.reshard(odd, F.when(F.col("doc_id") > 3, 1).when(F.col("doc_id") > 0, 0), 2, 3)
    assert got.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot", "moved"]
    assert sorted(str((r.doc_id, r.text, r.size)) for r in got.collect()) == sorted(str((r.doc_id, r.text, r.size)) for r in odd.collect())
    assert all(r.low == 0 and r.slots == r.rows for r in shards(got).values())
    assert R.reshard(none, F.lit(0), 2, 3).count() == 0
