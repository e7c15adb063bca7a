"""Minimum-cost-flow resharding: from old shard sizes to new capacities, moving the fewest bytes.

The flow between old and new shards is solved on the driver, on shard totals
alone. Each old shard then lays its rows in an order of blocks and gives one
range of that order to each receiver; a document belongs where its middle
falls. Large documents go first, then small ones fill what is missing to the
byte count of each transfer, so shards end near their capacities. Files without
a leaving row stay as they are; the others are rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.common import shared_path, stage, unpack

#: Blocks of a shard's order. What the driver and broadcasts hold is bounded by shards times blocks.
BLOCKS = 4096
#: Bytes of text in a file of the layout, as long as a file holds a block.
PIECE_BYTES = 32 << 20
#: Documents up to this size fill the rest of a transfer.
SMALL_BYTES = 2048


def size_of(text: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint")


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each supplier to each receiver, all supply placed at the least cost.

    Successive shortest paths with potentials; costs are not negative and the
    capacities together hold the supply.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities do not hold the rows")
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    graph: list[list[list[int]]] = [[] for _ in range(m + n + 2)]

    def edge(a: int, b: int, most: int, price: int) -> None:
        graph[a].append([b, most, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i in range(m):
        edge(source, i, supply[i], 0)
        for j in range(n):
            edge(i, m + j, supply[i], cost[i][j])
    for j in range(n):
        edge(m + j, sink, capacity[j], 0)
    potential = [0] * len(graph)
    while True:
        far, before = [float("inf")] * len(graph), [None] * len(graph)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, most, price, _) in enumerate(graph[a]):
                step = d + price + potential[a] - potential[b]
                if most > 0 and step < far[b]:
                    far[b], before[b] = step, (a, k)
                    heapq.heappush(queue, (step, b))
        if before[sink] is None:
            break
        potential = [p + f if f < float("inf") else p for p, f in zip(potential, far)]
        path, b = [], sink
        while b != source:
            a, k = before[b]
            path.append(graph[a][k])
            b = a
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    return [[graph[m + j][next(k for k, e in enumerate(graph[m + j]) if e[0] == i)][1] for j in range(n)] for i in range(m)]


def _ranges(spark, amounts: dict[tuple[int, int], dict[int, int]]) -> DataFrame:
    """Ranges of each (old shard, tier) order; the own shard's comes first, the last has no end."""
    rows = []
    for (old, tier), parts in amounts.items():
        begin, order = 0, sorted(parts, key=lambda j: (j != old, j))
        for k, to in enumerate(order):
            end = begin + parts[to] if k < len(order) - 1 else 2**62
            rows.append((old, tier, begin if k else -1, end, to))
            begin = end
    return spark.createDataFrame(rows, "_old int, _tier int, _from bigint, _upto bigint, _to int")


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, capacities: list[int] | None = None, cost: list[list[int]] | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) in their new shards: all columns, and shard, slot, moved.

    ``old_shard`` gives 0 to ``old_shards`` - 1, null counts as 0; new shard i takes the place of
    old shard i. ``capacities`` are in bytes (text in UTF-8 and one more per
    row; equal by default), ``cost`` is per byte from old to new shard (by
    default nothing in place, one elsewhere). ``slot`` counts from 0 in each
    shard. Null texts are empty; null ids and repeated rows are rows like
    others; an input column named shard, slot or moved is replaced. Empty input
    gives no rows.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    packed = docs.select(row, F.coalesce(old_shard.cast("int"), F.lit(0)).alias("_old"), size_of("text").alias("_size"), F.xxhash64("doc_id", "text").alias("_order"))
    packed = packed.select("*", (F.col("_size") <= SMALL_BYTES).cast("int").alias("_tier"), F.pmod("_order", F.lit(BLOCKS)).cast("int").alias("_block"))

    total = {(r["_old"], r["_tier"]): r["bytes"] for r in packed.groupBy("_old", "_tier").agg(F.sum("_size").alias("bytes")).collect()}
    held = [total.get((i, 0), 0) + total.get((i, 1), 0) for i in range(old_shards)]
    capacities = capacities or equal_capacities(sum(held), new_shards)
    cost = cost or [[int(i != j) for j in range(new_shards)] for i in range(old_shards)]
    flow = min_cost_flow(held, capacities, cost)

    # the old files: rows in order, a run of blocks in each
    pieces = [min(BLOCKS, max(1, -(-b // piece_bytes))) for b in held]
    of_shard = F.element_at(F.array(*[F.lit(p) for p in pieces]), F.col("_old") + 1)
    order = Window.partitionBy("_old", "_piece", "_tier", "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    laid = packed.withColumn("_piece", F.floor(F.col("_block") * of_shard / BLOCKS).cast("int")).repartition("_old", "_piece")
    laid = laid.select("*", F.row_number().over(Window.partitionBy("_old", "_piece", "_tier", "_block").orderBy("_order")).alias("_rank"), (F.sum("_size").over(order) - F.col("_size")).alias("_before"))
    layout = stage(laid.drop("_order"), "old-shards", "_old", "_piece")

    narrow = layout.select("_old", "_piece", "_tier", "_block", "_rank", "_before", "_size")
    of_block = Window.partitionBy("_old", "_tier").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = narrow.groupBy("_old", "_tier", "_block").agg(F.sum("_size").alias("bytes"))
    blocks = stage(blocks.select("_old", "_tier", "_block", (F.sum("bytes").over(of_block) - F.col("bytes")).alias("_start")), "blocks")

    def placed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
        middle = F.col("_start") + F.col("_before") + F.floor(F.col("_size") / 2)
        own = rows.join(F.broadcast(blocks), ["_old", "_tier", "_block"]).join(F.broadcast(ranges), ["_old", "_tier"])
        return own.where((middle >= F.col("_from")) & (middle < F.col("_upto"))).drop("_start", "_from", "_upto")

    large, small = {}, {}
    for i in range(old_shards):
        parts = {j: flow[i][j] for j in range(new_shards) if flow[i][j]}
        if parts:
            large[i, 0] = {j: v * total.get((i, 0), 0) // held[i] for j, v in parts.items()}
            small[i, 1] = parts
    first = _ranges(spark, large)
    for r in placed(narrow.where("_tier = 0"), first).groupBy("_old", "_to").agg(F.sum("_size").alias("bytes")).collect():
        small[r["_old"], 1][r["_to"]] = max(0, small[r["_old"], 1][r["_to"]] - r["bytes"])
    ranges = first.unionByName(_ranges(spark, small))

    assigned = placed(narrow, ranges)
    groups = assigned.groupBy("_to", "_old", "_tier", "_block").agg(F.count(F.lit(1)).alias("rows"), F.min("_rank").alias("_first"))
    of_shard = Window.partitionBy("_to").orderBy("_old", "_tier", "_block").rowsBetween(Window.unboundedPreceding, 0)
    groups = stage(groups.select("_to", "_old", "_tier", "_block", (F.sum("rows").over(of_shard) - F.col("rows") - F.col("_first")).alias("_shift")), "slots")
    affected = stage(assigned.where("_to <> _old").select("_old", "_piece").distinct(), "affected-files")

    leaving = placed(layout.join(F.broadcast(affected), ["_old", "_piece"], "left_semi"), ranges)
    path = shared_path(spark, "new-shards")
    leaving.write.option("compression", "zstd").partitionBy("_to").parquet(path)
    rewritten = spark.read.schema(leaving.schema).parquet(path)
    staying = layout.join(F.broadcast(affected), ["_old", "_piece"], "left_anti").withColumn("_to", F.col("_old"))
    both = staying.unionByName(rewritten).join(F.broadcast(groups), ["_to", "_old", "_tier", "_block"])
    added = {"shard": F.col("_to"), "slot": (F.col("_shift") + F.col("_rank")).cast("bigint"), "moved": F.col("_to") != F.col("_old")}
    return both.select(*unpack("_row", added, docs.columns))
