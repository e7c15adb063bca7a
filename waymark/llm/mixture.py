"""Mixing sources to target weights by repetition.

Words are summed per source, targets set by weight, and each document is taken
floor(rate) times plus once more where a value drawn from its id falls below
the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import stage, unpack

#: By code point of the source, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, and the most of one source, in multiples of the sizes.
SHARE = 1.5
MOST = 2
SEED = "mix-1"
BLANKS = r"[\x20\x09-\x0D]+"
#: A source table of at most this many bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 4 << 20


def n_words(text: str) -> Column:
    body = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(body) == 0, F.lit(0)).otherwise(F.size(F.split(body, BLANKS))).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every row."""
    return docs.select("doc_id", "source", n_words("text").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from ``sizes`` (source, size); written.

    Sources are ranked by code point, null last, whatever their number. A
    source whose part exceeds ``most`` times its size stops there, and what is
    left goes to the others by weight, until none exceeds.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = stage(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sources")
    before, counts = 0, {}
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # one row per partition
        counts[r["part"]] = before
        before += r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("part")) if counts else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.pmod(offset + F.col("place"), F.lit(len(weights))).cast("int") + 1)
    weighed = ordered.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("most"))

    level, full = 0.0, -1
    while True:
        stopped = F.col("weight") * F.lit(level) > F.col("most") if full >= 0 else F.lit(False)
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.count(F.when(stopped, 1)).alias("full"), F.sum(F.when(stopped, F.col("most"))).alias("held"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("open"),
        ).first()
        if got["full"] == full or not got["open"]:
            break
        full, level = got["full"], (share * got["all"] - (got["held"] or 0)) / got["open"]
    target = F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with the size and target of their source; a null source matches null."""
    n, width = targets.agg(F.count(F.lit(1)), F.sum(F.length("source"))).first()
    own = targets.withColumnRenamed("source", "own_source")
    own = F.broadcast(own) if 32 * n + 4 * (width or 0) <= BROADCAST_BYTES else own
    return rows.join(own, F.col("source").eqNullSafe(F.col("own_source")), "left").drop("own_source")


def drawn(doc_id: str, seed: str = SEED) -> Column:
    """A value in [0, 1) from the id: 52 bits of a digest. A null id counts as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(16**13))


def copies(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """How often a row with source_size and target is taken."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + (drawn(doc_id, seed) < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of ``docs`` (doc_id, source, text).

    An empty text is taken as zero words; a source of such texts has rate 0.
    Rows with the same id draw the same value. Empty input gives no rows.
    """
    rows = stage(sized(docs), "sizes")
    rated = with_targets(rows, source_targets(rows))
    return rated.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns as they were.

    A row's copies follow from its source's rate and a draw from its id, so
    repeated rows are taken equally often, and all rows of null id too. Null
    texts have no words but are taken like other rows of their source, which
    may be null; a source without words has rate 0 and is not taken. Empty
    input gives no rows.
    """
    targets = source_targets(stage(sized(docs), "sizes"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source")
    rated = with_targets(packed, targets).select("_row", copies().alias("n")).where("n > 0")
    return rated.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(*unpack("_row", {}, docs.columns))
