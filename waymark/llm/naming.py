"""Exact dedup by deterministic block naming.

The normalised text is cut into blocks of a fixed size. Equal blocks get one
integer name; then adjacent names are paired and the pairs named again, level
by level, until each document has one name. A name stands for one content only,
so two documents of as many blocks are equal exactly if their names are.

Contents are shuffled once, to be told apart and sorted into names. A block
finds its name by a 128-bit address; an address that two contents share is
noticed there, and its blocks are then named by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import stage

BLANKS = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1024
#: Stands for the missing partner of an odd last name; no name is as small.
NO_PARTNER = -(2**63)


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def _address(block: Column, bits: int) -> list[Column]:
    low, high = F.xxhash64(block), F.xxhash64(F.lit(1), block)
    if bits < 64:
        low, high = F.pmod(low, F.lit(2**bits)), F.lit(0).cast("bigint")
    return [low.alias("low"), high.alias("high")]


def _blocks(docs: DataFrame, size: int, bits: int, *kept: str) -> DataFrame:
    n = F.greatest(F.ceil(F.octet_length("body") / size), F.lit(1)).cast("int")
    cut = docs.withColumn("n", n).select(*kept, "n", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    block = cut.select(*kept, "n", "idx", F.expr(f"substring(body, idx * {size} + 1, {size})").alias("block"))
    return block.select("*", *_address(F.col("block"), bits))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Distinct rows, sorted in each partition and numbered; written, for a name must not change."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, address_bits: int = 64) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row, doc_id, text_sha256, n, name.

    Rows have equal (n, name) exactly if their normalised texts are equal.
    Null counts as empty, the empty text is one empty block; ids may be null or
    repeat, for ``row`` tells rows apart. Other columns are not read.
    ``address_bits`` below 64 makes addresses collide, for tests.
    """
    texts = docs.select("doc_id", normalised("text").alias("text"))
    body = F.col("text").cast("binary").alias("body")

    contents = _blocks(texts.select(body), block_bytes, address_bits).select("low", "high", "block").distinct()
    names = stage(_named(contents, "block").select("low", "high", "name"), "block-names")
    shared = names.groupBy("low", "high").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("low", "high")

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), body)
    cut = _blocks(rows, block_bytes, address_bits, "row", "doc_id", "text_sha256")
    head = [F.when(F.col("idx") == 0, F.col(c)).alias(c) for c in ("doc_id", "text_sha256")]
    narrow = ["row", "n", "idx", *head]
    if shared.isEmpty():
        first = cut.select(*narrow, "low", "high").join(names, ["low", "high"])
    else:
        shared = stage(shared, "shared-addresses")
        contents = _blocks(texts.select(body), block_bytes, address_bits).join(shared, ["low", "high"], "left_semi").select("block").distinct()
        by_content = stage(_named(contents, "block").withColumn("name", -1 - F.col("name")), "content-names")
        marked = cut.join(shared.withColumn("shared", F.lit(True)), ["low", "high"], "left")
        single = marked.where("shared IS NULL").select(*narrow, "low", "high").join(names, ["low", "high"]).drop("low", "high")
        double = marked.where("shared").select(*narrow, "block").join(by_content, "block").drop("block")
        first = single.unionByName(double)
    level = stage(first.select("row", "n", "idx", "name", "doc_id", "text_sha256"), "level-0")

    heads = level.where("idx = 0").select("row", "doc_id", "text_sha256")
    longest = level.agg(F.max("n")).first()[0] or 1
    done, span = [level.where("n = 1").select("row", "n", "name")], 1
    while span < longest:
        pairs = level.where(F.col("n") > span).groupBy("row", "n", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(NO_PARTNER)).alias("b"),
        )
        pair_names = stage(_named(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        level = stage(pairs.join(pair_names, ["a", "b"]).select("row", "n", "idx", "name"), "level")
        span *= 2
        done.append(level.where(F.col("n") <= span).select("row", "n", "name"))
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    return heads.join(named, "row").select("row", "doc_id", "text_sha256", "n", "name")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, address_bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; null ids come last,
    and of repeated rows one stays.
    """
    named = stage(identities(docs, block_bytes, address_bits), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = named.groupBy("n", "name").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["n", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
    )
