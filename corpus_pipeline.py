"""The corpus pipeline: documents through language ID, near-duplicate removal, decontamination, mixing and sharding.

Each stage works on all rows that its predecessor kept. All but the last return
the columns of documents; the last adds shard, slot and moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm import crf, jaccard, mixture, positional, reshard
from waymark.llm.common import stage, table
from waymark.session import tune

OLD_SHARDS, NEW_SHARDS = 12, 16


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: rejected are null texts, those without letters, and those whose words are, on average, in no language surely.

    Text that switches between languages stays, and so does every text with a
    letter where no language could be learned. Repeated rows fare alike; empty
    input gives no rows.
    """
    tune(spark)
    return crf.keep_identified(docs, crf.learn(docs))


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, the one with the smallest id.

    Texts without words, null ones too, all stay; null ids give way to others;
    of repeated rows one stays. Empty input gives no rows.
    """
    tune(spark)
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows.

    Texts without words, null ones too, stay; repeated rows fare alike; empty
    input or an empty benchmark drops nothing.
    """
    return positional.drop_contaminated(docs, table(tune(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null sources are one source; repeated rows and rows of null id draw alike;
    sources without words go. Empty input gives no rows.
    """
    tune(spark)
    return mixture.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sixteen shards of near equal bytes, moved from shards by source.

    Null texts weigh one byte, null sources lie in one shard; every row is
    placed, repeated ones too. Empty input gives no rows.
    """
    tune(spark)
    by_source = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    return reshard.reshard(docs, by_source, OLD_SHARDS, NEW_SHARDS)


STAGES = [
    ("language ID", identify), ("n-gram Jaccard join", join_near), ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix), ("sharding", shard),
]

#: A learned labeller takes part, which SQL can't express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{n}")
    return docs
