import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import test_jaccard, test_mixture, test_positional


@pytest.fixture(scope="module")
def steps(spark, sf, documents):
    out, docs = [], documents
    for _, step in P.STAGES:
        docs = P.stage(step(spark, docs, sf), "test-pipeline")
        out.append(docs)
    return [documents, *out]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps, documents):
    assert [s.columns for s in steps[:-1]] == [documents.columns] * 5 and steps[-1].columns == [*documents.columns, "shard", "slot", "moved"]
    assert 4 <= len(P.STAGES) <= 5


def test_language(steps):
    """All texts with letters stay, for each of these is surely in some language."""
    lettered = {i for i, t in texts_of(steps[0]) if any(c.isalpha() for c in t or "")}
    assert {i for i, _ in texts_of(steps[1])} == lettered


def test_near_duplicates(steps):
    groups = test_jaccard.brute(texts_of(steps[1]))
    assert sorted(i for i, _ in texts_of(steps[2])) == sorted(i for i, _, c in groups if i == c)


def test_contamination(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    judged = test_positional.brute(texts_of(steps[2]), items)
    assert sorted(i for i, _ in texts_of(steps[3])) == sorted(r[0] for r in judged if not r[4])
    assert any(r[4] for r in judged)


def test_mix(steps):
    sizes = {r.source: r.n for r in steps[3].groupBy("source").agg(F.sum(test_mixture.M.n_words("text")).alias("n")).collect()}
    names = sorted(sizes)
    target = dict(zip(names, test_mixture.filled([sizes[s] for s in names])))
    taken = {(r.doc_id): r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    for r in steps[3].collect():
        rate = target[r.source] / sizes[r.source]
        assert taken.get(r.doc_id, 0) in (int(rate), int(rate) + 1)


def test_shards(steps):
    last = steps[5]
    assert sorted(texts_of(last)) == sorted(texts_of(steps[4]))
    by = last.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert len(by) == 16 and all(r.n == r.s == r.m + 1 for r in by)


def test_odd_documents(spark, sf, odd):
    docs = odd
    for _, step in P.STAGES:
        docs = P.stage(step(spark, docs, sf), "test-odd")
    assert "shard" in docs.columns
