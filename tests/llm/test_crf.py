import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import crf as C


def brute_marginals(scores, steps):
    """Probabilities by summing over all label sequences."""
    length, labels = scores.shape
    out = np.zeros(scores.shape)
    for path in itertools.product(range(labels), repeat=length):
        value = np.exp(sum(scores[t, k] for t, k in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
        for t, k in enumerate(path):
            out[t, k] += value
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1, 5])
    scores, steps = rng.normal(size=(14, 3)).astype(np.float32), rng.normal(size=(3, 3))
    got, begin = C.marginals(scores, lengths, steps), np.cumsum(lengths) - lengths
    for b, n in zip(begin, lengths):
        if n:
            assert got[b:b + n] == pytest.approx(brute_marginals(scores[b:b + n], steps), abs=1e-5)


def test_gradients_by_difference():
    rng = np.random.default_rng(2)
    scores, steps = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gold = np.array([[0, 2, 2, 1]])

    def likelihood(scores, steps):
        def value(path):
            return sum(scores[0, t, k] for t, k in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))
        return value(gold[0]) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=4)))

    by_score, by_step = C._gradients(scores, steps, np.eye(3)[gold])
    tiny = 1e-5
    for k in range(3):
        moved = scores.copy()
        moved[0, 1, k] += tiny
        assert by_score[0, 1, k] == pytest.approx((likelihood(moved, steps) - likelihood(scores, steps)) / tiny, abs=1e-3)
        moved = steps.copy()
        moved[2, k] += tiny
        assert by_step[2, k] == pytest.approx((likelihood(scores, moved) - likelihood(scores, steps)) / tiny, abs=1e-3)


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def field(larger):
    return C.learn(larger, rows=80)


def test_held_out_accuracy(larger, field):
    got = C.predict(larger, field).join(larger.select("doc_id", "lang"), "doc_id").where(C.held_out())
    n, right = got.agg(F.count(F.lit(1)), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 250 and right > 0.98


def test_held_out_rows_take_no_part(larger, field):
    changed = larger.withColumn("lang", F.when(C.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(C.held_out(), F.lit("x")).otherwise(F.col("text")))
    again = C.learn(changed, rows=80)
    assert again.labels == field.labels and np.array_equal(again.weights, field.weights)


def test_words_of_switching_text(spark, larger, field):
    texts = {r.lang: " ".join(C.WORD.findall(r.text)[:60]) for r in larger.where("length(text) > 1500").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    joined = " ".join([texts["en"], texts["de"], texts["fr"]])
    row = C.label_words(spark.createDataFrame([(1, joined)], "doc_id bigint, text string"), field).first()
    want = ["en"] * len(texts["en"].split()) + ["de"] * len(texts["de"].split()) + ["fr"] * len(texts["fr"].split())
    assert len(row.words) == len(want) and np.mean([a == b for a, b in zip(row.langs, want)]) > 0.9


def test_odd_rows(odd, none, field):
    got = C.predict(odd, field).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {3, 4, 5, 10} and {r.lang_pred for r in got if r.doc_id in (6, 8, 11)} <= set(field.labels)
    kept = C.keep_identified(odd, field)
    assert kept.columns == odd.columns and {3, 4, 5, 10}.isdisjoint(r.doc_id for r in kept.collect())
    assert C.predict(none, field).count() == 0 and C.keep_identified(none, field).count() == 0
    empty = C.learn(none)
    assert empty.labels == [] and {(r.lang_pred, r.score) for r in C.predict(odd, empty).collect()} == {("und", 0.0)}
    assert C.learn(odd).labels
    words = {r.doc_id: (r.words, r.langs, r.chances) for r in C.label_words(odd, empty).collect()}
    assert words[8] == (["two", "words"], ["und", "und"], [0.0, 0.0]) and words[3] == words[4] == words[10] == ([], [], [])
    assert C.label_words(none, field).count() == 0


def test_clean_texts_are_kept(spark, larger, field):
    """Text that switches evenly between all languages, and any text where no language could be learned."""
    by_lang = [C.WORD.findall(r.text) for r in larger.where("length(text) > 1500").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()]
    assert len(by_lang) == 4
    mixed = [(i, " ".join(" ".join(words[i * 20:i * 20 + 25]) for words in by_lang)) for i in range(8)]
    junk = [(100, "12 34 -- !!"), (101, ""), (102, None), (103, "½ ① ②")]
    docs = spark.createDataFrame(mixed + junk, "doc_id bigint, text string")
    assert max(r.score for r in C.predict(docs.where("doc_id < 100"), field).collect()) < 0.5
    unlearned = C.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    for own in (field, unlearned):
        assert sorted(r.doc_id for r in C.keep_identified(docs, own).collect()) == list(range(8))


def test_numbers_that_count_as_words_are_no_letters(spark, field):
    docs = spark.createDataFrame([(1, "½ ² ³ ¼ ¾ Ⅷ Ⅸ ① ② ③ ④"), (2, "½ ² ³ ¼ ¾ Ⅷ Ⅸ ① ② ③ the")], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in C.predict(docs, field).orderBy("doc_id").collect()] == [True, False]


def test_few_kept_words_change_nothing(monkeypatch, field):
    texts = [f"The word number{i} and ünder der Wörter la maison {'abcdefgh' * (i % 9)}" for i in range(50)]
    whole = C.Labeller(field).label(texts)[2]
    monkeypatch.setattr(C, "TABLE_WORDS", 3)
    own = C.Labeller(field)
    parts = np.concatenate([own.label([t])[2] for t in texts])
    assert whole == pytest.approx(parts, abs=1e-5)


def test_every_letter_of_a_long_run_is_read(field):
    head, tail = "straßeund" * 3, "derwörter" * 3
    runs = [f"{head}{middle}{tail}" for middle in ("thewhichthough" * 9, "maisonquelleoù" * 9)]
    lengths, _, chance = C.Labeller(field).label(runs)
    assert list(lengths) == [-(-len(run) // 30) for run in runs] and max(lengths) > 1
    words = [C.WORD.findall(run) for run in runs]
    assert ["".join(w) for w in words] == runs and all(len(w) <= C.LONGEST for ws in words for w in ws)
    # the two differ in their middles alone, and so do their languages
    first, second = chance[:lengths[0]].mean(axis=0), chance[lengths[0]:].mean(axis=0)
    assert abs(first - second).max() > 0.1
