import random
import re
from collections import Counter, defaultdict

import pytest

from waymark.llm import collocation as C


def brute(rows, least, top=2000):
    """Every phrase counted, every cut scored, every containment looked up."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts[lang].update(tuple(words[i:i + m]) for i in range(len(words)) for m in range(1, 6) if i + m <= len(words))
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in able.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        found = []
        for p, a in able.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def pairs(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


@pytest.fixture
def many_ranges(spark):
    """Ranges of few rows, so that phrases and their beginnings lie in different ones."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_against_brute_force(documents):
    rows = pairs(documents)
    want = brute(rows, 8)
    assert len(want) > 200 and result(C.collocations(documents, least=8)) == want
    cut = brute(rows, 8, top=7)
    assert result(C.collocations(documents, least=8, top=7)) == cut


def test_phrases_over_many_ranges(spark, many_ranges):
    rng, rows = random.Random(3), []
    for d in range(300):
        words = [rng.choice(["a", "b", "c", "A", "the", "the", "the", "of"]) for _ in range(40)]
        for _ in range(6):
            words.insert(rng.randrange(40), rng.choice(["one two three four five six", "the hot pair", "x. y", "p,q", "\t", "r\vs", "is\x01low"]))
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(words)))
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 20)
    assert {len(r[2].split(" ")) for r in want} == {2, 3, 4, 5}
    assert result(C.collocations(docs, least=20)) == want


def test_windows_cut_in_one_step_or_two(spark, documents, monkeypatch):
    """Ranges of few windows, cut from the segments at once or by way of wide ones; of many segments, with and without bounds."""
    monkeypatch.setattr(C, "SEGMENT_WORDS", 2000)
    f = Counter()
    for lang, text in pairs(documents):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang, *words[i:i + m]) for i in range(len(words)) for m in range(1, 6) if i + m <= len(words))
    want = Counter(len(p) - 1 for p, a in f.items() if a >= 8)
    seen = []
    bounds_of = C._range_bounds
    monkeypatch.setattr(C, "_range_bounds", lambda *a: seen.append(bounds_of(*a)) or seen[-1])
    first = None
    for range_windows, cuts in [(1 << 20, 8), (500, 4096), (500, 6)]:
        phrases, words, _ = C.frequent_phrases(documents.select("lang", "text"), 8, range_windows, cuts)
        found = sorted(tuple(r) for r in phrases.select(*C.KEY, "count").collect())
        first = found if first is None else first
        assert found == first and len({r[:3] for r in found}) == len(found)
        assert Counter(1 + (a % C._HALF > 0) + (b > 0) + (b % C._HALF > 0) + (c > 0) for a, b, c, _ in found) == want
    assert seen[0].shape == (3, 0) and seen[1].shape[1] > 20


def test_blocks_keep_windows(spark):
    rng = random.Random(7)
    import numpy as np
    import pyarrow as pa

    top = C._HALF - 1
    rows = sorted((rng.choice([1, 5, top]) * C._HALF + rng.choice([0, 3, top]), rng.choice([0, 2 * C._HALF, top * C._HALF + top]), rng.choice([0, top]), rng.randrange(1, 9)) for _ in range(400))
    whole = C._distinct(*np.array(rows, np.int64).T)
    keys = list(zip(*(c.tolist() for c in whole[:3])))
    bounds = np.array(sorted(rng.sample(keys, 5)) + [(top * C._HALF + top, 1 << 62, 1)], np.int64)
    bounds = np.array(sorted(map(tuple, bounds.tolist())), np.int64).T
    blocks = C._blocks(whole, bounds, 10, 3)
    assert [c.tolist() for c in C._read(pa.Table.from_batches([blocks, blocks]))] == [*[c.tolist() for c in whole[:3]], (2 * whole[3]).tolist()]
    for i, row in enumerate(blocks.to_pylist()):
        own = C._read(pa.Table.from_batches([blocks.slice(i, 1)]))
        limits = [tuple(b) for b in bounds.T.tolist()]
        assert {10 + sum(b <= k for b in limits) for k in zip(*(c.tolist() for c in own[:3]))} == {row["range"]}


def test_phrases_inside_longer_ones_go(spark):
    docs = spark.createDataFrame([("en", "new york city hall\n" * 10 + "new york\n" * 5 + "tied a, tied b")], "lang string, text string")
    phrases = [r.phrase for r in C.collocations(docs, least=10).collect()]
    assert sorted(phrases) == ["new york", "new york city hall"]


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    text = b"alpha beta gamma\ndelta alpha beta\n" * 500
    assert b"\n".join(C._stretches(text, 100)) == text and max(map(len, C._stretches(text, 100))) <= 100
    whole = b"no break " * 100
    assert list(C._stretches(whole, 50)) == [whole]
    late = b"x" * 90 + b"\n" + b"y" * 90
    assert list(C._stretches(late, 50)) == [b"x" * 90, b"y" * 90]


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    phrases = spark.createDataFrame([(C._HALF, 0, 0, big), (2 * C._HALF, 0, 0, big + 1), (C._HALF + 2, 0, 0, big - 1)], "w12 bigint, w34 bigint, w5 bigint, count bigint")
    words = spark.createDataFrame([("en", b"a", 1), ("en", b"b", 2)], "lang string, word binary, id bigint")
    spoken = spark.createDataFrame([("en", 5 * big)], "lang string, n bigint")
    row = C.scored(phrases, words, spoken).collect()[0]
    assert (row.a, row.l, row.r, row.score) == (big - 1, big, big + 1, 1000 * (big - 1) * 5 * big // (big * (big + 1)))


def test_odd_rows(odd, none):
    want = brute(pairs(odd), 2)
    assert want and result(C.collocations(odd, least=2)) == want
    assert C.collocations(none).count() == 0
