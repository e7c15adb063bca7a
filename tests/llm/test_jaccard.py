import random
import re
from collections import Counter

from pyspark.sql import functions as F

from waymark.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    """(id, text) rows to sorted (id, size, component)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                root[find(j)] = find(i)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), names.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force(documents, texts):
    want = brute(list(texts.items()))
    assert any(d != c for d, _, c in want)
    assert result(J.similar_groups(documents)) == want
    assert result(J.similar_groups(documents, fragment_shingles=500)) == want


def test_chains_and_groups(spark):
    """Groups linked only through members, near copies of one base, and a passage in all of them."""
    rng, rows = random.Random(3), []
    passage = " ".join(f"p{i}" for i in range(40))
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(120)]
        for c in range(40):
            rows.append(" ".join(words) + " " + passage)
            if g % 2:
                words[rng.randrange(120)] = f"g{g}c{c}"       # each copy drifts from the last: links form chains
            else:
                words = [f"g{g}w{i}" for i in range(120)]
                for _ in range(rng.randrange(6)):
                    words[rng.randrange(120)] = f"r{rng.random()}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    want = brute(list(enumerate(rows)))
    assert len({c for _, _, c in want}) < len(rows) / 4
    assert result(J.similar_groups(docs)) == want


def test_odd_rows(odd, none):
    assert result(J.similar_groups(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    # 2 repeats 1, the null id repeats 1, 7 is near 6, 9 equals 8; texts without words stay
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 3, 4, 5, 6, 8, 10, 11], key=str)
    assert J.similar_groups(none).count() == 0 and J.keep_one(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 9)] + [(7, 7)]
    edges = spark.createDataFrame(path, "a bigint, b bigint").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    sizes = sorted(r["count"] for r in J.components(edges).groupBy("comp").count().collect())
    assert sizes == [9, 61]
