import re

import numpy as np

from waymark.llm import positional as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=13, share=20):
    out = []
    cuts = [(i, words(t)) for i, t in items]
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item, ws in cuts:
            n = min(window, len(ws))
            for k in range(len(ws) - n + 1 if n else 0):
                for s in range(len(own) - n + 1):
                    if own[s] == ws[k] and own[s:s + n] == ws[k:k + n]:
                        hit.update(range(s, s + n))
                        names.add("" if item is None else str(item))
        out.append((doc_id, len(own), len(hit), tuple(sorted(names)), len(hit) > 0 and share * len(hit) >= len(own)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in df.collect()), key=str)


def test_against_brute_force(spark, sf, documents, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert any(r[4] for r in want)
    assert result(P.contamination(documents, items)) == want
    # small segments and many blocks of items give the same
    assert result(P.contamination(documents, items, segment_bytes=5000, block_bytes=700)) == want


def test_odd_rows(spark, odd, none):
    items = [(1, "Second line here"), (1, "TWO words"), (None, "gamma delta"), (3, None), (4, "w0x0 w1x1 w2x2"), (5, "...")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    small = odd.where("length(text) < 1000 OR text IS NULL")
    assert result(P.contamination(small, table)) == brute([(r.doc_id, r.text) for r in small.collect()], items)
    got = {r.doc_id: r for r in P.contamination(odd, table).collect()}
    assert got[6].n_hit == 3 and not got[6].contaminated
    assert P.contamination(none, table).count() == 0
    assert P.contamination(odd, table.limit(0)).where("contaminated").count() == 0
    kept = P.drop_contaminated(odd, table)
    assert kept.columns == odd.columns and kept.count() == 14 - 6
    assert P.drop_contaminated(none, table).columns == none.columns


def test_equal_terms_across_documents_make_no_phrase(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "two three")], "item_id bigint, text string")
    assert P.find_items(P.build_index(docs), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b x y c"), (3, "a x y z b c"), (4, "c b a"), (5, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id bigint, text string")
    index = P.build_index(docs)

    def found(slop):
        hits = P.find_items(index, items, None, slop).join(P.indexed_documents(index), ["segment", "doc_no"])
        return sorted((r.doc_id, r.begin, r.end) for r in hits.collect())

    assert found(0) == [(5, 0, 3)]
    assert found(1) == [(1, 0, 4), (5, 0, 3)]
    assert found(2) == [(1, 0, 4), (2, 0, 5), (5, 0, 3)]


def test_long_buffers_are_cut_between_words(monkeypatch):
    from waymark.llm import common
    data = [b" ".join(b"word%d" % i for i in range(5000)), b"x" * 9000 + b" y"]
    whole = common.joined_words(data, P.WORDS)
    monkeypatch.setattr(common, "_CHUNK", 1000)
    parts = common.joined_words(data, P.WORDS)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
