import hashlib
import re

from waymark.llm import naming as N


def brute(rows):
    groups = {}
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (doc_id, _), b in zip(rows, body):
        groups.setdefault(b, []).append(doc_id)
    out = []
    for (doc_id, _), b in zip(rows, body):
        ids = [i for i in groups[b] if i is not None]
        out.append((doc_id, min(ids) if ids else None, len(groups[b]), hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_blocks_of_any_size_and_colliding_addresses(documents, texts):
    want = brute(list(texts.items()))
    assert any(r[2] > 1 for r in want)
    for size, bits in ((1024, 64), (64, 64), (256, 6), (64, 3)):
        got = N.exact_groups(documents, size, bits)
        assert result(got) == want


def test_odd_rows(odd, none):
    got = N.exact_groups(odd, 128)
    assert result(got) == brute([(r.doc_id, r.text) for r in odd.collect()])
    kept = got.where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({r.text_sha256 for r in got.collect()})
    assert N.exact_groups(none).count() == 0


def test_texts_that_differ_at_one_place(spark):
    base = "abcdefgh" * 40
    rows = [(i, base[:i] + "#" + base[i + 1:]) for i in range(0, 320, 7)] + [(1000, base), (1001, base + "a"), (1002, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(N.exact_groups(docs, 16)) == brute(rows)
