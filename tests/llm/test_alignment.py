import hashlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import alignment as A
from waymark.llm.tokens import bpe, chunks, sentence_pieces


@pytest.fixture(scope="module")
def both():
    contents = [open(p, "rb").read() for p in (A.LEFT, A.RIGHT)]
    return bpe(contents[0], plain_specials=True), sentence_pieces(contents[1]), A.left_bytes(contents[0]), A.right_bytes(contents[1])


def tokens_of(text, both):
    """Ids of the whole text by both, and the groups between common ends, by two running offsets."""
    left, right, a_bytes, b_bytes = both
    if not text:
        return [], [], []
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    if b"".join(a_bytes[i] for i in a) != (" " + text).encode() or b"".join(b_bytes[i] for i in b) != (" " + text).encode():
        return [], [], []
    groups, i, j = [], 0, 0
    while i < len(a):
        own_a, own_b, x, y = [a[i]], [b[j]], len(a_bytes[a[i]]), len(b_bytes[b[j]])
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                own_a.append(a[i])
                x, i = x + len(a_bytes[a[i]]), i + 1
            else:
                own_b.append(b[j])
                y, j = y + len(b_bytes[b[j]]), j + 1
        groups.append((own_a, own_b))
    return a, b, groups


def brute(rows, both):
    found = [(doc_id, *tokens_of(text, both)) for doc_id, text in rows]
    total = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), digest))
    return sorted(out, key=str), {(a, b, n, n == most[b]) for (a, b), n in total.items()}


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_running_offsets(documents, texts, both):
    want, pairs = brute(texts.items(), both)
    rows, found = A.align(documents)
    assert result(rows) == want and {tuple(r) for r in found.collect()} == pairs


def test_odd_texts(spark, both):
    texts = ["a", " a", "  a  b", "\n", "▁", "a▁b", "<|endoftext|> x <s> <0x41>", "naïve ☃ 😀😀 한국어", "\x00\x01", "1 2 3 " * 900, "word " * 30_000, "it's  it 's", " ", "\u00a0x", "e\u0301", "\ufffd \ufffd"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, None), (51, "")], "doc_id bigint, text string")
    rows, _ = A.align(docs)
    want, _ = brute([(i, t) for i, t in enumerate(texts)] + [(50, None), (51, "")], both)
    assert result(rows) == want
    zeros = {r[0] for r in want if r[1] == 0}
    assert {4, 5, 50, 51} <= zeros and len(zeros) < 8


def test_chunks_encode_like_the_whole(texts, both):
    left, right, *_ = both
    text = "\n".join(texts.values()) + " é à la  x\n y 's 12 ☃ a\u0301 b"
    parts = chunks(text, 1000)
    assert len(parts) > 10_000 and " ".join(parts) == text == " ".join(chunks(text))
    assert [i for p in parts for i in left.encode(" " + p, add_special_tokens=False).ids] == left.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in right.encode(p)] == right.encode(text)
    # what the cut rests on: a blank only begins a piece of words
    assert not any("▁" in p.lstrip("▁") for p in map(right.id_to_piece, range(right.get_piece_size())))


def test_pointers_reach_the_last_token():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 300))
        a_ends, b_ends = (np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for p in (0.3, 0.2))
        a_label, b_label = A.labels(a_ends, b_ends)
        common = np.intersect1d(a_ends, b_ends)
        assert np.array_equal(b_ends[a_label], common[np.searchsorted(common, a_ends)]) and np.array_equal(b_ends[b_label], common[np.searchsorted(common, b_ends)])


def test_odd_rows(odd, none, both):
    rows, pairs = A.align(odd)
    want, _ = brute([(r.doc_id, r.text) for r in odd.collect()], both)
    assert result(rows) == want
    rows, pairs = A.align(none)
    assert rows.count() == 0 and pairs.count() == 0
