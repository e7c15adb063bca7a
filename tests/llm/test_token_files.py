import random
import zlib

import numpy as np
import pytest

from waymark.llm import simple8b as S
from waymark.llm import token_files as T
from waymark.llm.files import opened
from waymark.llm.tokens import bpe


@pytest.fixture(scope="module")
def tokenizer():
    with open(T.VOCABULARY, "rb") as f:
        return bpe(f.read())


def brute(rows, tokenizer):
    """Texts encoded whole, one by one, in ascending order of id."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for widths in ([0], [1], [3, 12], [16], [1, 60], [59, 60, 61, 64], [0, 0, 0, 20]):
        for _ in range(20):
            lengths = rng.integers(0, 1500, rng.integers(0, 6))
            n = int(lengths.sum())
            bits = rng.choice(widths, n) if n else np.empty(0, int)
            values = np.array([random.getrandbits(int(b)) if b else 0 for b in bits], np.uint64)
            values[:n // 3] = 0
            words, size, escapes = S.encode(values, lengths)
            first, last = S.block_bounds(lengths)
            assert len(words) == size.sum() and np.array_equal(S.decode(words, size, escapes, last - first), values)
            # any run of blocks decodes alone
            if len(size) > 2:
                upto = np.concatenate(([0], np.cumsum(size)))
                alone = S.decode(words[upto[1]:upto[-2]], size[1:-1], escapes[1:-1], (last - first)[1:-1])
                assert np.array_equal(alone, values[first[1]:last[-2]])


def test_small_ids_are_packed_densely():
    words, _, _ = S.encode(np.ones(5120, np.uint64), np.array([5120]))
    assert len(words) <= 10 * 9
    words, _, escapes = S.encode(np.array([2**64 - 1, 5], np.uint64), np.array([2]))
    assert escapes.tolist() == [1] and int(words[-1]) == 2**64 - 1


def test_against_whole_texts(documents, texts, tokenizer):
    assert result(T.read_tokens(T.write_tokens(documents))) == brute(texts.items(), tokenizer)


def test_many_files_and_ids(spark, documents, texts, tokenizer, tmp_path):
    manifest = T.write_tokens(documents, folder=str(tmp_path / "own"), file_bytes=5_000)
    files = [r.file for r in manifest.collect()]
    assert len(files) > 20 and all(f.startswith("file:/") for f in files)
    rows = T.read_tokens(manifest, ids=True)
    assert result(rows) == brute(texts.items(), tokenizer)
    one = rows.where("doc_id = 7").collect()[0]
    assert one.ids == [*tokenizer.encode(texts[7], add_special_tokens=False).ids, 1]


def test_chunks_encode_like_the_whole(texts, tokenizer):
    with open(T.VOCABULARY, "rb") as f:
        encoder = T.Encoder(f.read(), None)
    tricky = ["it's A  b\n\nc", "x\u00a0y\u2003z \u0301a e\u0301", "<|endoftext|> a<|endoftext|>b", "ΑΣ ΑΣΑ", "a\tb\rc \n d", "12 3.4 !!?", "", " ", "End. Of, it's. a.. b., c?! D.", "<|STARTOFTEXT|> A. <|startoftext|>", "É. A\u0300. K\u212a. İ.", "a ★ b ★★c", "☆★"]
    assert encoder.mark is not None
    for text in [*texts.values(), "\n".join(texts.values()), *tricky]:
        ids, lengths = encoder.encode([text.encode()])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and lengths.tolist() == [len(ids)]


def test_known_chunks_are_bounded(texts, tokenizer):
    with open(T.VOCABULARY, "rb") as f:
        encoder = T.Encoder(f.read(), 1, most=10)
    for text in texts.values():
        assert encoder.encode([text.encode()])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_one_id_fills_several_buckets(spark, texts, tokenizer):
    docs = spark.createDataFrame([(5 if i % 3 else i, t) for i, t in texts.items()] + [(None, t) for t in texts.values()], "doc_id bigint, text string")
    manifest = T.write_tokens(docs, buckets=20)
    files = manifest.collect()
    assert max(r.documents for r in files) < 60 and len({r.bucket for r in files}) > 12
    got = result(T.read_tokens(manifest))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert [r[0] for r in got] == [r[0] for r in want] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)


def test_damaged_file(spark, documents, tmp_path):
    manifest = T.write_tokens(documents.limit(5), folder=str(tmp_path))
    path = manifest.collect()[0].file
    store, at = opened(path)
    with store.open_input_stream(at) as f:
        data = f.read()
    with store.open_output_stream(at) as f:
        f.write(b"x" + data[1:])
    with pytest.raises(Exception, match="not a whole file"):
        T.read_tokens(manifest).collect()


def test_paths_are_qualified():
    with pytest.raises(ValueError, match="no scheme"):
        opened("/tmp/x")
    assert opened("file:/tmp/x")[1] == "/tmp/x" and opened("file:///tmp/x")[1] == "/tmp/x"
    assert opened("s3a://bucket/key?region=us-east-1")[0].type_name == "s3"


def test_odd_rows(odd, none, tokenizer):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = result(T.read_tokens(T.write_tokens(odd)))
    want = brute(rows, tokenizer)
    # rows of one id have no stated order
    assert sorted((r[0] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert T.read_tokens(T.write_tokens(none)).count() == 0
    no_end = T.read_tokens(T.write_tokens(odd.where("doc_id in (3, 4)"), end_id=None)).collect()
    assert [r.n_tokens for r in no_end] == [0, 0]
