"""Secret scan: stated patterns, and random strings by token efficiency.

A random string needs a token for every one or two characters, while words and
names are covered by longer tokens. Runs of key characters with a low ratio of
characters to tokens are reported, after digests and identifiers are set aside.
A run is judged whole and, if it passes, by its pieces, so that words beside a
key don't hide it.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pattern that goes with the public vocabulary, and the stated kinds in their order.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Key characters are judged from this length on, and are random below this many characters per token.
LEAST_RUN, MOST_RATIO = 16, 2.2
#: Identifiers of under this length, where rare words come near MOST_RATIO, are random below this many characters per token.
SHORT_RUN, SHORT_RATIO = 20, 1.6
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
SIGNS = "+/_=-"
PIECE = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: Words, numbers, and words with a short number, joined by the usual signs.
IDENTIFIER = re.compile(r"[-_/+=]*(?:(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[-_/+=]+|$))+")
LETTERS = re.compile(r"[A-Za-z]+")

OUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the stated kinds, in code points; a match that is too short is dropped, not retried."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str, encoding: tiktoken.Encoding, most_ratio: float = MOST_RATIO) -> bool:
    """A digest of a usual length, a UUID, or an identifier whose letters are no random ones: they have ``most_ratio`` characters per token or more.

    Words of one token are left out of that ratio, so that they don't hide what stands beside them. In short identifiers, SHORT_RATIO is enough.
    """
    if (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) is not None) or UUID.fullmatch(run) is not None:
        return True
    if IDENTIFIER.fullmatch(run) is None:
        return False
    words = [(len(w), len(encoding.encode_ordinary(w))) for w in LETTERS.findall(run)]
    enough = most_ratio if len(run) >= SHORT_RUN else min(most_ratio, SHORT_RATIO)
    return sum(n for n, k in words if k > 1) >= enough * sum(k for _, k in words if k > 1)


def is_random(run: str, encoding: tiktoken.Encoding, most_ratio: float = MOST_RATIO) -> bool:
    return len(run) >= LEAST_RUN and len(run) / len(encoding.encode_ordinary(run)) < most_ratio and not known(run, encoding, most_ratio)


def dense(scores: list[float]) -> Iterator[tuple[int, int]]:
    """Stretches of a positive sum, each up to where its sum is greatest; what follows is looked at anew."""
    begin = 0
    while begin < len(scores):
        total = best = 0.0
        end = begin
        for k in range(begin, len(scores)):
            total += scores[k]
            if total <= 0:
                break
            if total > best:
                best, end = total, k + 1
        if end > begin:
            yield begin, end
        begin = max(end, begin + 1)


def random_pieces(run: str, encoding: tiktoken.Encoding, most_ratio: float = MOST_RATIO) -> Iterator[tuple[int, int]]:
    """Where the pieces of a run, alone or several in a row, are random; known strings between its signs are left out."""
    ids = [(m.start(), m.end()) for m in UUID.finditer(run) if not run[m.start() - 1:m.start()].isalnum() and not run[m.end():m.end() + 1].isalnum()]
    for begin, end in zip([0, *(e for _, e in ids)], [*(s for s, _ in ids), len(run)]):
        pieces = [(begin + m.start(), begin + m.end(), m.group()) for m in PIECE.finditer(run[begin:end])]
        scores = []
        for _, _, piece in pieces:
            digest = len(piece) in DIGEST_LENGTHS and DIGEST.fullmatch(piece) is not None
            score = most_ratio * len(encoding.encode_ordinary(piece)) - len(piece)
            # a long number must not make up for the words between it and a key
            scores.append(-float("inf") if digest else min(score, most_ratio) if piece.isdigit() else score)
        for first, last in dense(scores):
            start, stop = pieces[first][0], pieces[last - 1][1]
            inner = run[start:stop].lstrip(SIGNS)
            start, inner = stop - len(inner), inner.rstrip("+/_-")
            if is_random(inner, encoding, most_ratio):
                yield start, start + len(inner)


def random_spans(text: str, encoding: tiktoken.Encoding, base: list[tuple[int, int, int]], most_ratio: float = MOST_RATIO) -> list[tuple[int, int, int]]:
    """Runs of few characters per token, or such pieces of a run; of a run that base spans touch, what lies outside them is judged by its pieces."""
    out, starts = [], [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    for m in RUN.finditer(text):
        before = bisect.bisect_left(starts, m.end())
        if not (before and reach[before - 1] > m.start()):
            run = m.group()
            if is_random(run, encoding, most_ratio):
                out.append((m.start(), 3, m.end()))
            else:
                out += [(m.start() + s, 3, m.start() + e) for s, e in random_pieces(run, encoding, most_ratio)]
            continue
        at = m.start()
        # spans that end before the run have no part in it; the others stand in the order of their starts
        for start, _, end in [*base[bisect.bisect_right(reach, m.start()):before], (m.end(), 0, m.end())]:
            if start - at >= LEAST_RUN:
                out += [(at + s, 3, at + e) for s, e in random_pieces(text[at:start], encoding, most_ratio)]
            at = max(at, end)
    return out


_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding_of(ranks: bytes) -> tiktoken.Encoding:
    key = hash(ranks)
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch], ranks: bytes, most_ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = encoding_of(ranks)
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), listed(base), listed(sorted(base + random_spans(text, encoding, base, most_ratio)))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5))], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])


def scan(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, most_ratio: float = MOST_RATIO) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the stated kinds, their spans and all spans as kind:start:end lists.

    Whole texts are read where they are, nothing is shuffled. Null and empty
    texts give zeros and empty lists; rows are judged one by one, so repeated
    rows and null ids keep their place. Other columns are not read. The
    vocabulary is one file of fixed size, read by the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    own = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return own.mapInArrow(lambda it: _scan(it, ranks.value, most_ratio), OUT)
