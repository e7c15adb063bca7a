"""Language ID with a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between
the languages of neighbouring words are learned with them. Forward-backward
gives every word's probability of each language, in text that may switch
between languages. A document's language is that of most of its words.

The field is fitted on a bounded sample of labelled rows on the driver and
broadcast; prediction runs over whole texts where they are, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.common import mix, text_batches

#: The sample: this many rows of a language, and this many characters of each, from a place set by its digest.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 3000
#: Training chains, their words, and the chance that the language switches after a word.
CHAINS, CHAIN_WORDS, BATCH, SWITCH = 16000, 24, 64, 1 / 30
BUCKETS, RATE, DECAY = 1 << 16, 0.1, 1e-6
#: Words kept with their features in a Python worker, and the most letters of a word; longer runs of letters are several words in a row.
TABLE_WORDS, LONGEST = 300_000, 30
LEXICON_COUNT = 2
BATCH_BYTES = 4 << 20
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: the digest of the id as text leaves 1 by 3. A null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


# ---- features ---------------------------------------------------------------

def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)


def feature_buckets(words: list[str]) -> np.ndarray:
    """Buckets of each word's features, -1 where a word has no more: the word, prefixes and suffixes of 1 to 4, n-grams of 2 to 4 with its ends."""
    short = [w if len(w) <= LONGEST else w[:LONGEST // 2] + w[-LONGEST // 2:] for w in words]
    width = LONGEST + 2
    inner, tail = _matrix([f"^{w}$" for w in short], width), _matrix([w[::-1] for w in short], 4)
    lengths = np.fromiter(map(len, short), np.int64, len(short))
    width = int(lengths.max()) + 2
    out = []

    def put(value: np.ndarray, kind: int, present: np.ndarray) -> None:
        hashed = (mix(value + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(BUCKETS)).astype(np.int32)
        out.append(np.where(present, hashed, -1))

    prime = np.uint64(0x100000001B3)
    rolling = np.zeros(len(words), np.uint64)
    for k in range(1, width - 1):
        rolling = np.where(k <= lengths, rolling * prime + inner[:, k], rolling)
        if k <= 4:
            put(rolling, k, lengths >= k)
    put(rolling, 0, lengths > 0)
    rolling = np.zeros(len(words), np.uint64)
    for k in range(4):
        rolling = rolling * prime + tail[:, k]
        put(rolling, 10 + k, lengths > k)
    for n in (2, 3, 4):
        for begin in range(width - n + 1):
            value = inner[:, begin]
            for k in range(1, n):
                value = value * prime + inner[:, begin + k]
            put(value, 20 + n, lengths + 2 >= begin + n)
    return np.stack(out, axis=1)


@dataclass
class Field:
    """The fitted field: weights per bucket, per lexicon and between languages."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def lexicon_rows(self, words: list[str]) -> np.ndarray:
        masks = [self.lexicon.get(w, 0) for w in words]
        return np.array([[m >> k & 1 for k in range(len(self.labels))] for m in masks], np.float32).reshape(len(words), len(self.labels))

    def scores(self, words: list[str]) -> np.ndarray:
        """Each word's score per language, without its neighbours."""
        padded = np.vstack([self.weights, np.zeros((1, len(self.labels)), np.float32)])
        out = np.empty((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 4096):
            some = words[i:i + 4096]
            out[i:i + 4096] = padded[feature_buckets(some)].sum(axis=1) + self.lexicon_rows(some) @ self.lexicon_weights
        return out


# ---- forward-backward ---------------------------------------------------------

def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of each language at each word of chains that lie one after the other.

    Chains run side by side, longest first, so that step t is one slice.
    """
    lengths = lengths.astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    steps = int(lengths.max()) if len(lengths) else 0
    running = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(steps), "right")
    cut = np.concatenate(([0], np.cumsum(running)))
    place = np.concatenate([begin[:k] + t for t, k in enumerate(running)]) if steps else np.empty(0, np.int64)
    near = np.exp(transitions - transitions.max()).astype(np.float32)
    own = scores[place]
    own = np.exp(own - own.max(axis=1, keepdims=True))
    forward, backward = own.copy(), np.ones_like(own)
    for t in range(steps):
        now = forward[cut[t]:cut[t + 1]]
        if t:
            now *= forward[cut[t - 1]:cut[t - 1] + len(now)] @ near
        now /= now.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        ahead = slice(cut[t + 1], cut[t + 2])
        now = (own[ahead] * backward[ahead]) @ near.T
        now /= now.sum(axis=1, keepdims=True)
        backward[cut[t]:cut[t] + len(now)] = now
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    out = np.empty_like(both)
    out[place] = both
    return out


# ---- learning -------------------------------------------------------------------

def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text) of at most ``rows`` learnable rows per language, by digest of the id."""
    able = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = able.select("doc_id", "lang", rank.alias("rank")).where(F.col("rank") <= rows).select("doc_id", "lang").distinct()
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    texts = able.join(chosen, ["doc_id", "lang"], "left_semi").select("doc_id", "lang", F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(chars)).alias("text"))
    return [(r["lang"], r["text"]) for r in texts.dropDuplicates(["doc_id", "lang"]).orderBy("lang", "doc_id").collect()]


def fit(labelled: list[tuple[str, str]], chains: int = CHAINS, seed: int = 7) -> Field:
    """The field from (language, text) rows. Half of them give the lexicon, the others the chains, spliced from their words so that languages switch."""
    labels = sorted({lang for lang, _ in labelled})
    number = {lang: k for k, lang in enumerate(labels)}
    counts, runs = [Counter() for _ in labels], [[] for _ in labels]
    seen = [0] * len(labels)
    for lang, text in labelled:
        k, words = number[lang], WORD.findall(text.lower())
        seen[k] += 1
        if seen[k] % 2 == 0:
            counts[k].update(words)
        elif words:
            runs[k].append(words)
    lexicon: dict[str, int] = {}
    for k, c in enumerate(counts):
        for w, n in c.items():
            if n >= LEXICON_COUNT:
                lexicon[w] = lexicon.get(w, 0) | 1 << k
    field = Field(labels, np.zeros((BUCKETS, len(labels)), np.float32), lexicon, np.zeros((len(labels), len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    usable = [k for k in range(len(labels)) if runs[k]]
    if not usable:
        return field

    rng = np.random.default_rng(seed)
    words = sorted({w for r in runs for ws in r for w in ws})
    at = {w: i for i, w in enumerate(words)}
    coded = [[np.array([at[w] for w in ws]) for ws in r] for r in runs]
    features = np.concatenate([_padded(feature_buckets(words[i:i + 8192])) for i in range(0, len(words), 8192)])
    listed = field.lexicon_rows(words)
    weights = np.zeros((BUCKETS + 1, len(labels)))
    squares, lex_squares, step_squares = np.full(weights.shape, 1e-2), np.full(field.lexicon_weights.shape, 1e-2), np.full(field.transitions.shape, 1e-2)
    lex, steps = field.lexicon_weights.astype(float), field.transitions
    for _ in range(max(1, chains // BATCH)):
        ids, gold = np.empty((BATCH, CHAIN_WORDS), np.int64), np.empty((BATCH, CHAIN_WORDS), np.int64)
        for b in range(BATCH):
            t = 0
            while t < CHAIN_WORDS:
                k = usable[rng.integers(len(usable))]
                run = coded[k][rng.integers(len(coded[k]))]
                n = min(CHAIN_WORDS - t, int(rng.geometric(SWITCH)), len(run))
                begin = rng.integers(len(run) - n + 1)
                ids[b, t:t + n], gold[b, t:t + n] = run[begin:begin + n], k
                t += n
        flat = ids.ravel()
        used = features[flat]
        scores = (weights[used].sum(axis=1) + listed[flat] @ lex).astype(np.float32).reshape(BATCH, CHAIN_WORDS, -1)
        wanted = np.eye(len(labels))[gold]
        error, step_error = _gradients(scores, steps, wanted)
        error = error.reshape(len(flat), -1)
        gradient = np.stack([np.bincount(used.ravel(), np.repeat(error[:, k], used.shape[1]), BUCKETS + 1) for k in range(len(labels))], axis=1) / BATCH
        gradient[BUCKETS] = 0
        for value, g, s in ((weights, gradient - DECAY * weights, squares), (lex, listed[flat].T @ error / BATCH, lex_squares), (steps, step_error / BATCH, step_squares)):
            s += g * g
            value += RATE * g / np.sqrt(s)
    field.weights, field.lexicon_weights, field.transitions = weights[:BUCKETS].astype(np.float32), lex.astype(np.float32), steps
    return field


def _padded(buckets: np.ndarray) -> np.ndarray:
    """All words with as many features as the longest can have; the last bucket has no weight."""
    full = 9 + sum(LONGEST + 2 - n + 1 for n in (2, 3, 4))
    out = np.full((len(buckets), full), BUCKETS, np.int32)
    out[:, :buckets.shape[1]] = np.where(buckets < 0, BUCKETS, buckets)
    return out


def _gradients(scores: np.ndarray, steps: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood by scores and by transitions, for chains of one length."""
    chains, length, _ = scores.shape
    near = np.exp(steps - steps.max())
    own = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(float)
    forward, backward = own.copy(), np.ones_like(own)
    for t in range(length):
        if t:
            forward[:, t] *= forward[:, t - 1] @ near
        forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        backward[:, t] = (own[:, t + 1] * backward[:, t + 1]) @ near.T
        backward[:, t] /= backward[:, t].sum(axis=1, keepdims=True)
    single = forward * backward
    single /= single.sum(axis=2, keepdims=True)
    pair = forward[:, :-1, :, None] * near * (own[:, 1:] * backward[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return wanted - single, np.einsum("btk,btl->kl", wanted[:, :-1], wanted[:, 1:]) - pair.sum(axis=(0, 1))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Field:
    """A field from ``docs`` (doc_id, text, lang); held-out rows, nulls and other columns take no part."""
    return fit(sample(docs, rows, chars))


# ---- prediction -------------------------------------------------------------------

class _Words(dict):
    """Numbers of words; a new word takes the next."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Labeller:
    """Labels the words of texts; scores of words seen before are kept, up to a bound."""

    def __init__(self, field: Field) -> None:
        self.field, self.words = field, _Words()
        self.known = np.empty((0, len(field.labels)), np.float32)
        self.filled = 0

    def label(self, texts: Iterable[str], kept: list[list[str]] | None = None) -> tuple[np.ndarray, list[bool], np.ndarray]:
        """How many words each text has, whether any has a letter, and the words' probabilities in a row. ``kept`` gets the words."""
        if len(self.words) > TABLE_WORDS:
            self.words, self.filled = _Words(), 0
        ids, lettered = [np.empty(0, np.int32)], []
        for text in texts:
            words = WORD.findall(text.lower())
            ids.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
            lettered.append(any(c.isalpha() for w in words for c in w))
            if kept is not None:
                kept.append(words)
        if self.words.new:
            upto = self.filled + len(self.words.new)
            if upto > len(self.known):
                grown = np.empty((2 * upto, self.known.shape[1]), np.float32)
                grown[:self.filled] = self.known[:self.filled]
                self.known = grown
            self.known[self.filled:upto] = self.field.scores(self.words.new)
            self.filled, self.words.new = upto, []
        lengths = np.fromiter(map(len, ids[1:]), np.int64, len(ids) - 1)
        return lengths, lettered, marginals(self.known[np.concatenate(ids)], lengths, self.field.transitions)


_LABELLERS: dict[str, Labeller] = {}


def labeller(key: str, field: Field) -> Labeller:
    """The worker's labeller, kept between tasks; of one field at a time."""
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(field)
    return _LABELLERS[key]


def _languages(own: Labeller, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
    """Language, its share and the mean sureness of the words, of each text; a text without letters is unknown and of neither."""
    labels = own.field.labels
    if not labels:
        # nothing was learned: a text with letters is of an unknown language, and nothing speaks against it
        sure = [float(any(c.isalpha() for c in t.decode("utf-8", "replace"))) for t in texts]
        return [UNKNOWN] * len(texts), [0.0] * len(texts), sure
    lengths, lettered, chance = own.label(t.decode("utf-8", "replace") for t in texts)
    begin = np.cumsum(lengths) - lengths
    some = np.flatnonzero(lengths)
    mean, sure = np.zeros((len(texts), len(labels))), np.zeros(len(texts))
    if len(some):
        mean[some] = np.add.reduceat(chance.astype(float), begin[some], axis=0) / lengths[some, None]
        sure[some] = np.add.reduceat(chance.max(axis=1).astype(float), begin[some]) / lengths[some]
    best = mean.argmax(axis=1)
    return (
        [labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], [min(1.0, float(mean[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered))],
        [float(s) if ok else 0.0 for s, ok in zip(sure, lettered)],
    )


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score.

    ``score`` is the mean probability of the language over the words. Null
    texts and texts without letters are "und" with score 0, and so are all if
    nothing could be learned. Rows are judged one by one; no other column is read.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(field), f"{id(field)}-{np.random.default_rng().integers(1 << 62)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(key, shared.value)
        for rows, texts in text_batches(batches, "text", BATCH_BYTES):
            names, scores, _ = _languages(own, texts)
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, words, langs, chances, for text that switches languages.

    Null, empty and letterless texts have empty lists; a field without
    languages labels every word "und" with chance 0. Rows are labelled one by
    one, so repeated rows and null ids keep their places. Empty input gives no
    rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(field), f"{id(field)}-{np.random.default_rng().integers(1 << 62)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(key, shared.value)
        for rows, texts in text_batches(batches, "text", BATCH_BYTES):
            found: list[list[str]] = []
            read = [t.decode("utf-8", "replace") for t in texts]
            if own.field.labels:
                lengths, _, chance = own.label(read, found)
            else:
                found = [WORD.findall(t.lower()) for t in read]
                lengths, chance = np.array(list(map(len, found)), np.int64), np.zeros((sum(map(len, found)), 1))
            names = np.array(own.field.labels or [UNKNOWN], dtype=object)[chance.argmax(axis=1)] if len(chance) else np.empty(0, object)
            ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in (([w for ws in found for w in ws], pa.string()), (names, pa.string()), (chance.max(axis=1) if len(chance) else [], pa.float32()))]
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *lists], ["doc_id", "words", "langs", "chances"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<string>, langs array<string>, chances array<float>")


def keep_identified(docs: DataFrame, field: Field, least_sure: float = 0.3) -> DataFrame:
    """``docs`` (text) without the texts that are in no language; all columns as they were.

    A text goes if it is null or has no letter, or if its words are, on
    average, less sure than ``least_sure``: the greatest probability of each
    word counts, whichever language that is, so a text that switches between
    languages is as good as one that doesn't. Where the field has learned no
    language, every text with a letter stays. Rows are judged one by one, so
    repeated rows and null ids fare alike; empty input gives no rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(field), f"{id(field)}-{np.random.default_rng().integers(1 << 62)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(key, shared.value)
        for rows, texts in text_batches(batches, "text", BATCH_BYTES):
            keep = pa.array([s > 0 and s >= least_sure for s in _languages(own, texts)[2]], pa.bool_())
            yield from rows.filter(keep).to_batches()

    return docs.mapInArrow(run, docs.schema)
