"""Phrase collocation mining over count streams in prefix and suffix order.

Every word begins one window, the words that follow it in its piece, five at
most. Windows sorted by their words hold the counts of all phrases: those that
begin alike stand together, so one pass sums phrases of every length. Tasks deal
their sorted windows to ranges between the bounds of a sample, each run as one
packed block, and a range sorts what it gets. The frequent phrases are then kept as two sorted streams. In prefix order a phrase
follows its first parts, in suffix order its last ones, so one pass over each
stream, all lengths in step, gives every phrase the counts of its left and right
parts, and shows which phrases are as frequent as an extension of them. Both
streams are merged on the phrase. No table of phrases is held anywhere.

Ranges of a sorted stream are passed at once; what a range would need from those
before it is the path of its first phrase, four counts at most, which is added
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm import segments
from waymark.llm.common import one_list, stage, text_batches

WORDS = 5
LEAST_COUNT = 100
TOP = 2000
BATCH_BYTES = 4 << 20
#: Words of a language in a segment, and of all languages that a task holds.
SEGMENT_WORDS, MOST_WORDS_HELD = 4 << 20, 8 << 20
UNKNOWN = "und"

# Bytes that end a piece; A-Z count as a-z, a tab as a blank.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(ord("\n") if b in BREAKS else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Windows of a range that a task sorts at once, and how many of a range's windows are in the sample.
RANGE_WINDOWS, SAMPLED = 2 << 20, 512
#: Ranges that a segment is cut into; more are cut in a second step. Bounds of ranges (24 bytes each) in all.
CUTS, MOST_BOUNDS = 4096, 1 << 20

SEGMENTS = "segment bigint, lang string, words array<binary>, counts array<int>, stream binary, length int, sample array<int>"
#: Sorted windows of a range in a block. Ids are under 2^31, so two fill one column; order by the columns is order by the words.
BLOCKS = "range bigint, turn bigint, size int, block binary"
PHRASES = "w12 bigint, w34 bigint, w5 bigint, count bigint, open boolean"
MOST_WORDS = (1 << 31) - 2
KEY = ["w12", "w34", "w5"]
_HALF = 1 << 31


# ---- words of segments -----------------------------------------------------

class _Numbers(dict):
    """Numbers of words from 1; the break is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _stretches(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in stretches cut after breaks, which no phrase crosses; without breaks it stays whole."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(b"\n", at, at + most)
        cut = cut if cut >= 0 else text.find(b"\n", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class _Segment:
    """What a task has read of one language since the last segment."""

    def __init__(self) -> None:
        self.words, self.parts, self.size = _Numbers({b"\n": 0}), [], 0

    def add(self, run: bytes) -> None:
        words = self.words
        found = [words[w] for w in run.replace(b"\n", b" \n ").split(b" ") if w]
        self.parts.append(np.array([*found, 0], np.int32))
        self.size += len(found) + 1

    def row(self, number: int, lang: str, step: int) -> pa.RecordBatch:
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream, minlength=len(self.words))[1:]
        # what stands after a break is no part of a sampled window
        sample = np.concatenate([stream, np.zeros(WORDS, np.int32)])[np.arange(0, len(stream), step)[:, None] + np.arange(WORDS)]
        sample[np.cumsum(sample == 0, axis=1) > 0] = 0
        columns = [([*self.words][1:], pa.binary()), (counts, pa.int32()), (sample.ravel(), pa.int32())]
        words, counts, sample = (one_list(x, t) for x, t in columns)
        # bytes of one weight stand together: the upper ones are mostly zero
        packed = pa.compress(np.ascontiguousarray(stream.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([lang]), words, counts, pa.array([packed], pa.binary()), pa.array([len(stream)], pa.int32()), sample],
            ["segment", "lang", "words", "counts", "stream", "length", "sample"],
        )


def _unpacked(packed: bytes, length: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * length, "zstd", asbytes=True), np.uint8)
    return planes.reshape(4, length).T.copy().view(np.int32).ravel()


def _streams(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Per language and run of SEGMENT_WORDS words: distinct words, their counts, the texts as word numbers with a 0 after each piece, and the windows of every ``step``-th place."""
    number, held = segments.numbers(), {}
    for rows, texts in text_batches(batches, "text", BATCH_BYTES):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(rows["lang"].to_pylist(), texts):
            by_lang.setdefault(UNKNOWN if lang is None else lang, []).append(text.translate(_FOLD))
        for lang, own in by_lang.items():
            for run in _stretches(b"\n".join(own), BATCH_BYTES):
                held.setdefault(lang, _Segment()).add(run)
                if held[lang].size >= SEGMENT_WORDS:
                    yield held.pop(lang).row(next(number), lang, step)
        while sum(s.size for s in held.values()) > MOST_WORDS_HELD:
            lang = max(held, key=lambda x: held[x].size)
            yield held.pop(lang).row(next(number), lang, step)
    for lang, own in held.items():
        if len(own.words) > 1:
            yield own.row(next(number), lang, step)


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with ids from 1, dense and in order of language and word. Broadcast is one row per partition."""
    ordered = words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    placed = stage(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "words")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return stage(placed.join(F.broadcast(before), "part").select("lang", "word", (F.col("before") + F.col("row") + 1).alias("id")), "word-ids")


# ---- windows ------------------------------------------------------------------

def _blocks(columns: list[np.ndarray], bounds: np.ndarray, base: int, turn: int) -> pa.RecordBatch:
    """Sorted windows (three key columns, count) as a block per range; the first range, below all bounds, has the number ``base``."""
    ends = [0]
    for low, high, bound in zip(np.searchsorted(columns[0], bounds[0], "left").tolist(), np.searchsorted(columns[0], bounds[0], "right").tolist(), bounds.T[:, 1:].tolist()):
        for column, value in zip(columns[1:3], bound):
            low, high = (low + int(np.searchsorted(column[low:high], value, side)) for side in ("left", "right"))
        ends.append(low)
    ends.append(len(columns[0]))
    rows = []
    for i in np.flatnonzero(np.diff(ends)).tolist():
        own = np.stack([c[ends[i]:ends[i + 1]] for c in columns])
        own[0] = np.diff(own[0], prepend=0)
        # bytes of one weight stand together: most are zero
        planes = np.ascontiguousarray(own.view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1))
        rows.append((base + i, turn, own.shape[1], pa.compress(planes.tobytes(), "zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["range", "turn", "size", "block"])


def _read(blocks: pa.Table) -> list[np.ndarray]:
    """The windows of all blocks, sorted; equal ones are one, with their counts summed."""
    held = []
    for size, block in zip(blocks["size"].to_pylist(), blocks["block"].to_pylist()):
        planes = np.frombuffer(pa.decompress(block, 32 * size, "zstd", asbytes=True), np.uint8).reshape(4, 8, size)
        own = planes.transpose(0, 2, 1).copy().view(np.int64).reshape(4, size)
        np.cumsum(own[0], out=own[0])
        held.append(own)
    return _distinct(*np.concatenate(held, axis=1))


def _distinct(w12: np.ndarray, w34: np.ndarray, w5: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Windows sorted; equal ones are one, with their counts summed."""
    order = np.lexsort((w5, w34, w12))
    w12, w34, w5, count = w12[order], w34[order], w5[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (w12[1:] != w12[:-1]) | (w34[1:] != w34[:-1]) | (w5[1:] != w5[:-1]))))
    return [w12[first], w34[first], w5[first], np.add.reduceat(count, first)]


def _windows(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct windows of each segment in order, with their counts, as a block per range. A word without an id ends a piece."""
    for batch in batches:
        for i in range(batch.num_rows):
            segment, packed, length = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("segment", "stream", "length"))
            numbers, ids = (np.asarray(batch.column(batch.schema.get_field_index(c))[i].values, np.int64) for c in ("numbers", "id"))
            stream = _unpacked(packed, length)
            known = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
            # numbers of the list count from 0, those of the stream from 1
            known[numbers + 1] = ids
            own = np.concatenate([known[stream], np.zeros(WORDS, np.int64)])
            n = len(stream)
            words, alive = [], np.ones(n, bool)
            for j in range(WORDS):
                alive = alive & (own[j:n + j] > 0)
                words.append(np.where(alive, own[j:n + j], 0))
            begins = words[0] > 0
            w12, w34, w5 = words[0][begins] * _HALF + words[1][begins], words[2][begins] * _HALF + words[3][begins], words[4][begins]
            del words, own, alive
            if len(w12):
                yield _blocks(_distinct(w12, w34, w5, np.ones(len(w12), np.int64)), bounds, 0, (segment >> 32) + (segment & 0xFFFFFFFF))


def _finer(group: pa.Table, bounds: np.ndarray, every: int) -> pa.Table:
    """Blocks of a wide range, cut at the bounds within it."""
    wide = group["range"][0].as_py()
    base = max(0, wide - 1) * every
    return pa.Table.from_batches([_blocks(_read(group), bounds[:, base:wide * every], base, 0)])


def _range_sums(group: pa.Table, least: int) -> pa.Table:
    """The phrases of one range, from all its blocks."""
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in _read(group)], ["w12", "w34", "w5", "count"])
    return pa.Table.from_batches(list(_summed(iter([batch]), least)))


def _range_bounds(sampled: DataFrame, range_windows: int, step: int) -> np.ndarray:
    """Keys that cut the windows into ranges of about ``range_windows``: evenly spaced ones of the sorted sample, MOST_BOUNDS at most."""
    size = sampled.count()
    every = max(1, range_windows // step, -(-size // (MOST_BOUNDS // 2)))
    if size <= every:
        return np.zeros((3, 0), np.int64)
    placed = sampled.repartitionByRange(*KEY).sortWithinPartitions(*KEY).select(*KEY, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    found = sorted({tuple(r) for r in placed.where(F.col("row") % every == every // 2).select(*KEY).collect()})
    return np.array(found, np.int64).reshape(-1, 3).T


def _dealt(segs: DataFrame, bounds: np.ndarray, cuts: int) -> DataFrame:
    """Windows of all segments as blocks of ranges. Past ``cuts`` ranges, segments are cut into wide ones, and blocks of many segments into the ranges of each."""
    every = max(1, -(-bounds.shape[1] // cuts))
    wide = bounds[:, ::every]
    blocks = segs.mapInArrow(lambda it: _windows(it, wide), BLOCKS)
    if every == 1:
        return blocks
    # four ranges' windows at a time
    turn = F.col("turn") % F.lit(-(-every // 4))
    return blocks.withColumn("turn", turn).groupBy("range", "turn").applyInArrow(lambda t: _finer(t, bounds, every), BLOCKS)


def _prefixes(w12: np.ndarray, w34: np.ndarray, w5: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of the first 1 to 5 words."""
    none = np.zeros_like(w5)
    return [(w12 // _HALF * _HALF, none, none), (w12, none, none), (w12, w34 // _HALF * _HALF, none), (w12, w34, none), (w12, w34, w5)]


def _lengths(w12: np.ndarray, w34: np.ndarray, w5: np.ndarray) -> np.ndarray:
    return 1 + (w12 % _HALF > 0).astype(np.int64) + (w34 > 0) + (w34 % _HALF > 0) + (w5 > 0)


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of a range of sorted windows. Those whose windows may go on in another range are open, and come whatever their count."""
    held: list[tuple[tuple[int, int, int], int, bool] | None] = [None] * WORDS

    def rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["w12", "w34", "w5", "count", "open"])

    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        w12, w34, w5, count = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("w12", "w34", "w5", "count"))
        length, out = _lengths(w12, w34, w5), []
        for m, key in enumerate(_prefixes(w12, w34, w5)):
            new = np.concatenate(([True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])))
            # a shorter window has no phrase of this length, and stands before the longer ones that begin like it
            new |= np.concatenate(([True], (length[1:] > m) != (length[:-1] > m)))
            first = np.flatnonzero(new)
            sums, keys, whole = np.add.reduceat(count, first), [k[first] for k in key], length[first] > m
            keys, sums = [k[whole] for k in keys], sums[whole]
            is_open = np.zeros(len(sums), bool)
            if held[m] is not None:
                before, so_far, was_open = held[m]
                if len(sums) and tuple(int(k[0]) for k in keys) == before:
                    sums[0] += so_far
                    is_open[0] = was_open
                else:
                    keys, sums, is_open = [np.concatenate(([v], k)) for v, k in zip(before, keys)], np.concatenate(([so_far], sums)), np.concatenate(([was_open], is_open))
            elif not begun and len(sums) and whole[0]:
                is_open[0] = True
            if len(sums):
                held[m] = (tuple(int(k[-1]) for k in keys), int(sums[-1]), bool(is_open[-1]))
                done = np.flatnonzero((sums[:-1] >= least) | is_open[:-1])
                out.append((*(k[done] for k in keys), sums[done], is_open[done]))
        begun = True
        if out:
            yield rows(out)
    last = [(*(np.array([v]) for v in x[0]), np.array([x[1]]), np.array([True])) for x in held if x is not None]
    if last:
        yield rows(last)


# ---- streams of phrases ----------------------------------------------------------

def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of a sorted stream: each phrase with the counts of its first 1 to 4 words, null where these stand before the range."""
    part, carried = TaskContext.get().partitionId(), np.full(WORDS, -1, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        w12, w34, w5, count = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in (*KEY, "count"))
        length, at, parts = _lengths(w12, w34, w5), np.arange(batch.num_rows), []
        for m in range(1, WORDS):
            # the last phrase of m words is the beginning of all longer ones that follow it
            nearest = np.maximum.accumulate(np.where(length == m, at, -1))
            found = np.where(nearest >= 0, count[nearest], carried[m])
            carried[m] = found[-1]
            parts.append(pa.array(found, mask=(found < 0) | (length <= m)))
        columns = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(length, pa.int32()), *(pa.array(x) for x in (w12, w34, w5, count)), *parts]
        yield pa.RecordBatch.from_arrays(columns, ["part", "length", *KEY, "count", *(f"p{m}" for m in range(1, WORDS))])


def word(n: int) -> Column:
    """Id of the n-th word of a key, from 0; 0 where there is none."""
    if n == 4:
        return F.col("w5")
    column = F.col(KEY[n // 2])
    return F.shiftright(column, 31) if n % 2 == 0 else column.bitwiseAND(F.lit(_HALF - 1))


def key_of(words: list[Column]) -> list[Column]:
    """Key columns of up to five words."""
    full = words + [F.lit(0).cast("bigint")] * (WORDS - len(words))
    return [(F.shiftleft(full[0], 31) + full[1]).alias("w12"), (F.shiftleft(full[2], 31) + full[3]).alias("w34"), full[4].alias("w5")]


def reverse(phrases: DataFrame) -> DataFrame:
    """``phrases`` (key, length) with the keys of the same words from last to first."""
    words = [F.coalesce(*[F.when(F.col("length") == n, word(n - 1 - i)) for n in range(i + 1, WORDS + 1)], F.lit(0).cast("bigint")) for i in range(WORDS)]
    return phrases.select(*key_of(words), *[c for c in phrases.columns if c not in KEY])


def with_parts(phrases: DataFrame, name: str) -> DataFrame:
    """One pass in key order: ``phrases`` (key, count) with length and p1 to p4, the counts of their first 1 to 4 words.

    A phrase's beginnings are phrases too. Null where a phrase is no longer.
    """
    ordered = phrases.select(*KEY, "count").repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    passed = stage(ordered.mapInArrow(_passed, "part int, length int, w12 bigint, w34 bigint, w5 bigint, count bigint, " + ", ".join(f"p{m} bigint" for m in range(1, WORDS))), name)
    # what stands before a range: the same path for all its phrases, so at most four keys per range
    missing = passed.select("part", F.explode(F.array(*[
        F.when((F.col("length") > m) & F.col(f"p{m}").isNull(), F.struct(F.lit(m).alias("m"), *key_of([word(i) for i in range(m)]))) for m in range(1, WORDS)
    ])).alias("of")).where("of IS NOT NULL").select("part", "of.*").distinct()
    seams = phrases.join(F.broadcast(missing), KEY).groupBy("part").agg(*[F.max(F.when(F.col("m") == m, F.col("count"))).alias(f"s{m}") for m in range(1, WORDS)])
    filled = [F.when(F.col("length") > m, F.coalesce(f"p{m}", f"s{m}")).alias(f"p{m}") for m in range(1, WORDS)]
    return passed.join(F.broadcast(seams), "part", "left").select("length", *KEY, "count", *filled)


# ---- the operator ----------------------------------------------------------------

def _sampled(segs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The keys of the sampled windows. A word without an id ends a window."""
    placed = segs.select("segment", F.posexplode("sample").alias("at", "number")).where("number > 0").select("segment", (F.col("number") - 1).alias("number"), F.expr(f"at div {WORDS}").alias("window"), (F.col("at") % WORDS).alias("place"))
    known = placed.join(resolved, ["segment", "number"]).groupBy("segment", "window").agg(*[F.max(F.when(F.col("place") == i, F.col("id"))).alias(f"id{i}") for i in range(WORDS)])
    there, ids = F.lit(True), []
    for i in range(WORDS):
        there = there & F.col(f"id{i}").isNotNull()
        ids.append(F.when(there, F.col(f"id{i}")).otherwise(F.lit(0).cast("bigint")))
    return known.where("id0 IS NOT NULL").select(*key_of(ids))


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, range_windows: int = RANGE_WINDOWS, cuts: int = CUTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (key, count) of 1 to 5 words with ``least`` occurrences, their words (lang, word, id), and words per language (lang, n).

    A task sorts about ``range_windows`` windows at once, more where the corpus
    needs more than MOST_BOUNDS ranges; ``cuts`` bounds the blocks of a segment.
    Neither changes the result.
    """
    step = max(1, range_windows // SAMPLED)
    own = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    segs = stage(own.mapInArrow(lambda it: _streams(it, step), SEGMENTS), "word-streams")
    met = segments.entries(segs, {"words": "word", "counts": "count"}, ["lang"])
    totals = stage(met.groupBy("lang", "word").agg(F.sum("count").alias("count")), "word-counts")
    spoken = totals.groupBy("lang").agg(F.sum("count").alias("n"))
    frequent = totals.where(F.col("count") >= least)
    if frequent.count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words occur {least} times")
    words = _numbered(frequent.select("lang", "word"))
    resolved = stage(met.select("segment", "number", "lang", "word").join(words, ["lang", "word"], "left").select("segment", "number", "id"), "resolved")
    bounds = _range_bounds(stage(_sampled(segs, resolved), "sample"), range_windows, step)
    whole = segments.with_resolved(segs.select("segment", "stream", "length"), resolved, ["id"])
    summed = stage(_dealt(whole, bounds, cuts).groupBy("range").applyInArrow(lambda t: _range_sums(t, least), PHRASES), "window-sums")
    # only the first and last phrase of each length in a range can stand in several
    cut = summed.where("open").groupBy(*KEY).agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    return stage(summed.where("NOT open").select(*KEY, "count").unionByName(cut), "phrases"), words, spoken


def scored(phrases: DataFrame, words: DataFrame, spoken: DataFrame, inside_percent: int = 100) -> DataFrame:
    """Phrases of 2 to 5 words that stay: length, key, a, lang, n, and the lowest-scoring cut's l, r and score."""
    forward = with_parts(phrases, "prefix-order")
    measured = phrases.select(*KEY, "count", (F.lit(1) + sum((word(i) > 0).cast("int") for i in range(1, WORDS))).alias("length"))
    backward = reverse(with_parts(reverse(measured), "suffix-order").select(*KEY, "length", *[F.col(f"p{m}").alias(f"q{m}") for m in range(1, WORDS)]))
    both = stage(forward.join(backward.drop("length").hint("merge"), KEY).where("length > 1"), "parts")

    # an extension by several words that is frequent enough shows one by a single word that is
    as_frequent = lambda part: 100 * F.col("count") >= inside_percent * part
    first, last = (F.coalesce(*[F.when(F.col("length") == n, F.col(f"{p}{n - 1}")) for n in range(2, WORDS + 1)]) for p in "pq")
    all_but_last = [F.when(F.col("length") > i + 1, word(i)).otherwise(F.lit(0).cast("bigint")) for i in range(WORDS)]
    held = both.where(as_frequent(first)).select(*key_of(all_but_last)).unionByName(both.where(as_frequent(last)).select(*key_of([word(i) for i in range(1, WORDS)]))).distinct()

    of_lang = words.select(F.col("id").alias("_first"), "lang").join(F.broadcast(spoken), "lang")
    kept = both.join(held.hint("merge"), KEY, "left_anti").withColumn("_first", word(0)).join(of_lang, "_first").drop("_first")
    wide = lambda c: c.cast("decimal(19,0)")
    right = lambda k: F.coalesce(*[F.when(F.col("length") == n, F.col(f"q{n - k}")) for n in range(k + 1, WORDS + 1)])
    cuts = []
    for k in range(1, WORDS):
        l, r = F.col(f"p{k}"), right(k)
        kept = kept.withColumn(f"_a{k}", wide(F.col("count")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).withColumn(f"_b{k}", wide(l) * wide(r))
        cuts.append(F.when(F.col("length") > k, F.struct(F.expr(f"_a{k} div _b{k}").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    lowest = F.array_min(F.array_compact(F.array(*cuts)))
    return kept.select("length", *KEY, F.col("count").alias("a"), "lang", "n", lowest.alias("_cut")).select("length", *KEY, "a", "lang", "n", "_cut.score", "_cut.l", "_cut.r")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, inside_percent: int = 100) -> DataFrame:
    """Phrases of ``docs`` (lang, text) that are said more often than their parts would be: lang, rank, phrase, a, l, r, n, score.

    Counts are over whole texts and per language; a null language is "und", as
    is one of that name. Null and empty texts have no words, repeated rows count
    each. A phrase goes if an extension of it, whether that goes or not, has
    ``inside_percent`` of its count. Ties in score go by count and then by the
    bytes of the phrase. Other columns are not read. Empty input gives no rows.
    """
    phrases, words, spoken = frequent_phrases(docs, least)
    # those that tie with the last place stay until their words are there
    near = scored(phrases, words, spoken, inside_percent).withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= top)
    near = stage(near.drop("_rank"), "near-top")
    spelt = near.select("lang", *KEY, "a", "l", "r", "n", "score", F.posexplode(F.array(*[word(i) for i in range(WORDS)])).alias("_place", "id")).where("id > 0")
    spelt = spelt.join(words.select("id", F.col("word").cast("string").alias("word")), "id").groupBy("lang", *KEY, "a", "l", "r", "n", "score")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "word"))), lambda x: x["word"]), " ")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    return spelt.agg(phrase.alias("phrase")).select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score").where(F.col("rank") <= top)
