"""Line dedup with a deletion-neighbourhood join, by default for an edit bound of one.

Two lines are one edit apart if one is the other without a character, or if
both are equal without the character at one place. So each line emits the key
of itself, and for each place the key of what is left without that character;
lines with an equal (key, place), and a line with the key of another's
variant, are linked. The earliest line of a (key, place) stands for all others
there, so no group is paired out.

An edit leaves the first or the second half of a line as it is. Only lines that
share such a half with a line of fitting length emit variants.

For a bound of e edits a line emits what is left without up to e characters,
and the gaps they left there. Two lines with an equal rest are within the bound
if their gaps, taken together, are at most e: without p and q characters they
need p + q - e gaps in common. So they meet under the rest and each choice of so
many of their gaps, where again the earliest stands for all. One of e + 1
pieces of a line stays as it is, moved by no more than the edits before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.common import _INVERSE, _ODD, _powers, mix, stage

EDITS = 1
#: Shorter lines have no neighbours by edits: an edit is most of them.
LEAST_CHARS = 5
#: Lines that may have a neighbour are broadcast up to this size, by this width of a row; more of them meet the texts by shuffle.
BROADCAST_BYTES, ABLE_BYTES = 16 << 20, 64
VARIANTS = "line bigint, place int, key bigint"
MEETINGS = "line bigint, side int, key bigint"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _address(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("low"), F.xxhash64(F.lit(1), line).alias("high")]


def _pieces(edits: int) -> list[tuple[int, int, int]]:
    """(piece, characters that the shorter line lacks, places the piece moved) by which lines within the bound meet; without the last two it is a line's own."""
    return [(i, less, move) for less in range(edits + 1) for i in range(edits + 1) for move in range(max(-i, less - edits + i), min(i, less + edits - i) + 1)]


def _piece_keys(edits: int) -> list[Column]:
    n, keys = F.col("n"), []
    for i, less, move in _pieces(edits):
        start, end = (F.floor((n - less) * k / (edits + 1)).cast("int") for k in (i, i + 1))
        key = F.xxhash64(F.lit(i), n - less, F.substring(F.col("line"), start + move + 1, end - start))
        keys.append(F.when(start + move >= 0, key) if move < 0 else key)
    return keys


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line its own key at place -1 and the key without each character, from running sums."""
    inverse = np.uint64(_INVERSE)
    for batch in batches:
        held, size = [], 0
        for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            n = len(points)
            upto = np.concatenate(([np.uint64(0)], np.cumsum(mix(points + np.uint64(1)) * _powers(_ODD, n))))
            keys = np.concatenate(([upto[-1]], upto[:-1] + (upto[-1] - upto[1:]) * inverse))
            lengths = np.full(n + 1, n - 1, np.uint64)
            lengths[0] = n
            held.append((np.full(n + 1, line), np.arange(-1, n), mix(keys ^ mix(lengths)).view(np.int64)))
            size += n + 1
            if size > 1 << 20:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)


def _meetings(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """(line, key, side): lines of one key are within the bound of each other, those of side -1 with those of 1, those of 0 among themselves."""
    powers = np.array([pow(_INVERSE, k, 1 << 64) for k in range(edits + 1)], np.uint64)
    for batch in batches:
        held, size = [], 0
        for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            n = len(points)
            upto = np.concatenate(([np.uint64(0)], np.cumsum(mix(points + np.uint64(1)) * _powers(_ODD, n))))
            for rest, gaps in _without(upto, powers, n, edits):
                p, rest = gaps.shape[1], mix(rest ^ mix(np.full(len(rest), n - gaps.shape[1], np.uint64)))
                for q in range(edits + 1):
                    for chosen in combinations(range(p), max(0, p + q - edits)) if p or q else ():
                        key = rest ^ mix(np.array([min(p, q) * (edits + 1) + max(p, q) + 1], np.uint64))
                        for c in chosen:
                            key = mix(key) * np.uint64(_ODD) + gaps[:, c]
                        held.append((np.full(len(key), line), np.full(len(key), (p > q) - (p < q)), mix(key).view(np.int64)))
                        size += len(key)
                if size > 1 << 20:
                    yield _rows(held, ("line", "side", "key"))
                    held, size = [], 0
        if held:
            yield _rows(held, ("line", "side", "key"))


def _without(upto: np.ndarray, powers: np.ndarray, n: int, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is left of a line without up to so many characters, and the gaps in it, ascending: all last places of one choice at a time."""
    yield upto[-1:], np.zeros((1, 0), np.uint64)
    for p in range(1, min(edits, n) + 1):
        for first in combinations(range(n), p - 1):
            begin, head = 0, np.uint64(0)
            for k, at in enumerate(first):
                head, begin = head + (upto[at] - upto[begin]) * powers[k], at + 1
            last = np.arange(begin, n)
            if len(last):
                rest = head + (upto[last] - upto[begin]) * powers[p - 1] + (upto[-1] - upto[last + 1]) * powers[p]
                gaps = np.empty((len(last), p), np.uint64)
                gaps[:, :-1] = [at - k for k, at in enumerate(first)]
                gaps[:, -1] = last - (p - 1)
                yield rest, gaps


def _rows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], names: tuple[str, ...] = ("line", "place", "key")) -> pa.RecordBatch:
    parts = [np.concatenate(c) for c in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.int64())], list(names))


def _one_edit(texts: DataFrame) -> DataFrame:
    """(line, other): for each line the earliest of every (key, place), and of every key's other length."""
    # lines of one key differ by one character, so a key's rows are bounded by the alphabet and the line's length
    whole, variant = F.col("place") < 0, F.col("place") >= 0
    by_key, by_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    met = texts.mapInArrow(_variants, VARIANTS).select(
        "line", "place", F.min(F.when(whole, F.col("line"))).over(by_key).alias("shorter"), F.min(F.when(variant, F.col("line"))).over(by_key).alias("longer"),
        F.min("line").over(by_place).alias("swapped"),
    )
    others = F.when(whole, F.array("longer")).otherwise(F.array("shorter", "swapped"))
    return met.select("line", F.explode(others).alias("other"))


def _more_edits(texts: DataFrame, edits: int) -> DataFrame:
    """(line, other): for each line the earliest of the other side of every key; keys are pre-aggregated, so none is one task's group."""
    met = texts.mapInArrow(lambda it: _meetings(it, edits), MEETINGS)
    first = met.groupBy("key", (-F.col("side")).alias("side")).agg(F.min("line").alias("other"))
    return met.join(first, ["key", "side"]).select("line", "other")


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_exact: int | None = None, edits: int = EDITS) -> DataFrame:
    """Lines that go: doc_id, line_no, keep_doc, keep_line, edits.

    A line goes if an earlier one, by doc_id (null last) and line number from
    0, is equal or at most ``edits`` insertions, deletions and substitutions
    away, whether that one stays or not; of all such, the earliest is named,
    with the edits between both. A line of n characters has about n ** edits /
    edits! variants, emitted in pieces: bounds over one are for short lines. Lines
    end at line feeds. Null texts have no lines. Lines shorter than
    ``least_chars`` have no neighbours but equal ones, and those shorter than
    ``least_exact`` (``least_chars`` unless given) stay; at 0 every repeated
    line goes, empty ones too. Repeated rows share their place, so neither goes for
    the other's sake. Other columns are not read. Equal lines are those of one
    128-bit digest; linked ones are compared.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    lines = _lines(docs).where(F.length("line") >= (least_chars if least_exact is None else min(least_exact, least_chars)))
    keyed = lines.select("doc_id", "line_no", *_address(F.col("line")), F.length("line").alias("n"), "line")
    if edits < 1:
        raise ValueError("the bound is one edit or more")
    pieces = [f"h{i}" for i in range(len(_pieces(edits)))]
    narrow = keyed.select(place.alias("place"), "low", "high", "n", *[key.alias(c) for c, key in zip(pieces, _piece_keys(edits))])
    distinct = narrow.groupBy("low", "high").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("n", *pieces)])
    # numbered in order of place, so that the smaller number is the earlier line
    distinct = distinct.repartitionByRange("place").sortWithinPartitions("place").withColumn("line", F.monotonically_increasing_id())
    distinct = stage(distinct, "lines")

    half = F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(less == move == 0).alias("own")) for c, (_, less, move) in zip(pieces, _pieces(edits))])).alias("h")
    halves = distinct.where(F.col("n") >= least_chars).select("line", half).select("line", "h.key", "h.own").where("key IS NOT NULL")
    shared = halves.groupBy("key").agg(F.count(F.when(F.col("own"), 1)).alias("own"), F.count(F.lit(1)).alias("all")).where("own > 0 AND all > 1").select("key")
    able = halves.join(shared, "key", "left_semi").select("line").distinct()
    able = stage(distinct.join(able, "line", "left_semi").select("line", "place", "low", "high"), "lines-with-half")
    few = ABLE_BYTES * able.count() <= BROADCAST_BYTES
    texts = keyed.select(place.alias("at"), "low", "high", F.col("line").alias("text")).join(F.broadcast(able) if few else able, ["low", "high"]).where(F.col("at").eqNullSafe(F.col("place")))
    texts = stage(texts.select("line", "place", "text").dropDuplicates(["line"]), "line-texts")

    narrow = texts.select("line", "text")
    met = _one_edit(narrow) if edits == 1 else _more_edits(narrow, edits)
    pairs = met.where("other < line").distinct()
    own, other = texts.select("line", "text", "place"), texts.select(F.col("line").alias("other"), F.col("text").alias("other_text"), F.col("place").alias("keep"))
    near = pairs.join(own, "line").join(other, "other").withColumn("apart", F.levenshtein("text", "other_text", edits)).where((F.col("keep") < F.col("place")) & (F.col("apart") > 0))
    near = near.groupBy("line").agg(F.min(F.struct("keep", "apart")).alias("least")).select("line", F.col("least.keep").alias("near"), F.col("least.apart").alias("apart"))

    kept = distinct.select("low", "high", "place", "line").join(near, "line", "left").drop("line")
    all_lines = keyed.select(place.alias("at"), "low", "high").join(kept, ["low", "high"])
    exact, keep = F.col("at") > F.col("place"), F.least("place", "near")
    return all_lines.where(exact | F.col("near").isNotNull()).select(
        F.col("at.doc_id").alias("doc_id"), F.col("at.line_no").alias("line_no"), keep["doc_id"].alias("keep_doc"), keep["line_no"].alias("keep_line"),
        F.when(F.col("near").isNotNull() & (keep == F.col("near")), F.col("apart")).otherwise(F.lit(0)).alias("edits"),
    )


def without_dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_exact: int | None = 0, edits: int = EDITS) -> DataFrame:
    """``docs`` with the lines cut from their texts that ``dropped_lines`` names, by default equal ones of every length.

    A text of which all lines go is empty, a null one stays null. Repeated
    rows lose the same lines; all columns stay as they were. Empty input gives
    no rows.
    """
    gone = dropped_lines(docs, least_chars, least_exact, edits).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("line_no").alias("gone"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    left = F.array_join(F.filter(F.split("_row.text", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(left).alias("text")
    return packed.join(gone, F.col("_id").eqNullSafe(F.col("of")), "left").select(*[text if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
