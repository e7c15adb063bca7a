"""Benchmark decontamination with a distributed positional inverted index.

Each task indexes its own documents as a segment: sorted terms, and per term the
gaps between the word positions where it stands. A phrase is found in a segment
by intersecting the position lists of its words, shifted by the word's offset,
from the rarest word on; most phrases end at a word that the segment lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import SEGMENT_ROWS, byte_class, joined_words, one_list, stage, text_batches

#: Words are runs of digits, letters and all that is not ASCII.
WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
WINDOW = 13
SEGMENT_BYTES = 6 << 20
BLOCK_BYTES = 16 << 20

INDEX = "segment bigint, doc_ids array<bigint>, text_keys array<bigint>, lengths array<int>, terms array<bigint>, counts array<int>, gaps array<int>"
FOUND = "segment bigint, doc_no int, item int, begin int, end int"


def _grouped(values: np.ndarray) -> np.ndarray:
    """Places of the values, ordered by value and then place."""
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    key = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = values[order]
    if np.any((ordered[1:] != ordered[:-1]) & ((ordered[1:] >> bits) == (ordered[:-1] >> bits))):
        return np.argsort(values, kind="stable")
    return order


def segment_lists(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, postings per term and position gaps. One position stays free after each document, so no phrase crosses over."""
    place = np.arange(len(values), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
    order = _grouped(values)
    terms, place = values[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    return terms[first].view(np.int64), np.diff(np.append(first, len(terms))).astype(np.int32), gaps.astype(np.int32)


def _index(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for rows, texts in text_batches(batches, "text", segment_bytes):
        values, lengths = joined_words(texts, WORDS)
        terms, counts, gaps = segment_lists(values, lengths)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), one_list(rows["doc_id"].combine_chunks(), pa.int64()), one_list(rows["text_key"].combine_chunks(), pa.int64()),
                one_list(lengths, pa.int32()), one_list(terms, pa.int64()), one_list(counts, pa.int32()), one_list(gaps, pa.int32()),
            ],
            ["segment", "doc_ids", "text_keys", "lengths", "terms", "counts", "gaps"],
        )
        number += 1


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder; no text is shuffled.

    Whole texts are indexed. A null text has no words and still has its place
    in the document list; repeated rows and null ids stay apart. Other columns
    are not read, so their names can't clash.
    """
    own = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_key"))
    return stage(own.mapInArrow(lambda it: _index(it, segment_bytes), INDEX), "positions", most_rows=SEGMENT_ROWS)


def indexed_documents(index: DataFrame) -> DataFrame:
    """Every document of the index: segment, doc_no, doc_id, text_key, n_words."""
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "lengths")).alias("doc_no", "d"))
    return rows.select("segment", "doc_no", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.lengths").cast("bigint").alias("n_words"))


def windows_of(values: np.ndarray, window: int) -> np.ndarray:
    """Rows of consecutive words; one row with all of them if there are fewer, none without words."""
    if len(values) == 0:
        return np.empty((0, window), np.uint64)
    return np.lib.stride_tricks.sliding_window_view(values, min(window, len(values)))


class Phrases:
    """A block of phrases as term numbers: per length, a matrix of phrases and the item of each."""

    def __init__(self, phrases: list[tuple[int, np.ndarray]]) -> None:
        by_length: dict[int, tuple[list, list]] = {}
        for item, rows in phrases:
            if len(rows):
                mats, items = by_length.setdefault(rows.shape[1], ([], []))
                mats.append(rows)
                items.append(np.full(len(rows), item, np.int64))
        self.terms = np.unique(np.concatenate([m.ravel() for mats, _ in by_length.values() for m in mats])) if by_length else np.empty(0, np.uint64)
        self.groups = [(n, np.searchsorted(self.terms, np.concatenate(mats)), np.concatenate(items)) for n, (mats, items) in sorted(by_length.items())]


def _member(wanted: np.ndarray, listed: np.ndarray) -> np.ndarray:
    at = np.searchsorted(listed, wanted)
    at[at == len(listed)] = 0
    return listed[at] == wanted


def search_segment(phrases: Phrases, terms: np.ndarray, counts: np.ndarray, gaps: np.ndarray, slop: int = 0) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """First and last position of each occurrence, per phrase that occurs, with its item.

    With slop, the words stand in order with at most that many others among
    them; each start is reported with its nearest end.
    """
    bounds = np.concatenate(([0], np.cumsum(counts)))
    at = np.searchsorted(terms.view(np.uint64), phrases.terms) if len(terms) else np.zeros(len(phrases.terms), np.int64)
    here = np.zeros(len(phrases.terms), bool)
    if len(terms):
        at[at == len(terms)] = 0
        here = terms.view(np.uint64)[at] == phrases.terms
    lists: dict[int, np.ndarray] = {}

    def places(t: int) -> np.ndarray:
        if t not in lists:
            lists[t] = np.cumsum(gaps[bounds[at[t]]:bounds[at[t] + 1]], dtype=np.int64)
        return lists[t]

    out = []
    for n, rows, items in phrases.groups:
        for k in np.flatnonzero(here[rows].all(axis=1)):
            row = rows[k]
            rarest = np.argsort(counts[at[row]], kind="stable")
            if slop:
                start = places(row[0])
                near, low = places(row[rarest[0]]), np.searchsorted(places(row[rarest[0]]), start, "left")
                start = start[(low < len(near)) & (near[np.minimum(low, len(near) - 1)] - start <= n - 1 + slop)]
                end = start
                for t in row[1:]:
                    listed = places(t)
                    nxt = np.searchsorted(listed, end, "right")
                    keep = nxt < len(listed)
                    start, end = start[keep], listed[nxt[keep]]
                keep = end - start <= n - 1 + slop
                start, end = start[keep], end[keep]
            else:
                start = places(row[rarest[0]]) - rarest[0]
                for o in rarest[1:]:
                    if len(start) == 0:
                        break
                    start = start[_member(start + o, places(row[o]))]
                end = start + n - 1
            if len(start):
                out.append((start, end, int(items[k])))
    return out


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            lengths, terms, counts, gaps = (batch.column(batch.schema.get_field_index(c))[r].values.to_numpy(zero_copy_only=False) for c in ("lengths", "terms", "counts", "gaps"))
            found = search_segment(phrases, terms, counts, gaps, slop)
            if not found:
                continue
            base = np.concatenate(([0], np.cumsum(lengths.astype(np.int64) + 1)))
            start, end = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            item = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
            doc = np.searchsorted(base, start, "right") - 1
            keep = end < base[doc + 1] - 1
            order = np.lexsort((start[keep], item[keep], doc[keep]))
            doc, item, begin, end = (x[keep][order] for x in (doc, item, start, end + 1))
            if len(doc) == 0:
                continue
            # of one document and item, intervals that touch become one
            group = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
            number = np.cumsum(group) - 1
            reach = np.maximum.accumulate(end + number * (base[-1] + 1)) - number * (base[-1] + 1)
            fresh = group | np.concatenate(([True], begin[1:] > reach[:-1]))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), batch.column(0)[r].as_py()), pa.int64()), pa.array(doc[first], pa.int32()), pa.array(item[first], pa.int32()),
                    pa.array(begin[first] - base[doc[first]], pa.int32()), pa.array(reach[last] - base[doc[first]], pa.int32()),
                ],
                ["segment", "doc_no", "item", "begin", "end"],
            )


def _blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The stated test items in blocks of a bounded size, so that any number of them works."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        text = r["text"].encode()
        if block and size + len(text) > most_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def find_items(index: DataFrame, items: DataFrame, window: int | None = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where the items (item_id, text) stand in the indexed documents: segment, doc_no, item_id, begin, end (words).

    ``window`` cuts an item into runs of that many words, each sought by
    itself; None seeks the whole item. ``slop`` allows other words in between.
    Overlapping places of one item are joined. Items go in blocks of a bounded
    size, each broadcast and searched over the whole index. Items without words
    are never found; a null item_id is a name like any other.
    """
    spark = index.sparkSession
    parts = []
    for block in _blocks(items, block_bytes):
        values, lengths = joined_words([t for _, t in block], WORDS)
        cuts = np.split(values, np.cumsum(lengths)[:-1])
        phrases = spark.sparkContext.broadcast(Phrases([(i, windows_of(v, window or max(1, len(v)))) for i, v in enumerate(cuts)]))
        hits = index.select("segment", "lengths", "terms", "counts", "gaps").mapInArrow(lambda it, p=phrases: _search(it, p.value, slop), FOUND)
        names = F.array(*[F.lit(i).cast("bigint") for i, _ in block]) if len(block) <= 1000 else None
        if names is not None:
            hits = hits.withColumn("item_id", F.element_at(names, F.col("item") + 1))
        else:
            hits = hits.join(F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id bigint")), "item")
        parts.append(hits.select("segment", "doc_no", "item_id", "begin", "end"))
    if not parts:
        return spark.createDataFrame([], "segment bigint, doc_no int, item_id bigint, begin int, end int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_words, n_hit, item_ids, contaminated.

    A word is hit if it lies in a window of an item; a document is contaminated
    if hit words are at least one in ``share`` of its words. A null or empty
    text, and a table without items, give zeros and false; repeated rows are
    judged one by one. Item ids that repeat count once; a null one counts as "".
    """
    index = build_index(docs, segment_bytes)
    found = find_items(index, items, window, 0, block_bytes)
    span = F.struct("begin", "end")
    hits = found.groupBy("segment", "doc_no").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["begin"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"].cast("bigint"),
    )
    hits = hits.select("segment", "doc_no", covered.alias("n_hit"), "item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return indexed_documents(index).join(hits, ["segment", "doc_no"], "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were.

    Null, empty and wordless texts are never contaminated and stay. Repeated
    rows and rows of null id fare alike if their texts do. Without items, or
    without rows, ``docs`` is returned as it is.
    """
    bad = contamination(docs, items, window, share).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64("text").alias("_text"))
    return packed.join(bad, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_anti").select("_row.*")
