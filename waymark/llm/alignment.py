"""Cross-tokenizer alignment by pointer jumping.

The tokens of both tokenizers are byte ranges that tile the same text. Every
token points to its farthest-right overlapping token; doubling the pointers
leads each to the last token of its component, which labels the group. Neither
tokenizer's tokens cross from one chunk of a text into the next, so groups don't
either: the chunks that a worker has not met yet are laid one after another and
aligned at once, and a text is the sum of its chunks.

How often a pair of ids ends together in the corpus is counted per segment
first; a segment's pairs then meet the totals once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm import segments
from waymark.llm.common import SEGMENT_ROWS, one_list, stage, text_batches
from waymark.llm.tokens import FOLDER, Chunks, Grown, Ragged, bpe, chunks, once, sentence_pieces, vocabulary

LEFT, RIGHT = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
SEGMENT_BYTES = 2 << 20

#: A segment's texts are numbers of its chunks, ending at chunk_ends; a chunk's links are numbers of its pairs, ending at link_ends.
SEGMENTS = (
    "segment bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups array<string>, "
    "chunk_ends array<int>, chunks array<int>, link_ends array<int>, links array<int>, pairs array<bigint>, counts array<bigint>"
)
OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable bytes stand for themselves, the others in order from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def left_bytes(content: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    def load(data: bytes) -> list[bytes]:
        tokenizer, letters = bpe(data, plain_specials=True), byte_letters()
        entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        return [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
    return once("left-bytes", content, load)


def right_bytes(content: bytes) -> list[bytes]:
    """Bytes of each id of a sentence piece vocabulary."""
    def load(data: bytes) -> list[bytes]:
        own = sentence_pieces(data)
        return [bytes([int(own.id_to_piece(i)[3:-1], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
    return once("right-bytes", content, load)


def labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last right token of each token's component, for token ends over one axis that both tile.

    A left token's farthest overlapping token is the right one in which it
    ends, a right token's the left one in which it ends, or itself if that
    reaches no farther.
    """
    m = len(a_ends)
    to = np.empty(m + len(b_ends), np.int64)
    to[:m] = m + np.searchsorted(b_ends, a_ends)
    over = np.searchsorted(a_ends, b_ends)
    to[m:] = np.where(a_ends[over] > b_ends, over, m + np.arange(len(b_ends))) if m else 0
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:m] - m, to[m:] - m
        to = further


def _tables(content: bytes, size: int) -> np.ndarray:
    """Decimal ids with what may follow them: a comma, a bar, a semicolon, nothing."""
    return once(f"decimals-{size}", content, lambda _: np.array([f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(size)], dtype=object))


def rendered(a: np.ndarray, b: np.ndarray, a_label: np.ndarray, b_label: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> list[str]:
    """The groups of each chunk in the form a1,a2|b1;a3|b2,b3; ``lengths`` are its left and right tokens together."""
    # left tokens of a group stand before its right ones
    label = np.concatenate([2 * a_label, 2 * b_label + 1])
    order = np.argsort(label, kind="stable")
    label, ids = label[order], np.concatenate([a, b])[order]
    follows = np.append(label[1:], -1)
    sign = np.where(follows == label, 0, np.where(label % 2 == 0, 1, 2))
    ends = np.cumsum(lengths)
    sign[ends[lengths > 0] - 1] = 3
    strings = table[ids + sign * (len(table) // 4)].tolist()
    return ["".join(strings[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist())]


class Aligner:
    """What is known of chunks: their tokens, groups and links."""

    def __init__(self, left_content: bytes, right_content: bytes) -> None:
        self.left, self.right = bpe(left_content, plain_specials=True), sentence_pieces(right_content)
        self.a_bytes, self.b_bytes = left_bytes(left_content), right_bytes(right_content)
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.table = _tables(left_content, max(len(self.a_bytes), len(self.b_bytes)))
        self.clear()

    def clear(self) -> None:
        self.known, self.groups, self.links = Chunks(self._learn), [], Ragged(np.int64)
        #: left tokens, right tokens, groups, and whether the bytes are not given back
        self.sums = [Grown(np.int64) for _ in range(4)]

    def _learn(self, parts: list[str]) -> None:
        """The left tokenizer reads a blank and the chunk, the right one adds the blank."""
        a_ids = [e.ids for e in self.left.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b_ids = self.right.encode(parts, num_threads=1)
        lost = np.zeros(len(parts), np.int64)
        for i, part in enumerate(parts):
            whole = b" " + part.encode()
            if b"".join(map(self.a_bytes.__getitem__, a_ids[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids[i])) != whole:
                lost[i], a_ids[i], b_ids[i] = 1, [], []
        a_lengths, b_lengths = (np.array(list(map(len, x)), np.int64) for x in (a_ids, b_ids))
        a, b = (np.array([i for ids in x for i in ids], np.int64) for x in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_label, b_label = labels(a_ends, b_ends)
        self.groups += rendered(a, b, a_label, b_label, a_lengths + b_lengths, self.table)
        # tokens that end together: each left one, and the right one in which it ends, if that ends there
        met = np.searchsorted(b_ends, a_ends)
        linked = b_ends[met] == a_ends
        within = lambda flags, lengths: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], np.cumsum(lengths)))])
        self.links.add(b[met[linked]] << 32 | a[linked], within(linked, a_lengths))
        n_groups = within(b_label == np.arange(len(b)), b_lengths)
        for held, values in zip(self.sums, (a_lengths, b_lengths, n_groups, lost)):
            held.add(values)


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], ends))])


def _segments(batches: Iterator[pa.RecordBatch], left_content: bytes, right_content: bytes) -> Iterator[pa.RecordBatch]:
    own, number = once("aligner", left_content + right_content, lambda _: Aligner(left_content, right_content)), segments.numbers()
    for rows, texts in text_batches(batches, "text", SEGMENT_BYTES):
        if own.known.full:
            own.clear()
        parts, held, given = [], [], []
        for text in texts:
            read = text.decode("utf-8", "replace")
            split = chunks(read) if text else []
            parts += split
            held.append(len(split))
            # what is no UTF-8 can't be given back
            given.append("\ufffd" not in read or read.encode() == text)
        at, ends = own.known.numbers(parts), np.cumsum(held, dtype=np.int64)
        whole = (_per_text(own.sums[3].all[at], ends) == 0) & np.array(given, bool)
        n_a, n_b, n_groups = (_per_text(own.sums[i].all[at], ends) * whole for i in range(3))
        begins = ends - held
        groups = [hashlib.sha256(";".join(map(own.groups.__getitem__, at[b:e].tolist())).encode()).hexdigest() if ok and e > b else "" for b, e, ok in zip(begins.tolist(), ends.tolist(), whole.tolist())]

        at = at[np.repeat(whole, held)]
        count = np.bincount(at, minlength=len(own.known))
        used = np.flatnonzero(count)
        place = np.zeros(len(count), np.int32)
        place[used] = np.arange(len(used))
        linked, lengths = own.links.take(used)
        pairs, links = np.unique(linked, return_inverse=True)
        counts = np.bincount(links, np.repeat(count[used], lengths), len(pairs)).astype(np.int64)
        columns = [(rows["doc_id"].combine_chunks(), pa.int64()), *((x, pa.int64()) for x in (n_a, n_b, n_groups)), (groups, pa.string()), (np.cumsum(np.array(held) * whole), pa.int32()), (place[at], pa.int32()), (np.cumsum(lengths), pa.int32()), (links, pa.int32()), (pairs, pa.int64()), (counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), *(one_list(x, t) for x, t in columns)], [f.split()[0] for f in SEGMENTS.split(", ")])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_ids", "n_a", "n_b", "n_groups", "groups", "chunk_ends", "chunks", "link_ends", "links", "numbers", "total", "best"]
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids, n_a, n_b, n_groups, groups, chunk_ends, chunks_, link_ends, links, numbers, total, best = (batch.column(batch.schema.get_field_index(c))[i].values for c in names)
            of_chunk, ends = [], np.asarray(chunk_ends)
            for values in (np.asarray(total), np.asarray(best.cast(pa.int64())), None):
                of_pair = np.ones(len(numbers), np.int64)
                if values is not None:
                    of_pair[np.asarray(numbers)] = values
                of_chunk.append(_per_text(of_pair[np.asarray(links)], np.asarray(link_ends)))
            count_sum, n_best, n_links = (_per_text(x[np.asarray(chunks_)], ends) for x in of_chunk)
            yield pa.RecordBatch.from_arrays([doc_ids, n_a, n_b, n_groups, *map(pa.array, (n_links, n_best, count_sum)), groups], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, left: str = LEFT, right: str = RIGHT) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (doc_id, text) its tokens, groups and links; and the pairs of the corpus with their counts.

    The left text is a blank and the text, the right tokenizer adds the blank.
    Null and empty texts, and those that either tokenizer's bytes don't give
    back, have no tokens: zeros and an empty digest. Rows are aligned one by
    one, so repeated rows and null ids keep their places, and each counts in
    the pairs. ``n_best`` counts links whose pair is the most frequent one of
    its right id, ties included. Pairs: a_id, b_id, total, best. Other columns
    are not read. Empty input gives two empty results.
    """
    spark = docs.sparkSession
    contents = [vocabulary(spark, p) for p in (left, right)]
    own = docs.select(F.col("doc_id").cast("bigint"), "text")
    segs = stage(own.mapInArrow(lambda it: _segments(it, contents[0].value, contents[1].value), SEGMENTS), "aligned", most_rows=SEGMENT_ROWS)
    met = segments.entries(segs, {"pairs": "pair", "counts": "count"})
    totals = met.groupBy("pair").agg(F.sum("count").alias("total"))
    totals = stage(totals.withColumn("b_id", F.shiftright("pair", 32)), "pair-totals")
    # at most a row per id of the right vocabulary
    most = totals.groupBy("b_id").agg(F.max("total").alias("most"))
    totals = totals.join(F.broadcast(most), "b_id").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    resolved = met.select("segment", "number", "pair").join(totals, "pair").select("segment", "number", "total", "best")
    whole = segments.with_resolved(segs.drop("pairs", "counts"), resolved, ["total", "best"])
    pairs = totals.select(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("a_id"), F.shiftright("pair", 32).cast("int").alias("b_id"), "total", "best")
    return whole.mapInArrow(_totals, OUT), pairs
