"""Token ids in binary files, Simple-8b coded.

Texts are encoded where they lie, and only coded ids are put in order. A file is
the words of its documents, one after another, then a footer: ids and lengths of
the documents, and per block the offset of its words and how many of its
numbers are escaped. So any document can be decoded alone, and many at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from waymark.llm import simple8b
from waymark.llm.common import shared_path, stage, text_batches
from waymark.llm.files import opened, qualified
from waymark.llm.tokens import FOLDER, Chunks, Ragged, bpe, once, vocabulary

VOCABULARY = f"{FOLDER}/word_bpe_49k.json"
END_ID = 1
BATCH_BYTES = 4 << 20
#: A file is closed once it has this many bytes of words; the reader decodes about GROUP_BYTES at a time.
FILE_BYTES = 64 << 20
GROUP_BYTES = 8 << 20

#: Chunks that a worker keeps the ids of.
MOST_CHUNKS = 1 << 20
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A sign of one id, which only it has; chunks are encoded this many at a time.
MARK, TOGETHER = "\u2605", 64

# Fixed values of the format: begin and end of a file; documents, blocks and words before the end.
MAGIC = b"S8BTOK1\n"
TAIL = struct.Struct("<QQQ8s")

CODED = "bucket bigint, doc_id bigint, tie bigint, n_tokens bigint, words binary, sizes binary, escapes binary"
MANIFEST = "file string, bucket bigint, number int, documents bigint, ids bigint, stored_bytes bigint"
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Encoder:
    """Ids of texts, with the end id after each.

    The vocabulary drops white space and knows no capitals, so chunks end at
    blanks and line feeds and A-Z are folded. Texts that may hold the string
    of a special token are read as they are. New chunks are encoded many at a
    time, with a sign between them that has an id of its own.
    """

    def __init__(self, content: bytes, end_id: int | None, most: int = MOST_CHUNKS) -> None:
        self.tokenizer, self.end_id, self.most = bpe(content), end_id, most
        own = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = own[0] if len(own) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids = Chunks(self._learn, self.most), Ragged()
        if self.end_id is not None:
            # no chunk has a blank in it
            self.known[" "] = 0
            self.ids.add([self.end_id], [1])

    def _learn(self, parts: list[str]) -> None:
        if self.mark is None or any(MARK in p for p in parts):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            self.ids.add([i for ids in found for i in ids], [len(ids) for ids in found])
            return
        between = f" {MARK} "
        joined = [between.join(parts[i:i + TOGETHER]) + between for i in range(0, len(parts), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        self.ids.add(ids[ids != self.mark], np.diff(marks, prepend=-1) - 1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.known.full:
            self._clear()
        parts, held = [], []
        for text in texts:
            if b"<|" not in text:
                text = text.translate(FOLD)
            own = text.decode("utf-8", "replace").replace("\n", " ").split(" ")
            if self.end_id is not None:
                own.append(" ")
            parts += own
            held.append(len(own))
        ids, lengths = self.ids.take(self.known.numbers(parts))
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(held, dtype=np.int64)))]
        return ids, np.diff(upto)


def bounds(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """Ids that cut those of ``docs`` into about equal parts, and how many of the buckets the null ids need besides. Only the ids are read."""
    ranks = [i / buckets for i in range(1, buckets)]
    ids = F.col("doc_id").cast("bigint")
    found = docs.select(F.percentile_approx(ids, F.array(*map(F.lit, ranks)), F.lit(100 * buckets)).alias("cuts"), F.count(F.lit(1)).alias("rows"), F.count(ids).alias("with_id")).collect()[0]
    return np.array(found["cuts"] or [], np.int64), max(1, round(buckets * (found["rows"] - found["with_id"]) / max(1, found["rows"])))


def _bucket(doc_ids: pa.Array, ties: np.ndarray, cuts: np.ndarray, null_buckets: int) -> np.ndarray:
    """Bucket of each row, rising with the id. An id that fills several buckets, and the null ids, are dealt over theirs by the text's digest."""
    ids = np.asarray(doc_ids.fill_null(0), np.int64)
    first, last = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    none = np.asarray(doc_ids.is_null())
    first, many = np.where(none, len(cuts) + 1, first), np.where(none, null_buckets, np.maximum(1, last - first))
    share = (ties.astype(np.float64) / 2.0**64 + 0.5) * many
    return first + np.minimum(share.astype(np.int64), many - 1)


def _coded(batches: Iterator[pa.RecordBatch], content: bytes, end_id: int | None, cuts: np.ndarray, null_buckets: int) -> Iterator[pa.RecordBatch]:
    encoder = once(f"ids-{end_id}", content, lambda data: Encoder(data, end_id))
    for rows, texts in text_batches(batches, "text", BATCH_BYTES):
        ids, lengths = encoder.encode(texts)
        words, size, escapes = simple8b.encode(ids, lengths)
        blocks = np.concatenate(([0], np.cumsum(-(-lengths // simple8b.BLOCK))))
        upto = np.concatenate(([0], np.cumsum(size)))[blocks]
        words, size, escapes = words.astype("<u8"), size.astype("<u2"), escapes.astype("<u2")
        lists = [[words[upto[i]:upto[i + 1]].tobytes() for i in range(len(texts))], *([x[blocks[i]:blocks[i + 1]].tobytes() for i in range(len(texts))] for x in (size, escapes))]
        doc_ids, ties = rows["doc_id"].combine_chunks(), rows["tie"].combine_chunks()
        bucket = _bucket(doc_ids, np.asarray(ties), cuts, null_buckets)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), doc_ids, ties, pa.array(lengths), *(pa.array(x, pa.binary()) for x in lists)], ["bucket", "doc_id", "tie", "n_tokens", "words", "sizes", "escapes"])


class _Open:
    """A file being written: words go out at once, the footer is held."""

    def __init__(self, path: str, bucket: int, number: int) -> None:
        store, at = opened(path)
        self.path, self.bucket, self.number, self.out = path, bucket, number, store.open_output_stream(at)
        self.out.write(MAGIC)
        self.docs, self.lengths, self.sizes, self.escapes, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, n_tokens: int, words: bytes, sizes: bytes, escapes: bytes) -> None:
        self.out.write(words)
        self.docs.append(doc_id)
        self.lengths.append(n_tokens)
        self.sizes.append(sizes)
        self.escapes.append(escapes)
        self.size += len(words)

    def close(self) -> pa.RecordBatch:
        sizes = np.frombuffer(b"".join(self.sizes), "<u2")
        footer = [
            np.array([d is None for d in self.docs], "<u1"), np.array([d or 0 for d in self.docs], "<i8"), np.array(self.lengths, "<i8"),
            np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype("<i8"), np.frombuffer(b"".join(self.escapes), "<u2"),
        ]
        for part in footer:
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(len(self.docs), len(sizes), self.size // 8, MAGIC))
        self.out.close()
        stored = len(MAGIC) + self.size + sum(p.nbytes for p in footer) + TAIL.size
        values = [self.path, self.bucket, self.number, len(self.docs), sum(self.lengths), stored]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3])], ["file", "bucket", "number", "documents", "ids", "stored_bytes"])


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Files of rows in order; a bucket's files are numbered in order."""
    context, number, now = TaskContext.get(), 0, None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "doc_id", "n_tokens", "words", "sizes", "escapes")]
        for i in range(batch.num_rows):
            bucket, doc_id, n_tokens, words, sizes, escapes = (c[i].as_py() for c in columns)
            if now is not None and (now.bucket != bucket or now.size >= file_bytes):
                yield now.close()
                number, now = number + 1, None
            if now is None:
                now = _Open(f"{folder}/part-{bucket:06d}-{number:04d}-{context.taskAttemptId()}.tok", bucket, number)
            now.add(doc_id, n_tokens, words, sizes, escapes)
    if now is not None:
        yield now.close()


def write_tokens(docs: DataFrame, path: str = VOCABULARY, end_id: int | None = END_ID, folder: str | None = None, file_bytes: int = FILE_BYTES, buckets: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ascending order of doc_id; returns the written manifest.

    Whole texts are encoded, without added special tokens, and end with
    ``end_id`` (None: with nothing). A null or empty text has the end id alone.
    Null ids come last; rows of one id stand by a digest of their text, equal
    rows next to each other. Other columns are not read. ``folder`` is a shared
    one. Ids are dealt to ``buckets`` of about equal rows (by default twice the
    shuffle partitions), each of which fills files of its own. A task that is run again writes other files; the manifest lists those
    of the tasks that counted, and where in the order each begins. Empty input
    gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else shared_path(spark, "tokens")
    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    content = vocabulary(spark, path)
    cuts, null_buckets = bounds(docs, buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("tie"))
    coded = own.mapInArrow(lambda it: _coded(it, content.value, end_id, cuts, null_buckets), CODED)
    ordered = coded.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "tie")
    return stage(ordered.mapInArrow(lambda it: _write(it, folder, file_bytes), MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, at = opened(path)
            with store.open_input_file(at) as f:
                f.seek(f.size() - TAIL.size)
                documents, blocks, words, magic = TAIL.unpack(f.read(TAIL.size))
                kinds = [("<u1", documents), ("<i8", documents), ("<i8", documents), ("<i8", blocks + 1), ("<u2", blocks)]
                f.seek(len(MAGIC) + 8 * words)
                no_id, doc_ids, lengths, offsets, escapes = (np.frombuffer(f.read(np.dtype(t).itemsize * n), t) for t, n in kinds)
                f.seek(0)
                if magic != MAGIC or f.read(len(MAGIC)) != MAGIC or offsets[-1] != words:
                    raise ValueError(f"{path} is not a whole file of token ids")
                starts = start + np.cumsum(lengths) - lengths
                upto = np.concatenate(([0], np.cumsum(-(-lengths // simple8b.BLOCK))))
                first, last = simple8b.block_bounds(lengths)
                begin = 0
                while begin < documents:
                    # a run of documents of about GROUP_BYTES, one at least
                    end = max(begin + 1, int(np.searchsorted(offsets[upto], offsets[upto[begin]] + GROUP_BYTES // 8, side="right")) - 1)
                    b, e = upto[begin], upto[end]
                    data = np.frombuffer(f.read(8 * int(offsets[e] - offsets[b])), "<u8")
                    ids = simple8b.decode(data, np.diff(offsets[b:e + 1]), escapes[b:e], (last - first)[b:e]).astype("<u4")
                    bounds = np.concatenate(([0], np.cumsum(lengths[begin:end])))
                    crc = [zlib.crc32(ids[bounds[i]:bounds[i + 1]].tobytes()) for i in range(end - begin)]
                    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(end - begin, ROWS.field("ids").type)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[begin:end], mask=no_id[begin:end] == 1), pa.array(starts[begin:end]), pa.array(lengths[begin:end]), pa.array(crc, pa.int64()), listed], schema=ROWS)
                    begin = end


def read_tokens(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Documents of the manifest's files: doc_id, start, n_tokens, ids_crc32, and their ids if asked for.

    ``start`` counts the ids of all documents before. Only the manifest, a row
    per file, is put in order for it.
    """
    before = Window.orderBy("bucket", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = stage(manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")), "token-starts")
    tasks = max(1, min(files.count(), 100_000))
    return files.repartition(tasks, "file").mapInArrow(lambda it: _read(it, ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
