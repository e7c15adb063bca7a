"""Web archives in Zstandard frames with a dictionary of their own.

An archive is a skippable frame with the dictionary, then one frame per record,
so that any record can be read alone. The dictionary is built from records
spread over the archive. A payload that a later page repeats is stored once;
the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import shared_path, stage
from waymark.llm.files import opened, qualified

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3

MANIFEST = "archive string, records bigint, payload_bytes bigint, stored_bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def dictionary_of(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary trained on records spread evenly over all; of too few, their content itself."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    samples = [r[:131072] for r in records[::step] if r]
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def pack(records: list[bytes], level: int = LEVEL) -> bytes:
    """One archive: the dictionary in a skippable frame, then each record as a frame."""
    dictionary = dictionary_of(records)
    data = zstandard.ZstdCompressionDict(dictionary)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=data)
    return b"".join([struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary, *map(compressor.compress, records)])


def unpack_records(archive: pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, read as a stream."""
    magic, size = struct.unpack("<II", archive.read(8))
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary")
    data = zstandard.ZstdCompressionDict(archive.read(size))
    frames = zstandard.ZstdDecompressor(dict_data=data).stream_reader(archive, read_across_frames=True, read_size=1 << 20)
    held = b""

    def more() -> bytes:
        return frames.read(1 << 20)

    while True:
        while b"\r\n\r\n" not in held:
            got = more()
            if not got:
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
            held += got
        head, held = held.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(fields["content-length"])
        parts, have = [held], len(held)
        while have < length + 4:
            got = more()
            if not got:
                raise ValueError("an archive ends within a record")
            parts.append(got)
            have += len(got)
        held = b"".join(parts)
        yield fields, held[:length]
        held = held[length + 4:]


def _safe(url: str) -> str:
    """Blanks and control characters would break the header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or without payload a revisit that keeps the full length in its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", "WARC-Record-ID: " + RECORD_ID.format("none" if page_id is None else page_id), f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_safe(url)}")
    fields.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if payload is None:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", "WARC-Refers-To: " + RECORD_ID.format(refers_to)]
    block = http + (payload or b"")
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, length, digest, refers_to; a revisit has no payload.

    Equal payloads are those of one SHA-1 and length. Payloads shorter than
    ``least_bytes`` are all responses.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), body.alias("payload")).select(
        "*", F.octet_length("payload").cast("bigint").alias("length"), F.unhex(F.sha1("payload")).alias("digest"),
    )
    last = own.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(F.max("page_id").alias("keeper"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return own.join(last, ["digest", "length"], "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "length", "digest", F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    held, size, payload_bytes, number = [], 0, 0, 0

    def close() -> pa.RecordBatch:
        nonlocal held, size, payload_bytes, number
        data = pack(held)
        path = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:04d}.warc.zst"
        store, at = opened(path)
        with store.open_output_stream(at) as out:
            out.write(data)
        row = pa.RecordBatch.from_pylist([{"archive": path, "records": len(held), "payload_bytes": payload_bytes, "stored_bytes": len(data)}])
        held, size, payload_bytes, number = [], 0, 0, number + 1
        return row

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "length", "digest", "refers_to")]
        for i in range(batch.num_rows):
            page_id, url, payload, length, digest, refers_to = (c[i].as_py() for c in columns)
            held.append(record(page_id, url, payload, length, digest, refers_to, date))
            size, payload_bytes = size + len(held[-1]), payload_bytes + length
            if size >= archive_bytes:
                yield close()
    if held:
        yield close()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` (page_id, url, html) into ``folder``; returns the written manifest of archives.

    Of equal payloads the largest page_id is the response (all rows that carry
    it, if rows repeat); a null id is never preferred, and if all are null all
    are responses. Null html is an empty payload, a null url leaves the field
    out. A task that is run again writes other files; the manifest lists only
    those of the tasks that counted. An archive is at most ``archive_bytes``
    and one record in memory. Empty input gives an empty manifest.
    """
    folder = qualified(pages.sparkSession, folder) if folder else shared_path(pages.sparkSession, "warc")
    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    return stage(roles(pages, least_bytes).mapInArrow(lambda it: _write(it, folder, archive_bytes, date), MANIFEST), "warc-manifest")


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = opened(path)
            rows, size = [], 0
            with store.open_input_stream(at) as archive:
                for fields, block in unpack_records(archive):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path}: {fields['warc-record-id']} does not match its digest")
                    body = payload if payloads and kind == "response" else None
                    rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, length, digest, _page(fields.get("warc-refers-to")), body))
                    size += len(body or b"")
                    if len(rows) >= 10_000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives; each response is checked against its digest."""
    tasks = max(1, min(manifest.count(), 100_000))
    return manifest.select("archive").repartition(tasks, "archive").mapInArrow(lambda it: _read(it, payloads), RECORDS)
