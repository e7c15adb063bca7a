import base64
import hashlib
import struct

import pyarrow.fs
import zstandard

from waymark.llm import warc as W


def brute(rows, least=0):
    """(page_id, html) rows to what the archives must give back."""
    body = [(i, (t or "").encode()) for i, t in rows]
    last = {}
    for i, b in body:
        if i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in body:
        keeper = last.get(b) if len(b) >= least else None
        revisit = keeper is not None and i != keeper
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id % 3 = 0").selectExpr("page_id + 100000 AS page_id", "url", "html"))
    rows = [(r.page_id, r.html) for r in pages.collect()]
    manifest = W.write_archives(pages)
    back = W.read_archives(manifest)
    assert result(back) == brute(rows)
    html = dict(rows)
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in back.where("record_type = 'response'").collect())
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_records_stand_alone_behind_the_dictionary(spark, sf):
    manifest = W.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), archive_bytes=20_000)
    paths = [r.archive for r in manifest.collect()]
    assert len(paths) > 1
    store, at = W.opened(paths[0])
    with store.open_input_stream(at) as f:
        data = f.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    rest, n = data[8 + size:], 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    while rest:
        one = reader.decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = one.unused_data, n + 1
    assert n == [r.records for r in manifest.collect() if r.archive == paths[0]][0]


def test_odd_rows(spark):
    rows = [(1, "u", "same"), (2, "bad\r\nWARC-Type: x", "same"), (2, None, "same"), (None, "v", "same"), (None, None, None), (3, "w", None), (4, "w", ""), (None, "n", "lone"), (5, "long", "x" * 3_000_000), (6, "é", "ü\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string").repartition(1)
    back = W.read_archives(W.write_archives(pages, archive_bytes=1000))
    assert result(back) == brute([(i, t) for i, _, t in rows])
    assert {r.url for r in back.where("page_id = 6").collect()} == {"é"}
    assert {r.url for r in back.where("page_id = 2").collect()} == {None, "bad%0D%0AWARC-Type:%20x"}
    limited = W.read_archives(W.write_archives(pages, least_bytes=5))
    assert result(limited) == brute([(i, t) for i, _, t in rows], 5)
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0


def test_a_damaged_payload_is_noticed(spark):
    good = W.record(1, "u", b"abc", 3, hashlib.sha1(b"abd").digest(), None, "1970-01-01T00:00:00Z")
    path = W.shared_path(spark, "damaged")
    store, at = W.opened(path)
    with store.open_output_stream(at) as f:
        f.write(W.pack([good]))
    manifest = spark.createDataFrame([(path,)], "archive string")
    try:
        W.read_archives(manifest).collect()
        raise AssertionError("not noticed")
    except Exception as e:
        assert "does not match its digest" in str(e)
