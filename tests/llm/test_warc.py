"""WARC archives: exact round trips, literal types, and files that other tools read."""

import base64
import gzip
import hashlib
import random

import pytest
from pyarrow import fs as pafs

from phrasemill.llm import queries as Q
from phrasemill.llm import tables as T
from phrasemill.llm import warc

PAGES = [(1, "http://a/x y", "<p>same</p>"), (2, "http://b\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d", ""), (5, "http://é", "日本 😀\r\n\r\nWARC/1.1\r\n"),
         (6, "http://f", "x" * 300_000), (None, "http://n", "<p>same</p>"), (None, "u", "only null ids"), (-7, "http://g", "neg"), (8, "http://h", "neg"),
         (9, "http://i", "one"), (9, "http://i", "one"), (10, "http://j", "one")]


def _want(rows, min_bytes=0):
    low = {}
    for i, _, t in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        first = low.get(t or "")
        again = len(raw) >= min_bytes and first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select(warc.page_of("record_id"), "payload_bytes", "payload_digest", "record_type",
                                               warc.page_of("refers_to")).collect()), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, archive string, offset int").repartition(3)


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in T.read(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in Q.op11_warc(spark, sf_dir).collect()), key=str) == _want(rows)


@pytest.mark.parametrize("file_bytes,min_bytes", [(1, 0), (1000, 4), (64 << 20, 0)])
def test_odd_rows_and_round_trip(spark, file_bytes, min_bytes):
    rows = PAGES + [(100 + i, f"http://p/{i}", "often" if i % 3 == 0 else f"page {i} " * (i % 9)) for i in range(120)]
    whole = warc.write(_frame(spark, rows), min_bytes=min_bytes, file_bytes=file_bytes)
    own = warc.normalise(whole)
    got = warc.read(own)
    assert _rows(got) == _want(rows, min_bytes)
    text = {(i, t or "") for i, _, t in rows}
    assert {(r.page, bytes(r.payload).decode()) for r in got.filter("record_type = 'response'").select(
        warc.page_of("record_id").alias("page"), "payload").collect()} <= text
    assert got.filter("record_type = 'revisit' and payload is not null").isEmpty()
    # one gzip stream before; after it each record inflates by itself from its offset
    for r in whole.collect():
        fs, path = pafs.FileSystem.from_uri(r.archive)
        raw = fs.open_input_stream(path, compression=None).read()
        assert raw.count(b"\x1f\x8b\x08") >= 1 and len(gzip.decompress(raw)) > 0 and len(raw) == r.bytes
    for r in got.collect():
        fs, path = pafs.FileSystem.from_uri(r.archive)
        member = fs.open_input_stream(path, compression=None).read()[r.offset:r.offset + r.length]
        record = gzip.decompress(member)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(f"WARC-Record-ID: {r.record_id}".encode()) == 1
    assert whole.agg({"records": "sum"}).first()[0] == own.agg({"records": "sum"}).first()[0]


def test_folders_urls_and_empty_tables(spark, tmp_path):
    whole = warc.write(_frame(spark, PAGES), folder=f"file://{tmp_path}/whole")
    got = warc.read(warc.normalise(whole, folder=f"{tmp_path}/own")).collect()
    uri = {r.record_id: r.target_uri for r in got}
    assert uri["<urn:page:1>"] == "http://a/x%20y" and uri["<urn:page:2>"] == "http://b%0D%0AX:%20y" and uri["<urn:page:3>"] == "urn:page:3"
    assert len(list((tmp_path / "own").glob("*.idx"))) == len(list((tmp_path / "whole").glob("*.warc.gz")))
    assert warc.read(warc.normalise(warc.write(_frame(spark, [])))).count() == 0


def test_stream_of_any_pieces():
    """The inflater and the reader give the same records for one member or many, however the bytes arrive."""
    r = random.Random(1)
    records = [warc.page_record(i, f"u{i}", r.randbytes(r.randint(0, 5000)), None, False, "d") for i in range(30)]
    one, many = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for data in (one, many):
        for step in (1, 7, 1000, len(data)):
            pieces = (data[i:i + step] for i in range(0, len(data), step))
            assert [w for _, _, w in warc.records_of(warc.inflate(pieces))] == records
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(warc.inflate(iter([one[:len(one) // 2]]))))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.records_of(iter([b"junk\r\n\r\n"])))
    big = gzip.compress(bytes(50_000_000))
    assert max(map(len, warc.inflate(iter([big])))) <= warc.READ_BYTES


def test_changed_payload_raises(spark, tmp_path):
    own = warc.normalise(warc.write(_frame(spark, PAGES[:1])), folder=str(tmp_path))
    r = own.first()
    record = bytearray(gzip.decompress(open(r.archive.removeprefix("file://"), "rb").read()))
    at = record.find(b"<p>same")
    record[at] = ord("!")
    z = gzip.compress(bytes(record[record.find(b"WARC/1.1", 10):]))
    open(r.archive.removeprefix("file://"), "wb").write(z)
    open(r.sidecar.removeprefix("file://"), "w").write(f"0 {len(z)} response <urn:page:1>\n")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(own).collect()
