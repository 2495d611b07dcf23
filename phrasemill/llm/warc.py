"""WARC archives (operator 11): monolithic gzip normaliser with a sidecar offset index.

`write` makes archives as many crawlers leave them: each file one gzip stream
over all its records.  `normalise` inflates every such file once, as a stream,
rewrites each record as a gzip member of its own, and writes a sidecar beside
the new file: one line a record with its offset and length.  `read` goes by
the sidecar: it seeks to a record, inflates that member alone and checks its
payload digest.

Files lie in a folder that all machines see; names hold an attempt's own random
part, and only the names that a successful task returned are in the manifest
(a written table), so a lost or repeated task leaves no half file in it.  A
task handles records one after another and holds one record at a time.

Records of equal payloads (told by SHA-256) of at least `min_bytes` bytes: that
with the smallest page_id is the response, the others are revisits of it, whose
block is the HTTP head alone.  The smallest ids come from a partial aggregate
of the digests; the table of repeated digests is broadcast if its measured size
allows.

Results: a null html is an empty payload; a null page_id is never the smallest
unless all are null (all are responses then); rows that repeat the response's
page_id and payload are responses too.  Blanks and control characters of a url
are percent-encoded, a null url is named by the page.  An empty table gives no
records.  Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import tables as T
from phrasemill.session import ensure_checkpoint_dir, maybe_broadcast

FILE_BYTES = 64 << 20       # of payload in one archive
READ_BYTES = 1 << 20
ROWS = 500
_GZIP = 31                  # zlib's window bits for a gzip stream
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = [("archive", pa.string()), ("sidecar", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
_RECORD = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
           ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
           ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
_SQL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(fields) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in fields)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


# ---------------------------------------------------------------- one record
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or f"urn:page:{'' if page_id is None else page_id}")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
            ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(head, http if revisit else http + payload)


def _fields(head: bytes) -> dict[str, str]:
    """Fields of a record's or an HTTP head; names in lower case."""
    out = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records_of(chunks: Iterator[bytes], name: str = "") -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, block, the record's bytes) from the bytes of an inflated archive."""
    have = bytearray()

    def more(n: int, until: bytes = b"") -> int:
        """Reads on until n bytes are there, or `until` is found (its place)."""
        looked = 0
        while True:
            if until and (at := have.find(until, looked)) >= 0:
                return at
            if not until and len(have) >= n:
                return n
            looked = max(len(have) - len(until), 0)
            got = next(chunks, b"")
            if not got:
                if until and not have.strip():
                    return -1
                raise ValueError(f"{name}: the archive ends within a record")
            have.extend(got)

    while True:
        at = more(0, b"\r\n\r\n")
        if at < 0:
            return
        head = bytes(have[:at])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record begins with {head[:20]!r}")
        fields = _fields(head)
        size = int(fields["content-length"])
        end = at + 4 + size + 4
        more(end)
        whole = bytes(have[:end])
        del have[:end]
        yield fields, whole[at + 4:at + 4 + size], whole


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or of several, in pieces of bounded size."""
    z = zlib.decompressobj(_GZIP)
    for data in chunks:
        while data:
            if z.eof:
                z = zlib.decompressobj(_GZIP)
            out = z.decompress(data, READ_BYTES)
            if out:
                yield out
            data = z.unused_data if z.eof else z.unconsumed_tail
    while not z.eof and (out := z.decompress(z.unconsumed_tail, READ_BYTES)):
        yield out


def _read_on(stream) -> Iterator[bytes]:
    while data := stream.read(READ_BYTES):
        yield data


# ---------------------------------------------------------------- write
def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first, revisit)."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256)
    first = (src.filter(F.octet_length("payload") >= min_bytes).select("page_id", digest.alias("digest")).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    first = T.write_shared(first, "repeated-payloads")
    keyed = src.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, digest))
    joined = keyed.join(maybe_broadcast(first, ["digest"])[0], "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "first", revisit.alias("revisit"))


class _Archive:
    """An archive that a task writes; whole: all records in one gzip stream."""

    def __init__(self, folder: str, whole: bool, level: int):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self.path, self.whole, self.level = f"{path}/{self.name}", whole, level
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.z = zlib.compressobj(level, wbits=_GZIP) if whole else None
        self.records = self.at = self.payload = 0
        self.index = []

    def add(self, record: bytes, fields: dict[str, str] | None = None) -> None:
        if self.whole:
            data = self.z.compress(record)
        else:
            z = zlib.compressobj(self.level, wbits=_GZIP)
            data = z.compress(record) + z.flush()
            self.index.append(f"{self.at} {len(data)} {fields.get('warc-type', '')} {fields.get('warc-record-id', '')}\n")
        self.out.write(data)
        self.at += len(data)
        self.records += 1
        self.payload += len(record)

    def close(self, folder: str) -> tuple:
        if self.whole:
            data = self.z.flush()
            self.out.write(data)
            self.at += len(data)
        self.out.close()
        sidecar = None
        if not self.whole:
            with self.fs.open_output_stream(self.path + ".idx", compression=None) as f:
                f.write("".join(self.index).encode("utf-8", "surrogatepass"))
            sidecar = f"{folder}/{self.name}.idx"
        return f"{folder}/{self.name}", sidecar, self.records, self.at


def _new_folder(df: DataFrame, folder: str | None, kind: str) -> str:
    path = folder or f"{ensure_checkpoint_dir(df.sparkSession)}/llm-tables/{kind}-{uuid.uuid4().hex}"
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:"):]
    return path


def _make(folder: str) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES,
          date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Monolithic archives of a table of pages (page_id, url, html); the manifest (archive, sidecar, records, bytes)."""
    folder = _new_folder(pages, folder, "warc-whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _make(folder)
        archive, done = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                if archive is None:
                    archive = _Archive(folder, True, level)
                    archive.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                         ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                archive.add(page_record(*row, date))
                if archive.payload >= file_bytes:
                    done.append(archive.close(folder))
                    archive = None
        if archive is not None:
            done.append(archive.close(folder))
        yield _batch(done, _MANIFEST)

    return T.write_shared(with_types(pages, min_bytes).mapInArrow(run, _ddl(_MANIFEST)), "manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """About one archive a task."""
    return manifest.repartition(max(1, manifest.count()), "archive")


def normalise(manifest: DataFrame, folder: str | None = None, level: int = 4) -> DataFrame:
    """Every archive inflated once and rewritten, a gzip member a record, with a sidecar; the new manifest."""
    folder = _new_folder(manifest, folder, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _make(folder)
        for b in batches:
            done = []
            for name in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(name)
                out = _Archive(folder, False, level)
                with fs.open_input_stream(path, compression=None) as f:
                    for fields, _, record in records_of(inflate(_read_on(f)), name):
                        out.add(record, fields)
                done.append(out.close(folder))
            yield _batch(done, _MANIFEST)

    return T.write_shared(_dealt(manifest.select("archive")).mapInArrow(run, _ddl(_MANIFEST)), "manifest")


def read_record(f, offset: int, length: int, name: str = "") -> tuple[dict[str, str], bytes]:
    """(fields, block) of the record at an offset of an open archive; that member alone is inflated."""
    f.seek(offset)
    got = list(records_of(inflate(iter([f.read(length)])), name))
    if len(got) != 1:
        raise ValueError(f"{name}: {len(got)} records at {offset}")
    return got[0][:2]


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Responses and revisits of normalised archives, by their sidecars: (archive, offset, length, record_id,
    record_type, target_uri, refers_to, payload_digest, payload_bytes, payload); payload is null for revisits, and for
    all if not asked for.  A response whose payload has another digest or length raises."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(pafs.FileSystem.from_uri(sidecar)[1], compression=None) as f:
                    entries = f.read().decode("utf-8", "surrogatepass").splitlines()
                rows, size = [], 0
                with fs.open_input_file(path) as f:
                    for line in entries:
                        offset, length, kind, rid = line.split(" ", 3)
                        if kind not in ("response", "revisit"):
                            continue
                        fields, block = read_record(f, int(offset), int(length), name)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n = int(_fields(head)["content-length"])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload), payload_digest(payload)) != (n, digest):
                            raise ValueError(f"{name}: payload of {rid} differs from its digest")
                        keep = payload if payloads and kind == "response" else None
                        rows.append((name, int(offset), int(length), rid, kind, fields.get("warc-target-uri"),
                                     fields.get("warc-refers-to"), digest, n, keep))
                        size += len(keep or b"")
                        if len(rows) >= ROWS or size >= READ_BYTES:
                            yield _batch(rows, _RECORD)
                            rows, size = [], 0
                yield _batch(rows, _RECORD)

    return _dealt(manifest.select("archive", "sidecar")).mapInArrow(run, _ddl(_RECORD))


def page_of(column: str):
    """The page_id in a record id."""
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
