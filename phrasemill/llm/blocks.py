"""Blocks of documents, and compact number columns, for operators that exchange
far more small items (n-grams, tokens) than documents.

A document's block is a hash of its id (of id and text where rows are
independent), so a block has the same documents no matter which task packs it,
in which order rows arrive, or whether a lost task runs again.  One row of the packed table holds what one Arrow batch has for one
block: ids and whole texts, zstd-compressed.  `open_block` puts the rows of a
block together in (id, text) order.

Nulls: a null id sorts before all others and is kept; a null text stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
_CODEC = pa.Codec("zstd", compression_level=1)
_TEXT_CODEC = pa.Codec("zstd", compression_level=3)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def squeeze_text(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _TEXT_CODEC.compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], decompressed_size=n, asbytes=True) if n else b""


def put(a: np.ndarray) -> bytes:
    """Numbers as byte planes, zstd-compressed: planes that hardly change cost next to nothing."""
    a = np.ascontiguousarray(a)
    return squeeze(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def get(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def block_count(docs: DataFrame, text: str, target: int = BLOCK_BYTES) -> int:
    """Blocks of about `target` bytes of text: one aggregate over the table."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / target))


def block_of(id_col: Column, blocks: int, *more: Column) -> Column:
    return F.pmod(F.xxhash64(id_col.cast("long"), *more), F.lit(blocks)).cast("int")


def _pack(block_numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_numbers(batch.column(0))
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            keys, out = [], []
            for rows in np.split(order, cuts) if len(order) else []:
                part = batch.take(pa.array(rows))
                sink = pa.BufferOutputStream()
                own = pa.RecordBatch.from_arrays(part.columns[1:3], names=["id", "text"])
                with pa.ipc.new_stream(sink, own.schema) as w:
                    w.write_batch(own)
                keys.append(int(block[rows[0]]))
                out.append(squeeze_text(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())],
                                             names=["block", "data"])
    return run


def _as_numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, blocks: int, independent: bool = False) -> DataFrame:
    """(block int, data binary); read with `open_block`.  If rows are independent, the different texts of one id
    (or of null ids) go to different blocks."""
    more = [F.col(text_col).cast("string")] if independent else []
    return docs.select(block_of(F.col(id_col), blocks, *more).alias("block"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(_pack(_as_numbers), "block int, data binary")


def id_bounds(docs: DataFrame, id_col: str, blocks: int) -> np.ndarray:
    """Ids (of the table) that cut it into about `blocks` ranges, ascending; all ids below the second are in range 0.
    No range is empty: the smallest id is no cut."""
    share = [i / blocks for i in range(1, blocks)]
    if not share:
        return np.zeros(1, np.int64)
    i = F.col(id_col).cast("long")
    got = docs.agg(F.percentile_approx(i, share, max(10_000, 20 * blocks)).alias("q"), F.min(i).alias("low")).first()
    return np.concatenate(([0], np.unique(np.array([q for q in got["q"] or [] if q > got["low"]], np.int64))))


def pack_ranges(docs: DataFrame, id_col: str, text_col: str, bounds: np.ndarray) -> DataFrame:
    """As `pack_blocks`, a block being a range of ids between bounds; null ids are in range 0."""
    def locate(ids: pa.Array) -> np.ndarray:
        low = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return np.searchsorted(bounds[1:], low, side="right")

    return docs.select(F.col(id_col).cast("long").alias("key"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(_pack(locate), "block int, data binary")


def open_block(datas: list[bytes]) -> tuple[list[int | None], list[str | None]]:
    """Ids and texts of a block, in (id, text) order, nulls first."""
    if not datas:
        return [], []
    parts = [pa.ipc.open_stream(unsqueeze(d)).read_all() for d in datas]
    t = pa.concat_tables(parts).combine_chunks()
    ids, texts = t.column("id").to_pylist(), t.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    return [ids[i] for i in order], [texts[i] for i in order]


# ---------------------------------------------------------------- words
def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of many texts, as arrays.

    raw: the UTF-8 bytes of all texts, one line feed after each; start/end: byte
    range of each word; doc: index of its text; offset: first byte of each text; first: index of each text's
    first word (length n_docs + 1); hash: 64-bit hash of the word's bytes."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        enc = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(enc) + b"\n"
        self.raw = raw.lower() if lower else raw
        a = np.frombuffer(self.raw, np.uint8)
        solid = ~_WHITE[a]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        offset = np.cumsum([0] + [len(e) + 1 for e in enc])
        self.first = np.searchsorted(self.start, offset)
        self.doc = np.repeat(np.arange(len(enc)), np.diff(self.first))
        self.offset = offset

    @property
    def hash(self) -> np.ndarray:
        """Eight bytes at a time: all words' first eight, then the next of the longer ones."""
        size = self.end - self.start
        eight = np.ndarray(len(self.raw), "<u8", self.raw + bytes(8), strides=(1,))
        h = _mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        at, left = np.arange(len(size)), size
        done = 0
        while len(at):
            v = eight[self.start[at] + done]
            short = left < 8
            v[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[at] = _mix(h[at] ^ v) * np.uint64(0x9FB21C651E98DF25)
            done += 8
            more = left > 8
            at, left = at[more], left[more] - 8
        return _mix(h)

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo..hi joined by one space."""
        return b" ".join(self.raw[self.start[lo]:self.end[hi - 1]].split()) if hi > lo else b""


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (ignoring where texts end)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p = _powers(n, 0xD1342543DE82EF95)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g += h[j:j + m] * p[j]
    return _mix(g)


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct value, and the number of each row's value (values ascending)."""
    o = np.argsort(g)
    s = g[o]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    inv = np.empty(len(s), np.int64)
    inv[o] = np.cumsum(head) - 1
    return np.minimum.reduceat(o, np.flatnonzero(head)) if len(s) else o, inv


def small_batches(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text (at least one row each)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.binary_length(b.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(lo, hi - lo)


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The ragged rows `pick` of values, one after another; row i is values[at[i]:at[i] + size[i]]."""
    n = size[pick]
    begin = np.cumsum(n) - n
    return values[np.arange(int(n.sum())) - np.repeat(begin - at[pick], n)]
