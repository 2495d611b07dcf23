"""Packing documents into fixed windows (operator 2): bounded-space online best-fit.

Each partition streams its documents and keeps at most `open_windows` open.  A
document's full windows are cut off first; the rest goes into the open window
that it fills best.  When it fits none, the fullest one is topped up with the
head of the rest and emitted, so an emitted window holds no padding.  What is
still open at the end of a partition (at most `open_windows` windows) is merged
by the same rule in rounds of `fan_in` partitions; only the very last window of
the table is padded.

Pieces are written once to the folder in spark.checkpoint.dir, so the merging
rounds read only the open windows and nothing is tokenized twice.

Results: a null text has no ids but the end id.  Equal rows are packed each; a
null doc_id stays null.  An empty table has no pieces.  Every id lies in exactly
one piece; a sequence's pieces lie gapless from offset 0.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B
from phrasemill.llm import tables as T

CACHE_PIECES = 1_000_000
BATCH_BYTES = 8 << 20   # of text whose distinct words are looked up together
# plain words: ASCII and precomposed Latin letters, whose lower case and normal form don't depend on their neighbours
_LATIN = "\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[!-&(-~\u00c0-\u00d6\u00d8-\u00de{_LATIN}]+").fullmatch
_PIECES = re.compile(f"[a-z{_LATIN}]+|[0-9]|\n|[^a-z0-9{_LATIN}\n]+").findall
# byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
           ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
           ("part", pa.int64())]
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, open boolean, part long"


def _little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens(dict):
    """Ids of a batch of texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and nothing in it reaches across ASCII
    white space, so a word's ids don't depend on its neighbours: a batch's
    distinct words (told apart by a 64-bit hash) are tokenized once and their
    ids gathered by position.  Plain words go to the merges directly, in the
    pieces that the tokenizer's own split makes of them (this dict keeps the
    ids of pieces and is emptied when it is full); all others, and special
    tokens, go through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, models
        self.encode = Tokenizer.from_file(path).encode
        with open(path, encoding="utf-8") as f:
            m = json.load(f)["model"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        # the same merges without the library's own cache: each piece is merged once here
        self.merge = models.BPE(vocab=m["vocab"], merges=pairs, cache_capacity=0, end_of_word_suffix=m["end_of_word_suffix"]).tokenize

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > CACHE_PIECES:
            self.clear()
        w = B.Words(texts, lower=True)
        if b"<|" in w.raw:                      # special tokens are told apart by case
            w = B.Words(texts)
        first, word = B.distinct(w.hash)
        words = [w.raw[s:e].decode() for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        plain = [_PLAIN(x) is not None and "<|" not in x for x in words]
        ids, size = bytearray(), []
        done = 0
        for p in _PIECES("".join(x + "\n" for x, ok in zip(words, plain, strict=True) if ok).lower()):
            if p == "\n":
                size.append(len(ids) - done)
                done = len(ids)
            else:
                ids += self[p]
        for x, ok in zip(words, plain, strict=True):
            if not ok:
                own = self.encode(x, add_special_tokens=False).ids
                ids += _little_endian(own)
                size.append(4 * len(own))
        plain = np.array(plain, bool)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))   # words as their ids lie
        n, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        n[order] = np.array(size, np.int64) // 4
        at[order] = np.cumsum(n[order]) - n[order]
        out = B.gather(np.frombuffer(bytes(ids), "<u4"), at, n, word).tobytes()
        end = 4 * np.concatenate(([0], np.cumsum(n[word])))[w.first]
        return [out[lo:hi] for lo, hi in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]

    def __missing__(self, piece: str) -> bytes:
        level = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LEVEL)
        self[piece] = ids = _little_endian([t.id for t in self.merge(level)])
        return ids


class _Packer:
    """Open windows of one partition; full ones go to `rows`."""

    def __init__(self, window: int, keep: int, first_id: int, part: int):
        self.window, self.keep, self.next, self.part = window, keep, first_id, part
        self.open, self.rows = [], []   # open: [free, pieces]

    def emit(self, pieces: list, still_open: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, total, ids, self.next, at, still_open, self.part))
            at += n
        self.next += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        w = self.window
        n, lo = len(ids) // 4, 0
        while n - lo >= w:
            self.emit([(doc_id, start + lo, ids[4 * lo:4 * (lo + w)], total)])
            lo += w
        while lo < n:
            r = n - lo
            best = min((o for o in self.open if o[0] >= r), key=lambda o: o[0], default=None)
            if best is None and len(self.open) < self.keep:
                best = [w, []]
                self.open.append(best)
            if best is None:            # the fullest takes the head and goes
                best = min(self.open, key=lambda o: o[0])
                r = best[0]
            best[1].append((doc_id, start + lo, ids[4 * lo:4 * (lo + r)], total))
            best[0] -= r
            lo += r
            if not best[0]:
                self.open.remove(best)
                self.emit(best[1])

    def close(self, still_open: bool) -> None:
        for _, pieces in self.open:
            self.emit(pieces, still_open)
        self.open = []

    def drain(self) -> pa.Table:
        c = list(zip(*self.rows, strict=True)) or [[]] * len(_FIELDS)
        self.rows = []
        return pa.table([pa.array(x, t) for x, (_, t) in zip(c, _FIELDS, strict=True)], names=[f for f, _ in _FIELDS])


def _pack(path: str, end_id: int, window: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        tokens, packer = WordTokens(path), _Packer(window, keep, part << 32, part)
        for b in B.small_batches(batches, 1, BATCH_BYTES):
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens(b.column(1).to_pylist()), strict=True):
                ids += end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(packer.rows) >= 1000:
                    yield from packer.drain().to_batches()
        packer.close(True)
        yield from packer.drain().to_batches()
    return run


def _merge(window: int, keep: int, level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = _Packer(window, 1 if last else keep, (level << 56) | (group << 24), group)
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for r in t.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        packer.close(not last)
        return packer.drain()
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 4096, open_windows: int = 48, fan_in: int = 16) -> DataFrame:
    """One row per piece: (doc_id, start, length, doc_tokens, ids, sequence_id,
    offset); ids are little-endian unsigned 32-bit numbers."""
    out = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = T.write_shared(src.mapInArrow(_pack(tokenizer_path, end_id, window, open_windows), _SCHEMA), "packed")
    done = pieces.filter("not open").select(*out)
    left = pieces.filter("open")
    parts = (left.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    level = 1
    while parts:
        parts = -(-parts // fan_in)
        merged = left.groupBy(F.floor(F.col("part") / fan_in).alias("g")).applyInArrow(
            _merge(window, open_windows, level, parts == 1), _SCHEMA)
        merged = T.write_shared(merged, "merged")
        done = done.unionByName(merged.filter("not open").select(*out))
        left, level = merged.filter("open"), level + 1
        if parts == 1:
            break
    return done
