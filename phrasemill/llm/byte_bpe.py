"""Byte-level BPE encoding and decoding by a global distinct-word shuffle (operator 5).

1. A block of documents (see `blocks`) splits its texts into pre-tokens, in
   order of position, and sends each distinct one to the word's bucket, once.
2. A bucket encodes every distinct word once for the whole corpus and answers
   the blocks with its ids.
3. A block joins the ids to its pre-tokens and puts them together by position.

Words travel in packed columns, one row per (block, bucket); no row per token
is ever shuffled, and a word that is everywhere is one entry per block.
Decoding joins ids with the token-byte table (the vocabulary: a file of fixed
size) and puts the bytes together by position.

Results: a null or empty text has no ids and decodes to no bytes; every row
comes back, equal rows each, null ids too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B

BLOCK_BYTES = 5 << 20
WORDS_PER_BUCKET = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}


_encoders: dict = {}


def _encoder(path: str):
    """Encodes one pre-token at a time: the pattern takes all of it as one piece."""
    if path not in _encoders:
        import tiktoken
        _encoders[path] = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path),
                                            special_tokens={}).encode_ordinary
    return _encoders[path]


class _Codes(dict):
    """Numbers distinct words in order of appearance."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


def _split(t: pa.Table, pattern: str):
    """Ids of a block's documents, its distinct pre-tokens, each document's pre-token numbers.

    The pattern never reaches from a visible character over a single space, so
    a text whose spaces stand alone is cut at them and each distinct stretch is
    matched once; other texts are matched whole."""
    import regex
    find, codes, heads, rest = regex.compile(pattern).findall, _Codes(), _Codes(), _Codes()
    ids, texts = B.open_block(t.column("data").to_pylist())
    cut = []
    for x in texts:
        parts = (x or "").split(" ")
        cut.append((heads[parts[0]], np.fromiter(map(rest.__getitem__, parts[1:]), np.int64, len(parts) - 1)))
    stretches = [*heads, *(" " + p for p in rest)]
    # a first stretch is clean if no blank is at its ends, a later one if just its own space is
    clean = np.array([bool(p) and not p[-1].isspace() and not p[p[0] == " "].isspace() for p in stretches], bool)
    clean[:len(heads)] &= np.array([not p[:1].isspace() for p in heads], bool)
    found, size = [], []
    for p in stretches:
        f = find(p)
        found += f
        size.append(len(f))
    size = np.array(size, np.int64)
    at, flat = np.cumsum(size) - size, np.fromiter(map(codes.__getitem__, found), np.int32, len(found))
    rows = []
    for x, (head, tail) in zip(texts, cut, strict=True):
        if not x:
            rows.append(np.zeros(0, np.int32))
        elif clean[head] and clean[tail + len(heads)].all():
            rows.append(B.gather(flat, at, size, np.concatenate(([head], tail + len(heads)))))
        else:
            rows.append(np.fromiter(map(codes.__getitem__, find(x)), np.int32))
    return ids, list(codes), rows


def _by_bucket(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by bucket and by text, and where buckets begin."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(buckets + 1, np.int64)
    column = pa.array(words, pa.string())
    order = pc.sort_indices(column).to_numpy()
    offset = np.frombuffer(column.buffers()[1], np.int32)[:len(words) + 1].astype(np.int64)
    a = np.frombuffer(column.buffers()[2], np.uint8)[:offset[-1]]
    size = np.diff(offset)
    place = np.arange(len(a), dtype=np.uint64) - np.repeat(offset[:-1], size).astype(np.uint64)
    h = B._mix(np.add.reduceat((a.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), offset[:-1]))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _words(pattern: str, buckets: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, words, _ = _split(t, pattern)
        order, cuts = _by_bucket(words, buckets)
        rows = [(i, key[0].as_py(), _put_strings([words[j] for j in order[lo:hi]]))
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        c = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({"bucket": pa.array(c[0], pa.int32()), "block": pa.array(c[1], pa.int32()),
                         "words": pa.array(c[2], pa.binary())})
    return run


def _put_strings(words: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    b = pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["w"])
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return B.squeeze_text(sink.getvalue().to_pybytes())


def _get_strings(data: bytes) -> list[str]:
    return pa.ipc.open_stream(B.unsqueeze(data)).read_all().column("w").to_pylist()


def _encode_words(path: str):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        encode, known = _encoder(path), {}
        size, ids = [], []
        for data in t.column("words").to_pylist():
            got = []
            for w in _get_strings(data):
                if w not in known:
                    known[w] = np.array(encode(w), "<u4").tobytes()
                got.append(known[w])
            size.append(B.put(np.array([len(x) // 4 for x in got], np.uint32)))
            ids.append(B.put(np.frombuffer(b"".join(got), "<u4")))
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"),
                         "size": pa.array(size, pa.binary()), "ids": pa.array(ids, pa.binary())})
    return run


def _assemble(pattern: str, buckets: int, table=None):
    """table: the token-byte table, to decode the ids in the same pass."""
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        doc_ids, words, rows = _split(docs, pattern)
        order, cuts = _by_bucket(words, buckets)
        size, parts = np.zeros(len(words), np.int64), []
        at = np.zeros(len(words), np.int64)
        base = 0
        for r in answers.to_pylist():
            mine = order[cuts[r["bucket"]]:cuts[r["bucket"] + 1]]
            n, ids = B.get(r["size"], np.uint32).astype(np.int64), B.get(r["ids"], np.uint32)
            size[mine], at[mine] = n, base + np.cumsum(n) - n
            parts.append(ids)
            base += len(ids)
        values = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
        ids = [B.gather(values, at, size, c) for c in rows]
        out = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
        if table is not None:
            tokens = table.value
            out["decoded"] = pa.array([B.gather(*tokens, x).tobytes() for x in ids], pa.binary())
        return pa.table(out)
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES, words_per_bucket: int = WORDS_PER_BUCKET, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): ids are little-endian unsigned 32-bit numbers.  With
    `decoded`, also the bytes that the ids decode to, from the same pass."""
    nb = B.block_count(docs, text_col, block_bytes)
    buckets = max(1, nb * block_bytes // (24 * words_per_bucket))
    by_block = B.pack_blocks(docs, id_col, text_col, nb, independent=True).groupBy("block")
    words = by_block.applyInArrow(_words(pattern, buckets), "bucket int, block int, words binary")
    answers = words.groupBy("bucket").applyInArrow(_encode_words(ranks_path),
                                                   "block int, bucket int, size binary, ids binary")
    table = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks_path)) if decoded else None
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _assemble(pattern, buckets, table), "doc_id long, ids binary" + ", decoded binary" * decoded)


def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: bytes, where each id's begin, how many it has (0: no such id)."""
    ranks = read_ranks(ranks_path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for b, r in ranks.items():
        size[r] = len(b)
    by_id = sorted(ranks.items(), key=lambda x: x[1])
    return np.frombuffer(b"".join(b for b, _ in by_id), np.uint8), np.cumsum(size) - size, size


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) and the bytes of each row's ids.  An id out of the table raises."""
    cols = keep or df.columns
    table = df.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, at, size = table.value
        for b in batches:
            ids = b.column(len(cols))
            got = [None if x is None else B.gather(values, at, size, np.frombuffer(x, "<u4")).tobytes()
                   for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(cols)], pa.array(got, pa.binary())], names=[*cols, out_col])

    schema = df.select(*cols).schema.add(out_col, "binary")
    return df.select(*cols, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
