"""Cross-tokenizer alignment (operator 12): lockstep vectorised merging.

Two tokenizers cut one text: A a byte-level BPE over space + text, B a piece
BPE over the text (it adds the space itself).  Both give tokens whose bytes
join to space + text, so their byte ranges can be merged like two sorted lists.

1. A task takes documents in blocks of bounded bytes, as they are read; no text
   is shuffled.  All documents of a block are merged at once: one state vector
   holds every lane's place in A and in B.  A step links the two tokens of each
   lane, moves on where a token ends (both, at a cut), and drops lanes that are
   done.  A lane is a document or, of a long one, a run of `LANE` A tokens, so
   the number of steps is bounded whatever a document's length.
2. A block keeps one number a link, from which ids and steps follow, and its
   distinct id pairs with their counts.  Counts are summed over the corpus by
   Spark; the highest count of each B id is a table of at most B's vocabulary.
3. The pairs' counts go to the blocks, which sum them over their documents'
   links: by broadcast if their measured size allows, otherwise each block's
   distinct pairs are joined to the counts and brought back to the block.

Results: a text that is null, empty or whose joined token bytes (of A or of B)
differ from space + text has no tokens: zeros and no groups.  Equal rows are
aligned each and all counted; every row comes back, null ids too.  An empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B
from phrasemill.llm import tables as T
from phrasemill.session import DEFAULT_MAX_BROADCAST_BYTES

BLOCK_BYTES = 2 << 20
ENCODE_BYTES = 1 << 18      # of text whose ids are Python lists at a time
WRITE_LINKS = 1 << 18       # whose groups are written at a time
LANE = 512
A_ENDS, B_ENDS, BOTH_END = 0, 1, 2
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes that stand for themselves in byte-level tokens
_LEVEL = {chr(b): b for b in _SELF} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SELF)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids, where each begins, how many it has."""
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


@functools.cache
def byte_level(path: str):
    """(encode texts, token-byte table) of a byte-level BPE file.  Its merges are in order of id, so they are ranks
    (checked; any other file is encoded by its own library)."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole["pre_tokenizer"]
    vocab = model["vocab"]
    size = 1 + max([*vocab.values(), *(x["id"] for x in whole["added_tokens"])])
    tokens = [b""] * size
    for token, i in vocab.items():
        tokens[i] = bytes(_LEVEL[c] for c in token)
    first = len(_LEVEL)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if (whole["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
            and all(vocab[a + b] == first + i for i, (a, b) in enumerate(merges)) and len(vocab) == first + len(merges)):
        import tiktoken
        one = tiktoken.Encoding("ranks", pat_str=T.pretoken_pattern(), special_tokens={},
                                mergeable_ranks={tokens[i]: i for i in vocab.values()}).encode_ordinary
        return lambda texts: map(one, texts), _table(tokens)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: (e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)), _table(tokens)


@functools.cache
def pieces(path: str):
    """(encode texts, token-byte table) of a piece BPE with byte fallback."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
              for i in range(p.get_piece_size())]
    return lambda texts: p.encode(texts, num_threads=1), _table(tokens)


def _encode(encode, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of each text's; ids are Python lists for some texts at a time."""
    ids, size, part, have = array("I"), [], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        have += len(t)
        if have >= ENCODE_BYTES or i + 1 == len(texts):
            for x in encode(part):
                ids.extend(x)
                size.append(len(x))
            part, have = [], 0
    return np.array(ids, np.int64), np.array(size, np.int64)


def _same(raw: np.ndarray, raw_size: np.ndarray, ids: np.ndarray, n: np.ndarray, table) -> np.ndarray:
    """Which texts' token bytes join to their bytes."""
    values, at, size = table
    doc = np.repeat(np.arange(len(n)), n)
    ok = np.bincount(doc, weights=size[ids], minlength=len(n)).astype(np.int64) == raw_size
    here = raw if ok.all() else raw[np.repeat(ok, raw_size)]
    wrong = np.flatnonzero(B.gather(values, at, size, ids if ok.all() else ids[ok[doc]]) != here)
    ok[np.flatnonzero(ok)[np.searchsorted(np.cumsum(raw_size[ok]), wrong, side="right")]] = False
    return ok


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Steps of the merge, one byte a link, documents one after another.

    end_a, end_b: byte ends of all tokens, ascending through the block; document d
    has the A tokens first[d]..last[d]-1.  All lanes advance together."""
    n = -(-(last - first) // lane)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)       # a lane's number in its document
    i = np.repeat(first, n) + at * lane
    stop = np.minimum(i + lane, np.repeat(last, n))
    begin = np.where(i > 0, end_a[i - 1], 0)
    j = np.searchsorted(end_b, begin, side="right")                     # the B token that holds the lane's first byte
    who, links = np.arange(len(i)), np.zeros(len(i), np.int64)
    lanes, codes = [], []
    while len(who):
        a, b = end_a[i], end_b[j]
        code = np.where(a < b, A_ENDS, np.where(b < a, B_ENDS, BOTH_END)).astype(np.uint8)
        lanes.append(who)
        codes.append(code)
        links[who] += 1
        i = i + (code != B_ENDS)
        j = j + (code != A_ENDS)
        going = i < stop
        if not going.all():
            who, i, j, stop = who[going], i[going], j[going], stop[going]
    out = np.empty(int(links.sum()), np.uint8)
    where = np.cumsum(links) - links
    for step, (w, c) in enumerate(zip(lanes, codes, strict=True)):
        out[where[w] + step] = c
    return out


def places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A token and B token of each link, counted through the block."""
    a, b = (codes != B_ENDS).astype(np.int64), (codes != A_ENDS).astype(np.int64)
    return np.cumsum(a) - a, np.cumsum(b) - b


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) << 32) | a.astype(np.int64)


def _pack_links(a: np.ndarray, b: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each link's kind, kinds, their counts).  A kind is a pair of ids and a step, the most frequent first;
    ids and steps of the block follow from the numbers."""
    i, j = places(codes)
    kinds, number, n = np.unique((_pairs(a[i], b[j]) << 2) | codes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return rank[number], kinds[order], n[order]


def _open_links(number: np.ndarray, kinds: np.ndarray):
    """A ids, B ids, steps, and each link's pair."""
    kind = kinds[number]
    codes, pair = (kind & 3).astype(np.uint8), kind >> 2
    return pair[codes != B_ENDS] & 0xFFFFFFFF, pair[codes != A_ENDS] >> 32, codes, pair


_BLOCK = "block long, ids array<long>, n_a binary, n_b binary, n_links binary, links binary, kinds binary, n binary"
_FIELDS = ["block", "ids", "n_a", "n_b", "n_links", "links", "kinds", "n"]
_TYPES = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]


def align_texts(texts: list[str | None], byte_path: str, piece_path: str, lane: int = LANE):
    """(n_a, n_b, n_links per text; A ids, B ids, steps of all texts that have tokens)."""
    have = np.flatnonzero([bool(t) for t in texts])
    some = [texts[i] for i in have]
    (enc_a, table_a), (enc_b, table_b) = byte_level(byte_path), pieces(piece_path)
    a, na = _encode(enc_a, [" " + t for t in some])
    b, nb = _encode(enc_b, some)
    raws = [b" " + t.encode("utf-8", "surrogatepass") for t in some]
    raw_size = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    ok = _same(raw, raw_size, a, na, table_a) & _same(raw, raw_size, b, nb, table_b)
    a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
    na, nb, have = na[ok], nb[ok], have[ok]
    last = np.cumsum(na)
    codes = lockstep(np.cumsum(table_a[2][a]), np.cumsum(table_b[2][b]), last - na, last, lane)
    out = np.zeros((3, len(texts)), np.int64)
    i, _ = places(codes)
    doc = np.searchsorted(last, i, side="right")
    out[0, have], out[1, have], out[2, have] = na, nb, np.bincount(doc, minlength=len(na))
    return *out, a, b, codes


def _align(byte_path: str, piece_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(B.small_batches(batches, 1, block_bytes)):
            na, nb, nl, a, b, codes = align_texts(batch.column(1).to_pylist(), byte_path, piece_path)
            number, kinds, n = _pack_links(a, b, codes)
            row = [(part << 32) | seq, batch.column(0).to_pylist(), *[B.put(x.astype(np.uint32)) for x in (na, nb, nl, number)],
                   B.put(kinds), B.put(n.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=_FIELDS)
    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, b, a, n): distinct pairs of each block."""
    for batch in batches:
        for block, kinds, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, which = np.unique(B.get(kinds, np.int64) >> 2, return_inverse=True)
            n = np.bincount(which, weights=B.get(n, np.uint32), minlength=len(pairs)).astype(np.int64)
            for lo in range(0, len(pairs), 100_000):
                q = pairs[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array((q >> 32).astype(np.int32)),
                                                  pa.array((q & 0xFFFFFFFF).astype(np.int32)), pa.array(n[lo:lo + 100_000])],
                                                 names=["block", "b", "a", "n"])


@functools.cache
def _decimal(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal ids, followed by `,`, `|`, `;` or nothing."""
    return _table([f"{i}{s}".encode() for s in (",", "|", ";", "") for i in range(size)])


def groups_of(a: np.ndarray, b: np.ndarray, codes: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    i, j = places(codes)
    cut = codes == BOTH_END
    cut_a, cut_b = i[cut], j[cut]           # last tokens of each group
    ga = np.searchsorted(cut_a, np.arange(len(a)))
    gb = np.searchsorted(cut_b, np.arange(len(b)))
    before = np.concatenate(([0], cut_b + 1))
    size = int(max(a.max(initial=0), b.max(initial=0))) + 1
    size = 1 << size.bit_length()
    text = np.empty(len(a) + len(b), np.int64)
    text[np.arange(len(a)) + before[ga]] = a + size * (np.arange(len(a)) == cut_a[ga])
    final = np.zeros(len(b), bool)
    final[np.cumsum(nb)[nb > 0] - 1] = True
    at_cut = np.arange(len(b)) == cut_b[gb]
    text[np.arange(len(b)) + cut_a[gb] + 1] = b + size * np.where(final, 3, np.where(at_cut, 2, 0))
    table = _decimal(size)
    out = B.gather(*table, text).tobytes()
    ends = np.concatenate(([0], np.cumsum(table[2][text])))[np.concatenate(([0], np.cumsum(na + nb)))]
    return [out[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values each."""
    total = np.concatenate(([0], np.cumsum(values.astype(np.int64))))
    end = np.cumsum(n)
    return total[end] - total[end - n]


class Counts(NamedTuple):
    """Counts of id pairs, ascending by pair."""
    pair: np.ndarray
    n: np.ndarray
    best: np.ndarray

    @staticmethod
    def of(t: pa.Table) -> Counts:
        pair = _pairs(t.column("a").to_numpy(), t.column("b").to_numpy())
        order = np.argsort(pair)
        return Counts(pair[order], t.column("n").to_numpy()[order], t.column("best").to_numpy(zero_copy_only=False)[order])


def _documents(r: dict, counts: Counts, tokens: bool) -> Iterator[pa.Table]:
    """The documents of a block, some at a time."""
    na, nb, nl = (B.get(r[c], np.uint32).astype(np.int64) for c in ("n_a", "n_b", "n_links"))
    number, kinds = B.get(r["links"], np.uint32), B.get(r["kinds"], np.int64)
    where = np.searchsorted(counts.pair, kinds >> 2)
    n, best = (counts.n[where], counts.best[where]) if len(kinds) else (np.zeros(0, np.int64), np.zeros(0, bool))
    end = np.cumsum(nl)
    part = np.cumsum(nl) // WRITE_LINKS
    for rows in np.split(np.arange(len(nl)), np.flatnonzero(np.diff(part)) + 1):
        lo, hi = (end[rows[0]] - nl[rows[0]], end[rows[-1]]) if len(rows) else (0, 0)
        a, b, codes, _ = _open_links(number[lo:hi], kinds)
        k, mine = nl[rows], number[lo:hi]
        out = {"doc_id": pa.array([r["ids"][i] for i in rows], pa.int64()), "n_a": na[rows], "n_b": nb[rows],
               "n_groups": _sums(codes == BOTH_END, k), "n_links": k, "n_best": _sums(best[mine], k), "count_sum": _sums(n[mine], k),
               "groups": pa.array([g.decode() for g in groups_of(a, b, codes, na[rows], nb[rows])], pa.string())}
        if tokens:
            for name, x, size in (("a_ids", a.astype("<u4"), na[rows]), ("b_ids", b.astype("<u4"), nb[rows]), ("steps", codes, k)):
                out[name] = pa.array([x[e - z:e].tobytes() for e, z in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)], pa.binary())
        yield pa.table(out)


def _finish(tokens: bool):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, counts: pa.Table) -> pa.Table:
        return pa.concat_tables(_documents(block.to_pylist()[0], Counts.of(counts), tokens))
    return run


def _finish_here(counts, tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for t in _documents(batch.slice(i, 1).to_pylist()[0], counts.value, tokens):
                    yield from t.combine_chunks().to_batches()
    return run


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, tokens: bool = False,
          max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups); groups is `a1,a2|b1;a3|b2,b3`.
    With `tokens`, also a_ids and b_ids (little-endian unsigned 32-bit) and steps, one byte a link: 0 the A token
    ends first, 1 the B token, 2 both (a cut); the links follow from it (`places`)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    done = T.write_shared(src.mapInArrow(_align(byte_path, piece_path, block_bytes), _BLOCK), "aligned")
    rows = done.select("block", "kinds", "n").mapInArrow(_pair_rows, "block long, b int, a int, n long")
    counts = T.write_shared(rows.groupBy("b", "a").agg(F.sum("n").alias("n")), "pair-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("top"))         # at most the vocabulary of B
    marked = counts.join(F.broadcast(best), "b").select("b", "a", "n", (F.col("n") == F.col("top")).alias("best"))
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
              + ", a_ids binary, b_ids binary, steps binary" * tokens)
    done = done.drop("n")
    if counts.count() * 17 <= max_broadcast_bytes:
        table = docs.sparkSession.sparkContext.broadcast(Counts.of(marked.toArrow()))
        return done.mapInArrow(_finish_here(table, tokens), schema)
    back = rows.select("block", "b", "a").join(marked, ["b", "a"])
    return done.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finish(tokens), schema)
