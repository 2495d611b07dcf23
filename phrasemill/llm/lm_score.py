"""Stupid-backoff language-model scores (operator 6).

Counts of word n-grams of orders 1..3 over the whole corpus, less the scored
document's own (so a text doesn't vouch for itself; its copies do), score each
word w after u v:

    S(w | u v) = c(u v w) / c(u v)      if c(u v w) > 0, else a S(w | v)
    S(w | v)   = c(v w) / c(v)          if c(v w) > 0,   else a S(w)
    S(w)       = c(w) / N               if c(w) > 0,     else a / N

with a = 0.4 and N words in the corpus.  A document's score is the sum of the
natural logarithms.

A block of documents (see `blocks`) explodes its n-grams and sends each
distinct one with its count in the block to the count table's partition, by
hash; the partition sums them; the sums are joined back to the block's n-grams
and summed per document.  An n-gram that is everywhere is one row entry per
block.  Nothing is pruned or capped: the tables grow with the corpus.  N-grams
are told apart by 56 bits of their hash.

Results: words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A text without words
(null, empty) has score 0.  Every row is a document of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B

BLOCK_BYTES = 4 << 20
GRAMS_PER_TABLE = 2_000_000
BACKOFF = 0.4
_DROP = np.uint64(8)


class _Grams:
    """A block's n-grams: `number[n][i]` is the n-gram that ends at word i (-1: none), numbered by hash."""

    def __init__(self, t: pa.Table, tables: int):
        self.ids, texts = B.open_block(t.column("data").to_pylist())
        w = self.w = B.Words(texts)
        h, size = w.hash, len(w.start)
        place = np.arange(size) - w.first[:-1][w.doc]
        self.place = place
        keys, ends = [], []
        for n in (1, 2, 3):
            at = np.flatnonzero(place >= n - 1)
            g = B.gram_hash(h, n)[at - n + 1] if size >= n else np.zeros(0, np.uint64)
            keys.append(B._mix(g + np.uint64(n)) >> _DROP)
            ends.append(at)
        every = np.concatenate(keys)
        first, inv = B.distinct(every)
        self.key, self.count = every[first], np.bincount(inv, minlength=len(first))
        self.number, lo = {}, 0
        for n, at in zip((1, 2, 3), ends, strict=True):
            self.number[n] = np.full(size, -1)
            self.number[n][at] = inv[lo:lo + len(at)]
            lo += len(at)
        table = ((self.key >> np.uint64(24)) * np.uint64(tables)) >> np.uint64(32)   # ascending, as the keys
        self.cuts = np.searchsorted(table, np.arange(tables + 1))

    def own(self, n: int) -> np.ndarray:
        """How often each word's n-gram stands in its own document."""
        has = np.flatnonzero(self.number[n] >= 0)
        _, inv = B.distinct((self.w.doc[has].astype(np.uint64) << np.uint64(40)) | self.number[n][has].astype(np.uint64))
        out = np.zeros(len(self.place), np.int64)
        out[has] = np.bincount(inv)[inv] if len(has) else 0
        return out


def _counts(tables: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        g = _Grams(t, tables)
        rows = [(i, key[0].as_py(), B.put(np.diff(g.key[lo:hi], prepend=np.uint64(0))), B.put(g.count[lo:hi]))
                for i, (lo, hi) in enumerate(zip(g.cuts[:-1], g.cuts[1:], strict=True)) if hi > lo]
        c = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({"tab": pa.array(c[0], pa.int32()), "block": pa.array(c[1], pa.int32()),
                         "keys": pa.array(c[2], pa.binary()), "counts": pa.array(c[3], pa.binary())})
    return run


def _sums(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """What the other blocks hold of each n-gram."""
    keys = [np.cumsum(B.get(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    counts = [B.get(x, np.int64) for x in t.column("counts").to_pylist()]
    size = np.cumsum([0] + [len(k) for k in keys])
    every, own = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    s = every[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    total = np.add.reduceat(own[order], head)
    rest = np.empty(len(own), np.int64)
    rest[order] = np.repeat(total, np.diff(np.append(head, len(s))))
    rest -= own
    return pa.table({"block": t.column("block"), "tab": t.column("tab"),
                     "rest": pa.array([B.put(rest[lo:hi]) for lo, hi in zip(size[:-1], size[1:], strict=True)], pa.binary())})


def _scores(tables: int, words: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, sums: pa.Table) -> pa.Table:
        g = _Grams(docs, tables)
        total = g.count.copy()
        for r in sums.select(["tab", "rest"]).to_pylist():
            total[g.cuts[r["tab"]]:g.cuts[r["tab"] + 1]] += B.get(r["rest"], np.int64)
        c = {}
        for n in (1, 2, 3):
            c[n] = np.where(g.number[n] >= 0, total[g.number[n]], 0) - g.own(n)
        before = lambda x: np.concatenate(([0], x[:-1])) if len(x) else x  # noqa: E731  of the n-gram one word earlier
        back = np.minimum(g.place, 2)                   # orders that the word could have
        tri, bi = c[3] > 0, c[2] > 0
        bi &= ~tri
        uni = ~tri & ~bi & (c[1] > 0)
        none = ~tri & ~bi & ~uni
        p = np.full(len(back), 1.0 / max(words, 1))
        p[tri] = c[3][tri] / before(c[2])[tri]
        p[bi] = BACKOFF ** (back[bi] - 1) * c[2][bi] / before(c[1])[bi]
        p[uni] = BACKOFF ** back[uni] * c[1][uni] / words
        p[none] *= BACKOFF ** (back[none] + 1)
        n_docs = len(g.ids)
        per = lambda v: np.bincount(g.w.doc, v, n_docs)
        out = {"doc_id": pa.array(g.ids, pa.int64()), "n_words": pa.array(np.diff(g.w.first), pa.int64())}
        for name, v in (("n_trigram", tri), ("n_bigram", bi), ("n_unigram", uni), ("n_unseen", none)):
            out[name] = pa.array(per(v).astype(np.int64))
        out["log_score"] = pa.array(per(np.log(p)).astype(np.float64))
        return pa.table(out)
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
              grams_per_table: int = GRAMS_PER_TABLE) -> DataFrame:
    """(doc_id, n_words, n_trigram, n_bigram, n_unigram, n_unseen, log_score): how many words were scored by which order."""
    nb = B.block_count(docs, text_col, block_bytes)
    tables = max(1, nb * block_bytes // (4 * grams_per_table))
    by_block = B.pack_blocks(docs, id_col, text_col, nb, independent=True).groupBy("block")
    words = docs.agg(F.sum(F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[ \t-\r]+"),
                                           lambda w: w != "")).cast("long")).alias("n")).first()["n"] or 0
    sums = (by_block.applyInArrow(_counts(tables), "tab int, block int, keys binary, counts binary")
            .repartition(tables, "tab").groupBy("tab")     # as many tasks as tables, however large the corpus
            .applyInArrow(_sums, "block int, tab int, rest binary"))
    return by_block.cogroup(sums.groupBy("block")).applyInArrow(
        _scores(tables, words), "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, "
                                "n_unseen long, log_score double")
