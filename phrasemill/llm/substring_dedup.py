"""Substring dedup by De Bruijn compaction (operator 1).

The graph's nodes are k-1 words, its edges the k-word windows of the corpus.
An edge's canonical coordinate is its first occurrence: smallest document, then
smallest position.  Consecutive edges of a document whose canonical coordinates
also advance by one word form a nonbranching path; a branch (another successor,
or an edge that was first seen elsewhere) ends it.  Only paths are passed on:
one row (document, start, length) -> (source document, start), and the words of
both ends are compared, so a hash collision never removes a word.  Windows
overlap in their k-1 words, so a run of advancing coordinates is a path whose
inner nodes have, in the graph of first occurrences, one edge in and one out.

1. Each block of documents (see `blocks`) sends every distinct edge once, with
   its first coordinate there, to the edge's bucket: a passage that a third of
   the corpus shares is one entry per block, not one per copy.
2. A bucket finds each edge's canonical coordinate and answers the blocks.
3. Blocks join the answers to their edges, compact paths and keep their claims;
   the distinct (path, digest) go to the block of the source document, which
   checks them against its text and sends back those that are wrong.
4. Windows of claims that fail (two different windows with one key) are matched
   by their own digests instead, with those of the claimed source documents.
5. Blocks remove the words that proven paths cover.

Results: windows are judged on the input.  A null text has no words.  Rows that
share a doc_id are one document's parts: neither makes the other's words
repeated, and each comes back as its own row.  A row with a null doc_id comes
back unchanged and is no source.  Fewer than k words: nothing removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from phrasemill.llm import blocks as B
from phrasemill.llm import tables as T
from phrasemill.session import maybe_broadcast

EDGES_PER_BUCKET = 2_000_000
_EDGE = "bucket int, block int, keys binary, docs binary, pos binary"
_ANSWER = "block int, bucket int, at binary, docs binary, pos binary"
_CLAIM = (StructType().add("src_doc", "long", False).add("src_start", "long", False).add("n", "long", False)
          .add("digest", "binary", False)
          .add("spans", ArrayType(StructType().add("doc_id", "long").add("start", "long")), False))
_PATH = StructType(_CLAIM.fields[:4])
_SPANS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64())]))
_WINDOW = StructType().add("doc_id", "long", False).add("start", "long", False).add("digest", "binary", False)
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


class _Block:
    """Words of a block; pos counts the words of all rows of a doc_id."""

    def __init__(self, t: pa.Table, k: int):
        ids, texts = B.open_block(t.column("data").to_pylist())
        self.ids, self.k, self.null = ids, k, np.array([i is None for i in ids], bool)
        self.w = B.Words(texts)
        self.id = np.array([i or 0 for i in ids], np.int64)
        new = np.ones(len(ids), bool)
        new[1:] = (self.id[1:] != self.id[:-1]) | (self.null[1:] != self.null[:-1])
        base = self.w.first[:-1][new][np.cumsum(new) - 1] if len(ids) else np.zeros(0, np.int64)
        self.base = base                       # first word of the doc_id
        self.row_of = {int(i): r for r, i in enumerate(ids) if new[r] and i is not None}

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window, and its hash."""
        w, k = self.w, self.k
        g = B.gram_hash(w.hash, k)
        p = np.flatnonzero(w.doc[:len(g)] == w.doc[k - 1:]) if len(g) else np.zeros(0, np.int64)
        p = p[~self.null[w.doc[p]]]
        return p, g[p]

    def place(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.w.doc[p]
        return self.id[d], p - self.base[d]

    def digest(self, p: int, n: int) -> bytes:
        return hashlib.blake2b(self.w.text(p, p + n + self.k - 1), digest_size=16).digest()


def _distinct(g: np.ndarray, buckets: int, bits: int):
    """Distinct edges by bucket in order of first place: (first, inverse), and rows (bucket, slice of edges)."""
    first, inv = B.distinct(g)
    bucket = ((g[first] >> np.uint64(bits)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort((bucket << 40) | first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return first[order], rank[inv], cuts


def _edges(k: int, buckets: int, bits: int):
    mask = np.uint64((1 << bits) - 1)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = _Block(t, k)
        p, g = b.windows()
        first, _, cuts = _distinct(g, buckets, bits)
        docs, pos = b.place(p[first])
        keys = g[first] & mask
        rows = [(i, key[0].as_py(), B.put(keys[lo:hi]), B.put(docs[lo:hi]), B.put(pos[lo:hi].astype(np.uint32)))
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        c = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({"bucket": pa.array(c[0], pa.int32()), "block": pa.array(c[1], pa.int32()),
                         "keys": pa.array(c[2], pa.binary()), "docs": pa.array(c[3], pa.binary()),
                         "pos": pa.array(c[4], pa.binary())})
    return run


def _canonical(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """For each edge that several blocks hold: the smallest coordinate, told to the other blocks."""
    rows = t.to_pydict()
    keys = [B.get(x, np.uint64) for x in rows["keys"]]
    size = np.cumsum([0] + [len(x) for x in keys])
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(every)
    s = every[order]
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    order = order[many]
    out = [[], [], [], [], []]
    if len(order):
        s = every[order]
        docs = np.concatenate([B.get(x, np.int64) for x in rows["docs"]])
        pos = np.concatenate([B.get(x, np.uint32) for x in rows["pos"]])
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(s))))
        low = np.minimum.reduceat(docs[order], head)[group]
        is_low = docs[order] == low            # a doc_id is in one block only
        low_pos = np.zeros(len(head), np.uint32)
        low_pos[group[is_low]] = pos[order][is_low]
        tell = ~is_low
        at, low, low_pos = order[tell], low[tell], low_pos[group][tell]
        back = np.argsort(at)
        at, low, low_pos = at[back], low[back], low_pos[back]
        cuts = np.searchsorted(at, size)
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if hi > lo:
                for c, v in zip(out, (rows["block"][i], rows["bucket"][i],
                                      B.put((at[lo:hi] - size[i]).astype(np.uint32)), B.put(low[lo:hi]),
                                      B.put(low_pos[lo:hi])), strict=True):
                    c.append(v)
    return pa.table({"block": pa.array(out[0], pa.int32()), "bucket": pa.array(out[1], pa.int32()),
                     "at": pa.array(out[2], pa.binary()), "docs": pa.array(out[3], pa.binary()),
                     "pos": pa.array(out[4], pa.binary())})


def _claims(k: int, buckets: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(docs, k)
        p, g = b.windows()
        first, inv, cuts = _distinct(g, buckets, bits)
        src_doc, src_pos = b.place(p[first])
        src_doc, src_pos = src_doc.copy(), src_pos.copy()
        for r in answers.to_pylist():
            at = cuts[r["bucket"]] + B.get(r["at"], np.uint32).astype(np.int64)
            src_doc[at], src_pos[at] = B.get(r["docs"], np.int64), B.get(r["pos"], np.uint32)
        doc, pos = b.place(p)
        sd, sp = src_doc[inv], src_pos[inv]
        hit = np.flatnonzero(sd < doc)
        paths: dict[tuple, list] = {}
        if len(hit):
            q, sd, sp, doc, pos = p[hit], sd[hit], sp[hit], doc[hit], pos[hit]
            path = np.ones(len(hit), bool)
            path[1:] = (q[1:] != q[:-1] + 1) | (sd[1:] != sd[:-1]) | (sp[1:] != sp[:-1] + 1) | (b.w.doc[q[1:]] != b.w.doc[q[:-1]])
            at = np.flatnonzero(path)
            n = np.diff(np.append(at, len(hit)))
            for x in zip(sd[at].tolist(), sp[at].tolist(), n.tolist(), q[at].tolist(), doc[at].tolist(),
                         pos[at].tolist(), strict=True):
                paths.setdefault((*x[:3], b.digest(x[3], x[2])), []).append({"doc_id": x[4], "start": x[5]})
        c = list(zip(*paths, strict=True)) or [[]] * 4
        return pa.table({"src_doc": pa.array(c[0], pa.int64()), "src_start": pa.array(c[1], pa.int64()), "n": pa.array(c[2], pa.int64()),
                         "digest": pa.array(c[3], pa.binary()), "spans": pa.array(list(paths.values()), _SPANS)})
    return run


def _wrong(k: int):
    """Of the claims on this block's documents, those whose words differ."""
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, claims: pa.Table) -> pa.Table:
        if not claims.num_rows:
            return claims.select(["src_doc", "src_start", "n", "digest"])
        b, bad = _Block(docs, k), []
        for i, r in enumerate(claims.to_pylist()):
            row = b.row_of[r["src_doc"]]
            if b.digest(int(b.base[row]) + r["src_start"], r["n"]) != r["digest"]:
                bad.append(i)
        return claims.select(["src_doc", "src_start", "n", "digest"]).take(pa.array(bad, pa.int64()))
    return run


def _window_digests(k: int):
    """Digests of the windows of spans; n < 0: of the whole document."""
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
        out = [[], [], []]
        if spans.num_rows:
            b = _Block(docs, k)
            for r in spans.to_pylist():
                d = r["doc_id"]
                base = int(b.base[b.row_of[d]])
                if r["n"] < 0:
                    p, _ = b.windows()
                    p = p[b.id[b.w.doc[p]] == d].tolist()
                else:
                    p = range(base + r["start"], base + r["start"] + r["n"])
                for j in p:
                    for c, v in zip(out, (d, j - base, b.digest(j, 1)), strict=True):
                        c.append(v)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "start": pa.array(out[1], pa.int64()),
                         "digest": pa.array(out[2], pa.binary())})
    return run


def _remove(k: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
        b = _Block(docs, k)
        cover = np.zeros(len(b.w.start) + 1, np.int64)
        for d, s, n in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "start", "n")), strict=True):
            lo = int(b.base[b.row_of[d]]) + s
            cover[lo] += 1
            cover[lo + n + k - 1] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept, removed, n_removed = [], [], []
        for lo, hi in zip(b.w.first[:-1], b.w.first[1:], strict=True):
            g = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
            words = b.w.raw[b.w.start[lo]:b.w.end[hi - 1]].split() if hi > lo else []
            cut, parts = 0, []
            for s, e in zip(edge[0::2], edge[1::2], strict=True):
                parts += words[cut:s]
                cut = e
            kept.append(b" ".join(parts + words[cut:]).decode("utf-8", "surrogatepass"))
            removed.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2], strict=True)])
            n_removed.append(int(g.sum()))
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(np.diff(b.w.first), pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
                         "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13,
                    key_bits: int = 40, block_bytes: int = B.BLOCK_BYTES,
                    edges_per_bucket: int = EDGES_PER_BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): `removed` are word
    ranges [start, end) of the row's own words.  `key_bits` bounds the part of
    an edge's hash that is sent beside its bucket; a small value only makes
    step 4 work harder."""
    nb = B.block_count(docs, text_col, block_bytes)
    buckets = max(1, nb * block_bytes // (6 * edges_per_bucket))
    packed = B.pack_blocks(docs, id_col, text_col, nb)
    by_block = packed.groupBy("block")

    edges = by_block.applyInArrow(_edges(k, buckets, key_bits), _EDGE).repartition(buckets, "bucket")
    answers = edges.groupBy("bucket").applyInArrow(_canonical, _ANSWER)
    # Claims stay with the blocks that make them; only distinct paths travel, to be checked, and the wrong ones back.
    claims = T.write_shared(by_block.cogroup(answers.groupBy("block")).applyInArrow(_claims(k, buckets, key_bits), _CLAIM), "claims")
    path = _PATH.names
    to_check = claims.select(*path).distinct().withColumn("block", B.block_of(F.col("src_doc"), nb))
    wrong = T.write_shared(by_block.cogroup(to_check.groupBy("block")).applyInArrow(_wrong(k), _PATH), "wrong-claims")
    few, _ = maybe_broadcast(wrong, [], extra=F.lit(32))
    own_block = B.block_of(F.col("doc_id"), nb).alias("block")

    def spans(of: DataFrame) -> DataFrame:
        return of.select("src_doc", "n", F.inline("spans").alias("doc_id", "start"))

    good = spans(claims.join(few, path, "left_anti")).select(own_block, "doc_id", "start", "n")
    failed = spans(claims.join(few, path, "left_semi"))
    sources = failed.select(B.block_of(F.col("src_doc"), nb).alias("block"), F.col("src_doc").alias("doc_id"),
                            F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("n")).distinct()
    failed = failed.select(own_block, "doc_id", "start", "n").unionByName(sources)
    own = T.write_shared(by_block.cogroup(failed.groupBy("block")).applyInArrow(_window_digests(k), _WINDOW), "window-digests")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.min("start").alias("first_start"))
    late = own.join(first, "digest").filter("first_doc < doc_id").select(
        own_block, "doc_id", "start", F.lit(1).cast("long").alias("n"))

    return by_block.cogroup(good.unionByName(late).groupBy("block")).applyInArrow(_remove(k), _OUT)
