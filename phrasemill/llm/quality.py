"""Quality classifier: a factorisation machine (operator 9).

Inputs of a document: hashed words (frequencies, scaled to length 1),
structure statistics of its text and its numeric metadata columns.  All inputs
interact pairwise through k-dimensional factors, scored in linear time:

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

Features and scores are computed batch by batch on the executors.  The model is
fitted on at most `max_train` labelled rows (those with the smallest hash of
their id), whose sparse features the driver gathers: `max_train` rows of at most
`dims` numbers bound it.

Results: a score in [0, 1] for every row; a null text is an empty one, a null or
non-finite metadata value counts as the training mean.  Equal inputs have equal
scores.  Without labelled rows, or with one class only, every score is the share
of that class (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B
from phrasemill.llm.line_dedup import free_name

MAX_TRAIN = 8_000
DIMS = 1 << 14
_KINDS = np.zeros(256, np.int8)             # 0: other ASCII
for _k, _r in enumerate(("az", "AZ", "09"), 1):
    _KINDS[ord(_r[0]):ord(_r[1]) + 1] = _k
_KINDS[[9, 11, 12, 13, 32]] = 4
_KINDS[10] = 5
_KINDS[128:] = 6
N_STATS = 14


def _stats(w: B.Words, distinct: np.ndarray) -> np.ndarray:
    """Structure of each text: lengths, shares of character kinds and of word endings."""
    n_docs = len(w.first) - 1
    raw = np.frombuffer(w.raw, np.uint8)
    begin, kind = w.offset[:-1], _KINDS[raw]
    share = np.stack([np.add.reduceat((kind == k).astype(np.int32), begin) for k in range(7)], axis=1).astype(float)
    share[:, 5] -= 1                         # the line feed that ends each text here
    chars = np.maximum(share.sum(axis=1, keepdims=True), 1)
    words = np.diff(w.first)
    last = kind[w.end - 1]
    size = w.end - w.start
    per = lambda v: np.bincount(w.doc, v, n_docs) / np.maximum(words, 1)
    return np.column_stack([share / chars, np.log1p(words), per(size), per(last == 0), per(size == 1),
                            distinct / np.maximum(words, 1), np.log1p(share[:, 5]),
                            words / np.maximum(share[:, 5] + 1, 1) / 100])


def features(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value) of the hashed words of each text, and its statistics."""
    w = B.Words(texts)
    n = len(texts)
    key, count = np.unique(w.doc * dims + (w.hash % np.uint64(dims)).astype(np.int64), return_counts=True)
    doc, idx = key // dims, key % dims
    distinct = np.bincount(doc, minlength=n)
    norm = np.sqrt(np.bincount(doc, count.astype(float) ** 2, n))
    return np.concatenate(([0], np.cumsum(distinct))), idx, count / norm[doc], _stats(w, distinct)


@dataclass
class Model:
    """w, v: weights and factors of hashed words, then of the dense inputs."""
    dims: int
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def dense(self, stats: np.ndarray, meta: np.ndarray) -> np.ndarray:
        x = np.column_stack([stats, np.log1p(np.abs(meta)) * np.sign(meta)])
        x = (x - self.mean) / self.scale
        return np.clip(np.where(np.isfinite(x), x, 0), -4, 4) / 4

    def score(self, texts: list[str | None], meta: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        first, idx, val, stats = features(texts, self.dims)
        return 1 / (1 + np.exp(-_margin(self, first, idx, val, self.dense(stats, meta))[0]))


def _rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the ragged rows of a batch."""
    out, full = np.zeros((len(first) - 1, *values.shape[1:])), first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def _margin(m: Model, first, idx, val, dense):
    d = m.dims
    vx = m.v[idx] * val[:, None]
    s = _rows(vx, first) + dense @ m.v[d:]
    sq = _rows(vx * vx, first) + (dense ** 2) @ (m.v[d:] ** 2)
    return m.bias + _rows(m.w[idx] * val, first) + dense @ m.w[d:] + 0.5 * (s * s - sq).sum(axis=1), s, vx


def fit(rows: list[tuple], dims: int, factors: int = 8, steps: int = 400, rate: float = 0.02, l2: float = 1e-4,
        batch: int = 256, seed: int = 11) -> Model:
    """rows: (label, index, value, statistics, metadata) of each training row.  Log loss, Adam."""
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) < 2:
        p = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-6, 1 - 1e-6)
        return Model(dims, float(np.log(p / (1 - p))))
    stats = np.array([r[3] for r in rows])
    meta = np.array([r[4] for r in rows], float).reshape(len(rows), -1)
    raw = np.column_stack([stats, np.log1p(np.abs(meta)) * np.sign(meta)])
    raw[~np.isfinite(raw)] = np.nan
    seen = np.isfinite(raw).any(axis=0)
    mean, std = np.zeros(raw.shape[1]), np.ones(raw.shape[1])
    mean[seen], std[seen] = np.nanmean(raw[:, seen], axis=0), np.nanstd(raw[:, seen], axis=0)
    rng = np.random.default_rng(seed)
    n = dims + raw.shape[1]
    m = Model(dims, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n), rng.normal(0, 0.05, (n, factors)), mean,
              np.where(std > 1e-9, std, 1.0))
    dense = m.dense(stats, meta)
    p = [m.w[:, None], m.v]
    mom = [[np.zeros_like(a), np.zeros_like(a)] for a in p]
    step = 0
    while step < steps:              # whole passes over the rows
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            first = np.concatenate(([0], np.cumsum([len(rows[i][1]) for i in pick])))
            idx, val = np.concatenate([rows[i][1] for i in pick]), np.concatenate([rows[i][2] for i in pick])
            x = dense[pick]
            z, s, vx = _margin(m, first, idx, val, x)
            err = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
            e = np.repeat(err, np.diff(first))
            by = np.argsort(idx, kind="stable")
            start = np.flatnonzero(np.diff(np.concatenate(([-1], idx[by]))))
            gw, gv = np.zeros_like(m.w), np.zeros_like(m.v)
            if len(by):
                own = (e * val)[:, None] * (np.repeat(s, np.diff(first), axis=0) - vx)
                at = idx[by][start]
                gw[at], gv[at] = np.add.reduceat((e * val)[by], start), np.add.reduceat(own[by], start, axis=0)
            gw[dims:] = err @ x
            gv[dims:] = x.T @ (err[:, None] * s) - (x ** 2).T @ err[:, None] * m.v[dims:]
            m.bias -= rate * err.sum()
            step += 1
            for a, g, (m1, m2) in zip(p, (gw[:, None], gv), mom, strict=True):
                g = g + l2 * a
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.999
                m2 += 0.001 * g * g
                a -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return m


def _meta(batch: pa.RecordBatch, at: int, names: list[str]) -> np.ndarray:
    return np.array([[np.nan if v is None else float(v) for v in batch.column(at + i).to_pylist()]
                     for i in range(len(names))], float).reshape(len(names), batch.num_rows).T


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          metadata: tuple[str, ...] = ("n_chars",), max_train: int = MAX_TRAIN, dims: int = DIMS, **how) -> Model:
    """Fit on the documents of at most `max_train` rows of `labels` with label 0 or 1: of several documents with a
    labelled id the one with the smallest text hash, so `max_train` bounds the rows that are gathered."""
    names = list(metadata)
    few = (labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).distinct()
           .orderBy(F.xxhash64(F.col("__id").cast("long")), "__id", "y").limit(max_train))
    meta = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(names)]
    joined = docs.join(F.broadcast(few), F.col(id_col) == F.col("__id")).select(   # bounded by max_train
        F.col("__id").alias("label_id"), "y", F.struct(F.col(text_col).cast("string").alias("t"), *meta).alias("r"))
    picked = joined.groupBy("label_id", "y").agg(F.min_by("r", F.struct(F.xxhash64("r.t"), "r")).alias("r")).select("y", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.small_batches(batches, 1):
            first, idx, val, stats = features(b.column(1).to_pylist(), dims)
            cut = list(zip(first[:-1], first[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([idx[lo:hi].astype(np.uint32).tobytes() for lo, hi in cut], pa.binary()),
                 pa.array([val[lo:hi].astype(np.float32).tobytes() for lo, hi in cut], pa.binary()),
                 pa.array([x.tobytes() for x in stats], pa.binary()),
                 pa.array([x.tobytes() for x in _meta(b, 2, names)], pa.binary())], names=["y", "i", "v", "s", "m"])

    got = picked.mapInArrow(run, "y int, i binary, v binary, s binary, m binary").collect()
    rows = sorted((r.y, bytes(r.i), bytes(r.v), bytes(r.s), bytes(r.m)) for r in got)  # the same model whatever the row order
    return fit([(y, np.frombuffer(i, np.uint32).astype(np.int64), np.frombuffer(v, np.float32).astype(float),
                 np.frombuffer(s), np.frombuffer(m)) for y, i, v, s, m in rows], dims, **how)


def score(docs: DataFrame, model: Model, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",),
          out_col: str = "score") -> DataFrame:
    """All columns of `docs` and the score, in one narrow pass."""
    names, cols = list(metadata), docs.columns
    shared, out = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, out_col)
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.small_batches(batches, at):
            s = shared.value.score(b.column(at).to_pylist(), _meta(b, len(cols), names))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(cols)], pa.array(s, pa.float64())], names=[*cols, out])

    extra = [F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(names)]
    return docs.select("*", *extra).mapInArrow(run, docs.select("*").schema.add(out, "double"))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("long").cast("string").cast("binary")), F.lit(5)) == 0
