"""SimHash near-dedup with vantage-point trees (operator 8).

1. Fingerprints: 64-bit SimHash of word shingles, per document.
2. Equal fingerprints become one row (partial sums: a hot copy group is one row
   per task), so only distinct fingerprints are compared.
3. A vantage-point tree over Hamming distance, fitted on a bounded sample
   (`sample` fingerprints, the smallest by hash), splits the space into shards
   of up to 2 million (16 MB); every fingerprint has one home shard.  A fingerprint
   whose ball of radius `max_bits` crosses a boundary also visits the shards on
   the other side, as the triangle bound allows no fewer; of a pair in two
   shards only the one with the smaller shard number visits.
4. In a shard, a local tree over its residents prunes by the same bound; what is
   left is compared bit by bit, in chunks.  Pairs go straight into a spanning
   forest: a shard returns one link per row at most, whatever a group's size.
5. Components of the links; all documents of a fingerprint share its component.

Results: one row per input row.  A text without words (null, empty) has
fingerprint 0, which links like any other.  component_id is the smallest
non-null doc_id of the component (null if it has none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.links import Forest, components
from phrasemill.session import cut_lineage

LEAF = 256
SHARD_ROWS = (32_000, 1 << 21)      # fingerprints; 8 bytes each
CELLS = 1 << 21


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64 hashes."""
    from xxhash import xxh64_intdigest
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change
    if not w:
        return 0
    flat = b" ".join(w)
    end = np.cumsum([len(x) + 1 for x in w]) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    n = max(1, len(w) - words + 1)
    stop = end[words - 1:] if len(w) >= words else end[-1:]
    h = np.fromiter((xxh64_intdigest(flat[i:j], seed) for i, j in zip(start[:n].tolist(), stop.tolist(), strict=True)),
                    np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                 seed: int = 42) -> DataFrame:
    """(doc_id, x, fp): a hash of the text, and the fingerprint as a long (two's complement)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, words, seed) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "x", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text).alias("x"), text).mapInArrow(
        run, "doc_id long, x long, fp long")


# ---------------------------------------------------------------- vantage-point trees
def _vantage(points: np.ndarray, rng: np.random.Generator, reach: int = 4) -> tuple[np.uint64, int]:
    """Of a few candidates and radii, those with the fewest rows near the cut for what the cut tells: rows within
    `reach` of it go to both sides."""
    tries = rng.choice(points, min(8, len(points)), replace=False)
    few = rng.choice(points, min(256, len(points)), replace=False)
    best = None
    for v in tries:
        d = np.sort(np.bitwise_count(few ^ v).astype(np.int64))
        for mu in sorted(set(np.quantile(d, [0.3, 0.4, 0.5, 0.6, 0.7], method="lower").tolist())):
            p = np.count_nonzero(d <= mu) / len(d)
            if 0 < p < 1:
                both = np.count_nonzero((d > mu - reach) & (d <= mu + reach)) / len(d)
                cost = np.log1p(both / 2) / -(p * np.log(p) + (1 - p) * np.log(1 - p))
                if best is None or cost < best[0]:
                    best = cost, v, int(mu)
    if best is None:
        return tries[0], int(np.median(np.bitwise_count(points ^ tries[0])))
    return best[1], best[2]


def _grow(points: np.ndarray, depth: int, rng: np.random.Generator, reach: int = 4):
    """Nodes (vantage point, radius, inside, outside); a leaf is None."""
    if depth == 0 or len(points) < 2:
        return None
    vp, mu = _vantage(points, rng, reach)
    inside = np.bitwise_count(points ^ vp) <= mu
    if inside.all():
        return None
    return vp, mu, _grow(points[inside], depth - 1, rng, reach), _grow(points[~inside], depth - 1, rng, reach)


def _route(tree, q: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf within `reach` of a row's ball, leaves numbered from the left."""
    rows, leaves, count = [], [], 0

    def walk(node, at):
        nonlocal count
        if node is None:
            rows.append(at)
            leaves.append(np.full(len(at), count))
            count += 1
            return
        d = np.bitwise_count(q[at] ^ node[0]).astype(np.int64)
        walk(node[2], at[d <= node[1] + reach])
        walk(node[3], at[d > node[1] - reach])

    walk(tree, np.arange(len(q)))
    return np.concatenate(rows), np.concatenate(leaves)


def _near(p: np.ndarray, q: np.ndarray, bits: int, found, rng, pi=None, qi=None) -> None:
    """found(rows of p, rows of q) for all pairs within `bits`, by a local tree over p."""
    pi = np.arange(len(p)) if pi is None else pi
    qi = np.arange(len(q)) if qi is None else qi
    if not len(pi) or not len(qi):
        return
    if len(pi) > LEAF and len(qi) > 8:
        vp, mu = _vantage(p[pi], rng, bits)
        dp = np.bitwise_count(p[pi] ^ vp).astype(np.int64)
        dq = np.bitwise_count(q[qi] ^ vp).astype(np.int64)
        if 0 < (dp <= mu).sum() < len(pi):
            _near(p, q, bits, found, rng, pi[dp <= mu], qi[dq <= mu + bits])
            _near(p, q, bits, found, rng, pi[dp > mu], qi[dq > mu - bits])
            return
    step = max(1, CELLS // len(pi))
    for i in range(0, len(qi), step):
        b, a = np.nonzero(np.bitwise_count(q[qi[i:i + step], None] ^ p[None, pi]) <= bits)
        if len(a):
            found(pi[a], qi[i:i + step][b])


def _shards(tree, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            row, leaf = _route(t, fp, 0)
            home = np.empty(len(fp), np.int64)
            home[row] = leaf
            row, leaf = _route(t, fp, bits)
            keep = leaf >= home[row]
            row, leaf = row[keep], leaf[keep]
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(fp[row].view(np.int64)),
                                              pa.array(leaf == home[row])], names=["shard", "fp", "home"])
    return run


def _links(bits: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fp = np.sort(t.column("fp").to_numpy())
        signed = fp
        home = np.isin(signed, t.filter(t.column("home")).column("fp").to_numpy())
        fp = signed.view(np.uint64)
        own = np.flatnonzero(home)
        forest, rng = Forest(len(fp)), np.random.default_rng(7)
        _near(fp[own], fp, bits, lambda a, b: forest.add(own[a], b), rng)
        linked = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pa.table({"a": pa.array(signed[linked]), "b": pa.array(signed[forest.root[linked]])})
    return run


def near_links(distinct: DataFrame, bits: int, shard_rows: int | None = None, sample: int = 20_000) -> DataFrame:
    """Links (a, b) of distinct fingerprints `fp` whose components are those of
    all pairs within `bits` bits: a spanning forest from each shard.

    Every level of the tree sends some rows to both sides, so there are only as many shards as keep the cores busy
    (four a core), within the bounds of SHARD_ROWS; `shard_rows` sets the size instead."""
    spark, n = distinct.sparkSession, distinct.count()
    if shard_rows is None:
        shard_rows = min(max(n // (4 * spark.sparkContext.defaultParallelism), SHARD_ROWS[0]), SHARD_ROWS[1])
    depth = max(0, math.ceil(math.log2(max(1, n / shard_rows))))
    points = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample if depth else 0).toArrow().column("fp").to_numpy()
    tree = spark.sparkContext.broadcast(_grow(points.astype(np.int64).view(np.uint64), depth, np.random.default_rng(7), bits))
    return (distinct.select("fp").mapInArrow(_shards(tree, bits), "shard long, fp long, home boolean")
            .groupBy("shard").applyInArrow(_links(bits), "a long, b long"))


def _groups(fps: DataFrame, bits: int, shard_rows: int | None, sample: int) -> DataFrame:
    """(fp, component) for every distinct fingerprint."""
    distinct = fps.select("fp").distinct()
    comp = components(near_links(distinct, bits, shard_rows, sample), "a", "b").withColumnRenamed("node", "fp")
    return distinct.join(comp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       seed: int = 42, bits: int = 4, shard_rows: int | None = None, sample: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    named = _groups(fps, bits, shard_rows, sample).join(least, "fp")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42,
             bits: int = 4, shard_rows: int | None = None, sample: int = 20_000) -> DataFrame:
    """The rows of `docs` with one of each component: its smallest doc_id (null ids only where there is no other;
    of rows with that id the smallest text hash, of equal rows any)."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "x"))
    named = fps.groupBy("fp").agg(first.alias("k")).join(_groups(fps, bits, shard_rows, sample), "fp")
    keep = named.groupBy("component").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("__d"), F.col("k.x").alias("__x"))
    marked = docs.select("*", F.xxhash64(F.col(text_col).cast("string")).alias("__own"))
    same = marked[id_col].cast("long").eqNullSafe(keep["__d"]) & (marked["__own"] == keep["__x"])
    return marked.join(keep, same).dropDuplicates(["__d", "__x"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_digits(fp):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
