"""Embedding near-duplicates by cover trees and dual traversal (operator 3).

Cosine >= c between unit vectors is a distance <= sqrt(2 - 2c).

1. Equal vectors of a label become one row with a count (partial sums: a hot
   vector is one row per task).
2. Tops: of each label, a net of centres picked farthest-first from a bounded
   sample (`sample` vectors, the smallest by hash); every vector goes to its
   nearest centre, and centres that gather too many split by hash, so a shard
   has about `shard_rows` vectors, its centre and its covering radius.
3. Each shard is a cover tree: nested levels whose radii halve; a node knows how
   far its farthest descendant is.
4. Of two shards of a label that their covering radii don't rule out, only the
   points within the other's covering radius and the threshold of its centre are
   sent to the pair, made into trees and traversed together: a pair of nodes is dropped when their distance less
   both radii exceeds the threshold, taken whole when their distance plus both
   radii stays within it, and opened otherwise; points are compared in double
   precision.
5. A pair of shards returns each vector's number of links and a spanning forest
   (one link per vector at most), not the pairs of a dense group.

`threshold_pairs` returns the pairs of different vectors themselves.

Results: a vector that is null, zero, or has null or non-finite components, or
whose label is null, has no links and is its own component; so are vectors of
different lengths to each other.  Rows are vectors: equal vec_ids count each.
A null vec_id takes part but names no component.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm import tables as T
from phrasemill.llm.links import Forest, components

LEAF = 16
PARTNERS = 64  # of a shard that one task serves
SLACK = 1e-7   # above rounding errors; what is this near the threshold is compared exactly


class Node:
    """A centre, the distance to its farthest descendant, and children or points."""
    __slots__ = ("center", "radius", "points", "children", "centers", "radii")

    def __init__(self, center: int, radius: float, points: np.ndarray, children: list | None):
        self.center, self.radius, self.points, self.children = center, radius, points, children
        part = children or [self]
        self.centers = np.array([c.center for c in part])
        self.radii = np.array([c.radius for c in part]) if children else np.array([radius])


def grow(x: np.ndarray, points: np.ndarray, center: int, far: np.ndarray, level: float = 2.0) -> Node:
    """far: the points' distances to the centre.  A child level covers within half the radius."""
    radius = float(far.max())
    if len(points) <= LEAF or radius <= SLACK:
        return Node(center, radius, points, None)
    while level >= radius:
        level /= 2
    children, rest, c, d = [], points, center, far
    while len(rest):
        inside = d <= level
        children.append(grow(x, rest[inside], c, d[inside], level))
        rest = rest[~inside]
        if len(rest):
            c = int(rest[0])
            d = np.sqrt(np.maximum(0, 2 - 2 * (x[rest] @ x[c])))
    return Node(center, radius, points, children)


class Found:
    """What a traversal finds: weighted link counts of the points of both sides, and their forest."""

    def __init__(self, wa: np.ndarray, wb: np.ndarray, same: bool):
        self.wa, self.wb, self.same = wa, wb, same
        self.shift = 0 if same else len(wa)
        self.count = np.zeros(len(wa) if same else len(wa) + len(wb), np.int64)
        self.forest = Forest(len(self.count))

    def block(self, ia: np.ndarray, ib: np.ndarray, hit: np.ndarray) -> None:
        """hit[i, j]: points ia[i] and ib[j] are linked (pairs of one point with itself are not passed)."""
        self.count[ia] += hit @ self.wb[ib]
        self.count[ib + self.shift] += self.wa[ia] @ hit
        i, j = np.nonzero(hit)
        self.forest.add(ia[i], ib[j] + self.shift)

    def whole(self, ia: np.ndarray, ib: np.ndarray) -> None:
        """All of ia with all of ib."""
        self.count[ia] += self.wb[ib].sum()
        self.count[ib + self.shift] += self.wa[ia].sum()
        self.forest.add(np.full(len(ib), ia[0]), ib + self.shift)
        self.forest.add(ia, np.full(len(ia), ib[0] + self.shift))


class Pairs:
    """As Found, but keeps the pairs."""

    def __init__(self):
        self.a, self.b = [], []

    def block(self, ia, ib, hit) -> None:
        i, j = np.nonzero(hit)
        self.a.append(ia[i])
        self.b.append(ib[j])

    def whole(self, ia, ib) -> None:
        self.block(ia, ib, np.ones((len(ia), len(ib)), bool))


def traverse(ta: Node, tb: Node, xa: np.ndarray, xb: np.ndarray, cosine: float, found) -> None:
    """All pairs of points of the two trees with the cosine at least; the same tree twice: each pair once."""
    t = math.sqrt(2 - 2 * cosine)
    stack = [(ta, tb)]
    while stack:
        a, b = stack.pop()
        same = a is b
        if a.children is None and b.children is None:
            hit = xa[a.points] @ xb[b.points].T >= cosine
            found.block(a.points, b.points, np.triu(hit, 1) if same else hit)
            continue
        ca, cb = a.children or [a], b.children or [b]
        d = np.sqrt(np.maximum(0, 2 - 2 * (xa[a.centers] @ xb[b.centers].T)))
        reach = a.radii[:, None] + b.radii[None, :]
        open_ = d - reach <= t + SLACK
        if same:
            open_ = np.triu(open_)
        inside = open_ & (d + reach < t - SLACK)
        if same:
            np.fill_diagonal(inside, False)
        for i, j in zip(*np.nonzero(open_), strict=True):
            if inside[i, j]:
                found.whole(ca[i].points, cb[j].points)
            elif len(ca[i].points) > 1 or ca[i] is not cb[j]:
                stack.append((ca[i], cb[j]))


# ---------------------------------------------------------------- Spark
def _matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    """Unit rows in double precision."""
    col = t.column(name).combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _net(shard_rows: int):
    """Centres of a label: farthest first among the sample."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = _matrix(t)
        k = min(len(x), max(1, math.ceil(t.column("n")[0].as_py() / shard_rows)))
        picked, d = [0], np.full(len(x), np.inf)
        while len(picked) < k:
            d = np.minimum(d, 2 - 2 * (x @ x[picked[-1]]))
            picked.append(int(np.argmax(d)))
        return pa.table({"label": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()),
                         "net": pa.array([pickle.dumps(x[picked])], pa.binary())})
    return run


def _assign(key: tuple[pa.Scalar, ...], t: pa.Table, nets: pa.Table) -> pa.Table:
    net = pickle.loads(nets.column("net")[0].as_py())
    c = np.argmax(_matrix(t) @ net.T, axis=1) if t.num_rows else np.zeros(0, np.int64)
    return t.select(["label", "dim", "gid", "copies", "v"]).append_column("c", pa.array(c.astype(np.int32), pa.int32()))


def _tree(x: np.ndarray) -> Node:
    center = int(np.argmax(x @ x.mean(axis=0)))
    return grow(x, np.arange(len(x)), center, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[center]))))


def _shard(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    t = t.sort_by("gid")
    x = _matrix(t)
    tree = _tree(x)
    data = pickle.dumps((x, t.column("gid").to_numpy(), t.column("copies").to_numpy()))
    return pa.table({"label": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()),
                     "center": pa.array([x[tree.center].tolist()], pa.list_(pa.float64())),
                     "radius": pa.array([tree.radius], pa.float64()), "data": pa.array([data], pa.binary())})


_SENT = "s1 long, s2 long, shard long, data binary"


def _send(cosine: float):
    """For each partner of a shard: the points that may have a link into the partner's ball; nothing if there are none."""
    reach = math.sqrt(2 - 2 * cosine) + SLACK

    def run(key: tuple[pa.Scalar, ...], shard: pa.Table, partners: pa.Table) -> pa.Table:
        own = key[0].as_py()
        x, gid, copies = pickle.loads(shard.column("data")[0].as_py())
        rows = []
        for r in partners.select(["s1", "s2", "center", "radius"]).to_pylist():
            near = np.ones(len(x), bool)
            if r["s1"] != r["s2"]:
                near = np.sqrt(np.maximum(0, 2 - 2 * (x @ np.array(r["center"])))) <= r["radius"] + reach
            if near.any():
                rows.append((r["s1"], r["s2"], own, pickle.dumps((x[near], gid[near], copies[near]))))
        c = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({"s1": pa.array(c[0], pa.int64()), "s2": pa.array(c[1], pa.int64()),
                         "shard": pa.array(c[2], pa.int64()), "data": pa.array(c[3], pa.binary())})
    return run


def _open(key: tuple[pa.Scalar, ...], t: pa.Table):
    """Both sides of a pair of shards as trees; None if one has no point near the other."""
    same = key[0].as_py() == key[1].as_py()
    if t.num_rows < 2 and not same:
        return None
    sides = [(_tree(x), x, gid, copies) for x, gid, copies in map(pickle.loads, t.sort_by("shard").column("data").to_pylist())]
    return sides[0], sides[0] if same else sides[1], same


def _links(cosine: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sides = _open(key, t)
        if sides is None:
            return pa.table({c: pa.array([], pa.int64()) for c in ("gid", "links", "root")})
        (ta, xa, ga, wa), (tb, xb, gb, wb), same = sides
        found = Found(wa, wb, same)
        traverse(ta, tb, xa, xb, cosine, found)
        gid = ga if same else np.concatenate((ga, gb))
        on = np.flatnonzero(found.count)
        return pa.table({"gid": pa.array(gid[on], pa.int64()), "links": pa.array(found.count[on], pa.int64()),
                         "root": pa.array(gid[found.forest.root[on]], pa.int64())})
    return run


def _pairs(cosine: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sides = _open(key, t)
        if sides is None:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        (ta, xa, ga, _), (tb, xb, gb, _), _ = sides
        found = Pairs()
        traverse(ta, tb, xa, xb, cosine, found)
        a, b = np.concatenate([np.zeros(0, np.int64), *found.a]), np.concatenate([np.zeros(0, np.int64), *found.b])
        return pa.table({"a": pa.array(ga[a], pa.int64()), "b": pa.array(gb[b], pa.int64()),
                         "cosine": pa.array(np.einsum("ij,ij->i", xa[a], xb[b]), pa.float64())})
    return run


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the distinct vectors (label, dim, v, copies, least_id, gid), written once."""
    v = F.col(vector_col).cast("array<double>")
    # compared as numbers: -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.size(v).alias("dim"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    distinct = valid.groupBy("label", "dim", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
    return valid, T.write_shared(distinct.withColumn("gid", F.monotonically_increasing_id()), "vectors")


def shard_pairs(distinct: DataFrame, cosine: float, shard_rows: int, sample: int) -> DataFrame:
    """(s1, s2, shard, data): of each pair of shards that may hold a link, the points of both that may have one."""
    group = ["label", "dim"]
    size = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    hashed = distinct.withColumn("h", F.xxhash64("v"))
    few = hashed.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h", "gid"))).filter(
        F.col("r") <= sample).join(size, group)
    nets = few.select(*group, "v", "n").groupBy(*group).applyInArrow(_net(shard_rows), "label long, dim int, net binary")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / (16 * shard_rows))).cast("int")
    salted = distinct.join(size, group).withColumn("salt", F.pmod(F.xxhash64("gid"), salts).cast("int"))
    spread = nets.join(size, group).select(*group, "net", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    homes = salted.groupBy(*group, "salt").cogroup(spread.groupBy(*group, "salt")).applyInArrow(
        _assign, "label long, dim int, gid long, copies long, v array<double>, c int")
    homes = T.write_shared(homes, "homes")
    held = homes.groupBy(*group, "c").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    shards = homes.join(held, [*group, "c"]).withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts"))).groupBy(
        *group, "c", "part").applyInArrow(_shard, "label long, dim int, center array<double>, radius double, data binary")
    shards = T.write_shared(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")

    one = shards.select(*group, F.col("shard").alias("s1"), F.col("center").alias("c1"), F.col("radius").alias("r1"))
    two = shards.select(*group, F.col("shard").alias("s2"), F.col("center").alias("c2"), F.col("radius").alias("r2"))
    dot = F.aggregate(F.zip_with("c1", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("r1") + F.col("r2") + math.sqrt(2 - 2 * cosine) + SLACK
    pairs = T.write_shared(one.join(two, group).filter("s1 <= s2").filter(near).drop(*group), "pairs")
    first = pairs.select("s1", "s2", F.col("s1").alias("shard"), F.col("c2").alias("center"), F.col("r2").alias("radius"))
    second = pairs.filter("s1 < s2").select("s1", "s2", F.col("s2").alias("shard"), F.col("c1").alias("center"), F.col("r1").alias("radius"))
    partners = first.unionByName(second)
    # a shard of very many partners serves them in several tasks
    parts = partners.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    partners = partners.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("s1", "s2"), F.col("parts"))).drop("parts")
    copies = shards.select("shard", "data").join(parts, "shard").select(
        "shard", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return copies.groupBy("shard", "part").cogroup(partners.groupBy("shard", "part")).applyInArrow(_send(cosine), _SENT)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = 0.98, shard_rows: int = 2048, sample: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    valid, distinct = distinct_vectors(vectors, id_col, vector_col, label_col)
    found = T.write_shared(shard_pairs(distinct, cosine, shard_rows, sample).groupBy("s1", "s2").applyInArrow(
        _links(cosine), "gid long, links long, root long"), "links")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    comp = components(found, "gid", "root").withColumnRenamed("node", "gid")
    named = distinct.select("gid", "least_id", "copies").join(links, "gid", "left").join(comp, "gid", "left").select(
        "gid", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "gid").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "component").join(distinct.select("gid", "label", "dim", "v"), "gid").select(
        "label", "dim", "v", "n_links", "component_id")
    # every row again: rows without a valid vector find no partner
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.size(F.col(vector_col)).alias("dim"), v.alias("v"))
    out = rows.join(of, ["label", "dim", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def threshold_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = 0.98, shard_rows: int = 2048, sample: int = 512) -> DataFrame:
    """(vec_id_a, vec_id_b, cosine): pairs of different vectors, each named by its smallest vec_id."""
    _, distinct = distinct_vectors(vectors, id_col, vector_col, label_col)
    got = shard_pairs(distinct, cosine, shard_rows, sample).groupBy("s1", "s2").applyInArrow(
        _pairs(cosine), "a long, b long, cosine double")
    ids = distinct.select("gid", "least_id")
    return got.join(ids.select(F.col("gid").alias("a"), F.col("least_id").alias("i")), "a").join(
        ids.select(F.col("gid").alias("b"), F.col("least_id").alias("j")), "b").select(
        F.least("i", "j").alias("vec_id_a"), F.greatest("i", "j").alias("vec_id_b"), "cosine")
