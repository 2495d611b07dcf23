"""Connected components of links, in a task (arrays) and across tasks (DataFrames)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.session import cut_lineage


class Forest:
    """Smallest index of each component over indexes 0..n-1; links are added in chunks and not kept."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Large-star and small-star rounds; each is written to the checkpoint folder.
    A hub's neighbours are never gathered: minima are aggregated partially and
    joined back, and AQE splits a skewed side."""
    e = cut_lineage(links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
                    .filter("a <> b").distinct())
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        # large star: neighbours above a node link to the smallest of its neighbours and itself
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
