"""Matching texts with a table of patterns (a theta-join), in blocks.

Neither side is listed on the driver or written into the plan.  Patterns are
packed into arrays of at most BLOCK, one row a block; every text meets every
block by an equi-join on the block's number (broadcast if its measured size
allows) and tests the block's patterns inside its own row, so only matches
leave the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.session import maybe_broadcast

BLOCK = 1000


def matches(texts: DataFrame, patterns: DataFrame, number: str, test, max_broadcast_bytes: int | None = None,
            block: int = BLOCK) -> DataFrame:
    """(text, found): for every row of ``texts`` (one column, distinct) the
    patterns' rows that match, as structs ascending by the ``number`` column.
    ``test(text, pattern)`` takes Columns, the pattern being such a struct."""
    text = texts.columns[0]
    fields = [number, *[c for c in patterns.columns if c != number]]
    blocks = max(1, math.ceil(patterns.count() / block))
    packed = patterns.groupBy(F.pmod(F.col(number).cast("long"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(*fields)).alias("_items"))
    strings = [f.name for f in patterns.schema if f.dataType.simpleString() == "string"]

    def size(p: Column) -> Column:
        return sum((F.coalesce(F.length(p[c]), F.lit(0)) for c in strings), F.lit(8 * len(fields)))

    payload = F.aggregate("_items", F.lit(0).cast("long"), lambda n, p: n + size(p))
    packed, _ = maybe_broadcast(packed, [], max_broadcast_bytes, extra=payload)
    met = texts.select(text, F.explode(F.sequence(*[F.lit(b).cast("long") for b in (0, blocks - 1)])).alias("_block")).join(packed, "_block")
    found = met.select(text, F.filter("_items", lambda p: test(F.col(text), p)).alias("_found"))
    return found.groupBy(text).agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("found"))


def check_patterns(patterns: DataFrame, column: str, what: str) -> DataFrame:
    """Raise on an invalid regular expression, before any corpus is read: one job for all of them."""
    try:
        patterns.agg(F.sum(F.rlike(F.lit("x"), F.col(column)).cast("int"))).collect()
    except Exception as exc:
        raise ValueError(f"invalid regular expression among the {what}") from exc
    return patterns
