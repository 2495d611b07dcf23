"""Expansion, excerpt ranking, result limit and source quota (QRY-7,
RNK-1..7).

Expansion is one pass: round k looks at the hits ranked <= L_k, with
L_1 = match_limit and L_k = int(match_limit * factor^(k-1)); the search stops
at the first round whose accepted excerpts reach match_limit (or when the
term has fewer hits than match_limit).  All per-term windows here see at most
L_last rows per term, so a term with millions of hits costs no more than any
other once the top-N limit has been applied.

The source quota is a deferred-acceptance fixpoint (RNK-5): every term
proposes its best K candidates not yet rejected; a source with more than
``cap`` proposals rejects, for good, every candidate behind its cap-th in term
order; repeat until no source is overfull.  With one priority order shared by all sources this
equals the serial walk (terms in order, each taking its next candidate whose
source still has room).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.session import cut_lineage, top_per_group


def expansion_limits(match_limit: int = 20, iterations: int = 3, factor: float = 2.0,
                     expand: bool = True) -> list[int]:
    """[L_1, ..., L_{iterations+1}] (just [match_limit] when disabled)."""
    if not expand:
        return [match_limit]
    return [match_limit] + [int(match_limit * factor ** (k - 1)) for k in range(2, iterations + 2)]


def select_round(scored: DataFrame, limits: list[int], match_limit: int, mode: str = "cumulative") -> DataFrame:
    """QRY-7 on scored excerpts (term_no, rank, penalty, n_hits, ...).

    Adds ``round`` (the round the search stopped at) and keeps the accepted
    excerpts of that round: all ranks <= L_round in 'cumulative' mode (the
    documented intent), only the ranks of that round's band in 'band' mode
    (what the reference's loop actually keeps)."""
    if mode not in ("cumulative", "band"):
        raise ValueError("mode must be 'cumulative' or 'band'")
    w = Window.partitionBy("term_no")
    acc = F.col("penalty").isNotNull()
    counts = []
    for k, lim in enumerate(limits):
        lower = limits[k - 1] if (mode == "band" and k > 0) else 0
        counts.append(F.sum(F.when(acc & (F.col("rank") > lower) & (F.col("rank") <= lim), 1).otherwise(0)).over(w))
    stop = None
    for k in range(len(limits)):
        cond = (counts[k] >= match_limit) | (F.col("n_hits") < match_limit) if k == 0 else counts[k] >= match_limit
        stop = F.when(cond, F.lit(k + 1)) if stop is None else stop.when(cond, F.lit(k + 1))
    stop = stop.otherwise(F.lit(len(limits)))
    lims = F.array(*[F.lit(x) for x in limits])
    out = scored.withColumn("round", stop)
    hi = F.element_at(lims, F.col("round"))
    lo = F.when(F.col("round") > 1, F.element_at(lims, F.col("round") - 1)).otherwise(0) if mode == "band" else F.lit(0)
    return out.filter(acc & (F.col("rank") > lo) & (F.col("rank") <= hi))


def order_excerpts(cands: DataFrame) -> DataFrame:
    """RNK-1: ex_rank = position by (penalty, relevance rank, line_no)."""
    w = Window.partitionBy("term_no").orderBy("penalty", "rank", "line_no")
    return cands.withColumn("ex_rank", F.row_number().over(w))


def limit_results(cands: DataFrame, result_limit: int = 5) -> DataFrame:
    """RNK-2 without a quota: the first ``result_limit`` excerpts per term."""
    return cands.filter(F.col("ex_rank") <= result_limit)


def apply_source_quota(cands: DataFrame, result_limit: int = 5, source_cap: int = 129,
                       usage: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """RNK-3..5: per-term results under a cap of ``source_cap`` results per
    source (docid) over all terms.  ``usage`` (docid, n) counts earlier
    emissions and lowers the remaining room of a source.

    Every round is a bounded amount of work: proposals are at most
    result_limit per term, and a source's first ``cap`` of them come from a
    top-k that Spark limits inside each task.  The state is one row per full
    source: its last acceptable candidate.  A source that is full keeps that
    or a better one for good, so everything behind it is rejected at once.

    The loop ends on its own: every round that does not stop moves a cutoff
    forward.  ``max_rounds`` is an optional guard; none by default."""
    base = cands.select("term_no", "ex_rank", "docid")
    if usage is not None:
        used = usage.groupBy("docid").agg(F.sum("n").alias("_used"))
        base = base.join(used, "docid", "left").withColumn(
            "_room", F.greatest(F.lit(source_cap) - F.coalesce("_used", F.lit(0)), F.lit(0))).drop("_used")
    else:
        base = base.withColumn("_room", F.lit(source_cap))
    best = [F.col("ex_rank")]
    base = cut_lineage(base)
    cutoffs, rounds = None, 0
    while True:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"source quota did not converge in {max_rounds} rounds")
        live = base
        if cutoffs is not None:
            live = live.join(cutoffs, "docid", "left").filter(
                F.col("_last").isNull() | (F.struct("term_no", "ex_rank") <= F.col("_last"))).drop("_last")
        proposed = cut_lineage(top_per_group(live, ["term_no"], best, result_limit, "_k").drop("_k"))
        full = (proposed.groupBy("docid").agg(F.count(F.lit(1)).alias("_n"), F.min("_room").alias("_r"))
                .filter(F.col("_n") > F.col("_r")).select("docid"))
        # the room-th proposal of an overfull source; none is before (-1, -1)
        ranked = top_per_group(proposed.join(full, "docid", "left_semi"), ["docid"],
                               [F.col("term_no"), F.col("ex_rank")], source_cap + 1, "_s")
        at_room = F.when(F.col("_s") == F.col("_room"), F.struct("term_no", "ex_rank"))
        nothing = F.struct(F.lit(-(2 ** 63)).cast("long").alias("term_no"), F.lit(-1).alias("ex_rank"))
        new = ranked.groupBy("docid").agg(F.coalesce(F.max(at_room), nothing).alias("_last"))
        new = cut_lineage(new)
        if new.isEmpty():
            return cands.join(proposed.select("term_no", "ex_rank"), ["term_no", "ex_rank"], "left_semi")
        # a source's cutoff only moves forward in priority, so the latest one holds
        cutoffs = new if cutoffs is None else cut_lineage(
            cutoffs.join(new, "docid", "left_anti").unionByName(new))


def source_usage(results: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """RNK-6: emissions per source, added to an earlier usage table."""
    now = results.groupBy("docid").agg(F.count(F.lit(1)).alias("n"))
    if usage is None:
        return now
    return now.unionByName(usage.select("docid", "n")).groupBy("docid").agg(F.sum("n").alias("n"))
