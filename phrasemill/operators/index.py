"""Document table build (IDX-1..6).

Everything that depends only on the title (score digit, score rules, source
id) is computed once per distinct title, then joined back to the lines.  The
per-title table is tiny next to the corpus; it is broadcast when its measured
size allows and shuffle-joined otherwise (AQE splits a hot title).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions import analysis as A
from phrasemill.operators import theta
from phrasemill.session import maybe_broadcast
from phrasemill.sources.corpus import ScoreRule, rules_table

RULE_ROUND = 9
SPLITS_A_CORE = 2


def rule_applies(title: Column, rule: Column) -> Column:
    """IDX-1: EXACT is a case-sensitive substring test, REGEX a ``find``."""
    return F.when(rule["kind"] == "EXACT", F.contains(title, rule["text"])).otherwise(F.rlike(title, rule["text"]))


def apply_score_rules(titles: DataFrame, rules: DataFrame | list[ScoreRule], score_col: str = "base_score",
                      max_broadcast_bytes: int | None = None) -> DataFrame:
    """IDX-2: the ordered rule fold, per row of ``titles``.

    In file order, a matching rule with adjustment 0 drops the document and
    stops; any other matching rule adds its adjustment, and stops if flagged.
    Rules are a table: titles meet them in blocks (see ``theta``), and the
    matching ones of a title are folded in order of rule_no.
    Adds ``score`` (rounded to 9 decimals) and ``dropped``.
    """
    if isinstance(rules, list):
        if not rules:
            return titles.withColumn("score", F.col(score_col)).withColumn("dropped", F.lit(False))
        rules = rules_table(titles.sparkSession, rules)
    rules = rules.select("rule_no", "kind", "text", "adj", "stop")
    found = theta.matches(titles.select("title").distinct(), rules, "rule_no", rule_applies, max_broadcast_bytes)
    init = F.struct(F.col(score_col).cast("double").alias("score"),
                    F.lit(False).alias("done"), F.lit(False).alias("dropped"))

    def step(acc, r):
        live = ~acc["done"]
        zero = r["adj"] == 0
        return F.struct(
            F.when(live & ~zero, acc["score"] + r["adj"]).otherwise(acc["score"]).alias("score"),
            (acc["done"] | zero | r["stop"]).alias("done"),
            (acc["dropped"] | (live & zero)).alias("dropped"))

    folded = F.aggregate("found", init, step)
    out = titles.join(found, "title", "left").withColumn("_fold", F.coalesce(folded, init))
    return (out.withColumn("score", F.round(F.col("_fold.score"), RULE_ROUND))
            .withColumn("dropped", F.col("_fold.dropped")).select(*titles.columns, "score", "dropped"))


def source_table(lines: DataFrame, rules: DataFrame | list[ScoreRule]) -> DataFrame:
    """IDX-2/3 per distinct title: (title, docid, n_lines, score, dropped).

    docid = the first line number of the title (deterministic, unlike a
    thread race).  A partial aggregate runs map-side, so a title holding a
    third of all lines still produces one row per task before the shuffle."""
    per_title = (lines.groupBy("title")
                 .agg(F.min("line_no").alias("docid"), F.count(F.lit(1)).alias("n_lines"),
                      F.first("base_score").alias("base_score")))
    return apply_score_rules(per_title, rules)


def build_docs(lines: DataFrame, rules: DataFrame | list[ScoreRule], max_broadcast_bytes: int | None = None,
               partitions: int | None = None, starts: str | None = None) -> DataFrame:
    """IDX-2..4: docs(line_no, title, content, score, docid, toks, n_tokens).

    ``lines`` is the output of ``split_lines``/``parse_scores``; ``starts``
    names a column for the tokens' offsets, which a stored index takes."""
    sources = source_table(lines, rules).filter(~F.col("dropped")).select("title", "docid", "score")
    sources, _ = maybe_broadcast(sources, ["title"], max_broadcast_bytes)
    # The analysis is the expensive, row-local part: it must run on every
    # core.  A large corpus arrives in many input splits and needs no
    # shuffle; only an input with fewer splits than keep all cores busy
    # (a few big files) is hash-spread by line_no first.
    spark = lines.sparkSession
    n = partitions if partitions else int(spark.conf.get("spark.sql.shuffle.partitions"))
    enough = partitions if partitions else min(n, SPLITS_A_CORE * spark.sparkContext.defaultParallelism)
    spread = lines.repartition(n, "line_no") if lines.rdd.getNumPartitions() < enough else lines
    joined = spread.join(sources, "title").select("line_no", "title", "content", "score", "docid")
    if starts is not None:
        # as a stored index has them: sorted while a row holds its text only
        joined = joined.sortWithinPartitions("line_no")
    return A.with_tokens(joined, "content", "toks", starts)


def corpus_stats(docs: DataFrame) -> tuple[int, float]:
    """IDX-6: (N, average field length).  Two numbers to the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    n = int(row["n"] or 0)
    return n, (float(row["t"]) / n if n else 0.0)


def doc_freq(docs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """IDX-6: (token, df) — number of documents containing the token.

    With ``tokens`` (a one-column table of wanted tokens) only those are
    counted; the filter runs before the shuffle (broadcast when small)."""
    exploded = docs.select("line_no", F.explode(F.array_distinct("toks")).alias("token"))
    exploded = exploded.filter(F.col("token") != "")
    if tokens is not None:
        wanted, _ = maybe_broadcast(tokens.select("token").distinct(), ["token"])
        exploded = exploded.join(wanted, "token", "left_semi")
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of token arrays: each distinct token, the arrays that hold it and its occurrences."""
    for batch in batches:
        arrays = batch.column(0)
        size = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        words = arrays.flatten().dictionary_encode()
        code, k = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        if k:
            pairs = np.sort(np.repeat(np.arange(len(size)), size) * k + code)
            once = pairs[np.append(True, pairs[1:] != pairs[:-1])] % k
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(once, minlength=k)), pa.array(np.bincount(code, minlength=k))],
                                             names=["token", "df", "n"])


def token_counts(docs: DataFrame) -> DataFrame:
    """IDX-6 of all tokens: (token, df, n), documents that contain the token and its occurrences.  A token is
    counted within its Arrow batch first, so a row per batch and distinct token is shuffled."""
    return (docs.select("toks").mapInArrow(_count_tokens, "token string, df long, n long").filter(F.col("token") != "")
            .groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("n")))
