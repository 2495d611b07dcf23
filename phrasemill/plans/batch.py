"""The two commands of the original tool as Spark plans.

``build_index``: corpus lines -> document table (scores, rules, source ids,
tokens) written as Parquet, plus the rejected lines.
``run_batch``: document table + terms -> ranked, excerpted, scored,
quota-limited results (SNK-1 rows) and an explanation per result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions.formula import validate
from phrasemill.operators import excerpt as EX
from phrasemill.operators import index as IDX
from phrasemill.operators import postings as PO
from phrasemill.operators import ranking as RK
from phrasemill.operators import scoring as SC
from phrasemill.operators import search as S
from phrasemill.sources import corpus as C
from phrasemill.session import cut_lineage

DOCS_COLUMNS = ["line_no", "title", "content", "score", "docid", "toks", "n_tokens"]


def build_index(lines: DataFrame, rules: DataFrame | list | None = None, delimiter: str = C.P.DEFAULT_DELIMITER,
                pre_split: bool = False) -> tuple[DataFrame, DataFrame]:
    """lines(line_no, raw) -> (docs, rejects).  With ``pre_split`` the input
    already has (line_no, raw, title, content)."""
    good, rejects = C.parse_scores(lines) if pre_split else C.split_lines(lines, delimiter)
    return IDX.build_docs(good, [] if rules is None else rules), rejects


def write_index(docs: DataFrame, path: str) -> None:
    """SNK-3 / IDX-4: persist the document table (overwrites)."""
    docs.select(*DOCS_COLUMNS).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8."""
    return spark.read.parquet(path)


@dataclass(frozen=True)
class SearchConfig:
    match_limit: int = 20
    result_limit: int = 5
    source_cap: int | None = 129      # exact maximum results per source; None = no quota
    expand: bool = True
    expand_iterations: int = 3
    expand_factor: float = 2.0
    expand_mode: str = "cumulative"   # or "band" (the reference's loop)
    highlight_min: int = EX.HIGHLIGHT_MIN
    highlight_max: int = EX.HIGHLIGHT_MAX
    passage_pick: str = "last"
    formula: str = S.DEFAULT_FORMULA
    excluded_words: tuple[str, ...] | DataFrame | None = None   # patterns, or a table of them (word)
    scoring: SC.ExcerptScoring | None = None
    max_broadcast_bytes: int | None = None

    def excerpt_scoring(self) -> SC.ExcerptScoring:
        if self.scoring is not None:
            return self.scoring
        if isinstance(self.excluded_words, DataFrame):
            return SC.ExcerptScoring.default(self.highlight_min, self.highlight_max, excluded_column=SC.EXCLUDED)
        excl = list(self.excluded_words) if self.excluded_words is not None else None
        return SC.ExcerptScoring.default(self.highlight_min, self.highlight_max, excl)


def scored_excerpts(source: DataFrame | PO.Index, terms: DataFrame, cfg: SearchConfig = SearchConfig(),
                    usage: DataFrame | None = None) -> DataFrame:
    """Every hit within the last expansion limit, with its excerpt and
    excerpt score (penalty null = skipped, see skip_reason).  Equal terms are
    searched once; their rows are given to each of them at the end.

    ``source`` is the document table or a stored index: with an index, terms are
    looked up and only the contents of the ranked documents are read, with the offsets of their tokens."""
    docs = source.texts if isinstance(source, PO.Index) else source
    limits = RK.expansion_limits(cfg.match_limit, cfg.expand_iterations, cfg.expand_factor, cfg.expand)
    same = terms.filter("n_toks > 0").select("term_no", "term")
    once = terms.join(same.groupBy("term").agg(F.min("term_no").alias("term_no")), ["term", "term_no"])
    ranked = S.ranked_hits(source, once, formula=cfg.formula, limit=max(limits), usage=usage,
                           max_broadcast_bytes=cfg.max_broadcast_bytes)
    ranked = ranked.join(once.select("term_no", "term", "n_toks", "q"), "term_no")
    ranked = cut_lineage(ranked)
    ex = EX.excerpts(docs, ranked, cfg.highlight_min, cfg.highlight_max, cfg.passage_pick,
                     cfg.max_broadcast_bytes)
    if isinstance(cfg.excluded_words, DataFrame):
        ex = SC.mark_excluded(cut_lineage(ex), cfg.excluded_words, max_broadcast_bytes=cfg.max_broadcast_bytes)
    sc = SC.score_excerpts(F.col("excerpt"), F.col("term"), cfg.excerpt_scoring())
    scored = ex.withColumn("_sc", sc).select("*", "_sc.*").drop("_sc", "term_no")
    return scored.join(same, "term")


EXPLAIN_COLUMNS = ["tf", "n_tokens", "idf", "bm25", "docMatchCount", "n_hits", "ex_start", "ex_end"]


def run_batch(source: DataFrame | PO.Index, terms_raw: DataFrame, cfg: SearchConfig = SearchConfig(),
              usage: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """Results (term_no, result_no, term, excerpt, title, docid, line_no,
    rank, round, penalty, final_score): at most ``result_limit`` per term,
    at most ``source_cap`` per source over the whole batch.

    ``explain`` (RNK-7) adds the relevance breakdown (tf, field length, idf,
    bm25, docMatchCount, total hits) and the excerpt offsets; ``explain_batch``
    has the same for every excerpt that did not become a result, and why."""
    validate(terms_raw.sparkSession, cfg.formula)
    terms = S.normalize_terms(terms_raw)
    scored = cut_lineage(scored_excerpts(source, terms, cfg, usage))
    return _results(scored, cfg, usage, explain)


def _results(scored: DataFrame, cfg: SearchConfig, usage: DataFrame | None, explain: bool) -> DataFrame:
    limits = RK.expansion_limits(cfg.match_limit, cfg.expand_iterations, cfg.expand_factor, cfg.expand)
    cands = RK.order_excerpts(RK.select_round(scored, limits, cfg.match_limit, cfg.expand_mode))
    if cfg.source_cap is None:
        chosen = RK.limit_results(cands, cfg.result_limit)
    else:
        chosen = RK.apply_source_quota(cands, cfg.result_limit, cfg.source_cap, usage)
    w = Window.partitionBy("term_no").orderBy("ex_rank")
    cols = ["term_no", "result_no", "term", "excerpt", "title", "docid", "line_no", "rank",
            "round", "penalty", "final_score"] + (EXPLAIN_COLUMNS if explain else [])
    return chosen.withColumn("result_no", F.row_number().over(w)).select(*cols)


def explain_batch(source: DataFrame | PO.Index, terms_raw: DataFrame, cfg: SearchConfig = SearchConfig(),
                  usage: DataFrame | None = None) -> DataFrame:
    """RNK-7: every excerpt within the last expansion limit with the breakdown
    of its relevance, what each criterion gave it, and its outcome: 'result',
    its skip_reason, 'not in round' (beyond the round the search stopped at),
    'quota' (its source was full), or 'limit' (enough better ones)."""
    terms = S.normalize_terms(terms_raw)
    scored = cut_lineage(scored_excerpts(source, terms, cfg, usage))
    limits = RK.expansion_limits(cfg.match_limit, cfg.expand_iterations, cfg.expand_factor, cfg.expand)
    key = ["term_no", "line_no"]
    in_round = RK.order_excerpts(RK.select_round(scored, limits, cfg.match_limit, cfg.expand_mode)).select(
        *key, "ex_rank", "round")
    results = _results(scored, cfg, usage, False).select(*key, "result_no")
    # a candidate before a term's last result that is no result was refused by its source
    last = in_round.join(results, key).groupBy("term_no").agg(F.max("ex_rank").alias("_last"), F.count(F.lit(1)).alias("_n"))
    out = scored.join(in_round, key, "left").join(results, key, "left").join(last, "term_no", "left")
    short = F.coalesce("_n", F.lit(0)) < cfg.result_limit
    outcome = (F.when(F.col("result_no").isNotNull(), "result").when(F.col("penalty").isNull(), F.col("skip_reason"))
               .when(F.col("ex_rank").isNull(), "not in round")
               .when(short | (F.col("ex_rank") < F.col("_last")), "quota").otherwise("limit"))
    parts = SC.penalty_parts(F.col("excerpt"), F.col("term"), cfg.excerpt_scoring())
    return out.select(*key, "rank", "round", "ex_rank", "result_no", outcome.alias("outcome"), "penalty",
                      parts.alias("penalties"), "term", "title", "excerpt", "docid", "score", "final_score",
                      *EXPLAIN_COLUMNS)
