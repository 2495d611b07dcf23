"""Driver queries: one Spark plan per operator family, each with the DuckDB
SQL that must give the same rows.

Inputs are the driver tables: ``documents`` is the corpus (line_no = doc_id,
title = source, content = text, score = last digit of source); the terms are
all windows of 1-3 words of the whole ``benchmark`` texts and each text as one
phrase.  Every query runs over whole tables and whole texts; excerpts are the
real ones (EXC-1..5), the first passage of each hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions import analysis as A
from phrasemill.operators import index as IDX
from phrasemill.operators import postings as PO
from phrasemill.operators import ranking as RK
from phrasemill.operators import scoring as SC
from phrasemill.operators import search as S
from phrasemill.plans import batch as B
from phrasemill.plans import oracle_sql as O
from phrasemill.session import cut_lineage, ensure_checkpoint_dir
from phrasemill.sources import corpus as C
from phrasemill.sources import sinks

ROUND = 6
TOP_N = 20


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document index of ``documents`` (no score rules), cut from its
    lineage with a reliable checkpoint, as a stored index would be."""
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    return cut_lineage(IDX.build_docs(good, []))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalize_terms(C.terms_from_benchmark(spark, sf_dir))


# ---------------------------------------------------------------------------
# Analysis

def q_token_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    masked = A.mask_sentence_starts(F.col("content"))
    kept = F.filter("toks", lambda t: (t != F.lit("")) & (t != F.lit("\u0001")))
    return docs.select(
        "line_no",
        F.length(masked).cast("long").alias("masked_chars"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.size(F.array_distinct(kept)).cast("long").alias("n_distinct"),
        F.coalesce(F.aggregate(kept, F.lit(0).cast("long"), lambda a, t: a + F.length(t)), F.lit(0)).cast("long")
        .alias("token_chars"))


SQL_TOKEN_COUNTS = O.with_ctes(O.DOCS) + """
SELECT line_no, CAST(length(""" + O.masked("content") + """) AS BIGINT) AS masked_chars,
       CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(len(list_distinct(list_filter(toks, lambda t: t <> '' AND t <> chr(1)))) AS BIGINT) AS n_distinct,
       CAST(coalesce(list_sum(list_transform(list_filter(toks, lambda t: t <> '' AND t <> chr(1)), lambda t: length(t))), 0) AS BIGINT) AS token_chars
FROM docs"""


def q_masked_tokens(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("line_no", F.posexplode("toks").alias("pos", "token")).select(
        "line_no", F.col("pos").cast("long").alias("pos"), "token")


SQL_MASKED_TOKENS = O.with_ctes(O.DOCS) + """
SELECT line_no, CAST(i - 1 AS BIGINT) AS pos, toks[i] AS token
FROM docs, LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS i)"""


# ---------------------------------------------------------------------------
# Search

def q_phrase_hits(spark, sf_dir):
    hits = S.phrase_hits(_docs(spark, sf_dir), _terms(spark, sf_dir))
    return hits.select("term_no", "line_no", F.col("tf").cast("long").alias("tf"),
                       F.col("first_pos").cast("long").alias("first_pos"))


SQL_PHRASE_HITS = O.with_ctes(O.DOCS, O.TERMS, O.GRAMS, O.HITS) + """
SELECT term_no, line_no, CAST(tf AS BIGINT) AS tf, CAST(first_pos AS BIGINT) AS first_pos FROM hits"""


def q_term_summary(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    hits = S.phrase_hits(_docs(spark, sf_dir), terms)
    return S.term_summary(terms, hits).select("term_no", "term", F.col("n_hits").cast("long").alias("n_hits"))


SQL_TERM_SUMMARY = O.with_ctes(O.DOCS, O.TERMS, O.GRAMS, O.HITS) + """
SELECT t.term_no, t.term, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hits
FROM terms t LEFT JOIN (SELECT term_no, count(*) AS n FROM hits GROUP BY term_no) c ON t.term_no = c.term_no"""


def q_doc_freq(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    toks = terms.select(F.explode("toks").alias("token"))
    return IDX.doc_freq(_docs(spark, sf_dir), toks).select("token", F.col("df").cast("long").alias("df"))


SQL_DOC_FREQ = O.with_ctes(O.DOCS, O.TERMS, O.STATS, O.IDF) + """
SELECT token, CAST(df AS BIGINT) AS df FROM dfs"""


def _ranked_out(ranked: DataFrame) -> DataFrame:
    return ranked.select("term_no", "line_no", F.col("rank").cast("long").alias("rank"),
                         F.col("tf").cast("long").alias("tf"),
                         F.round("bm25", ROUND).alias("bm25"), F.round("final_score", ROUND).alias("final_score"))


def q_bm25_top(spark, sf_dir):
    return _ranked_out(S.ranked_hits(_docs(spark, sf_dir), _terms(spark, sf_dir), formula="_score", limit=TOP_N, starts=False))


def q_formula_top(spark, sf_dir):
    return _ranked_out(S.ranked_hits(_docs(spark, sf_dir), _terms(spark, sf_dir), limit=TOP_N, starts=False))


def _sql_ranked(formula_sql: str) -> str:
    return O.with_ctes(O.DOCS, O.DOCIDS, O.TERMS, O.GRAMS, O.HITS, O.STATS, O.IDF, O.scored_hits(formula_sql)) + f"""
SELECT term_no, line_no, CAST(rank AS BIGINT) AS rank, CAST(tf AS BIGINT) AS tf,
       round(bm25, {ROUND}) AS bm25, round(final_score, {ROUND}) AS final_score
FROM ranked WHERE rank <= {TOP_N}"""


SQL_BM25_TOP = _sql_ranked("bm25")
SQL_FORMULA_TOP = _sql_ranked(O.DEFAULT_FORMULA_SQL)


# ---------------------------------------------------------------------------
# Document table: score rules, source ids, rejects

# Rules over the driver's source names (src0..src19), in file order.  They
# exercise: an addition, a drop, a stop, an addition followed by a drop, and
# an earlier stop protecting from a later drop.
DEMO_RULES = [
    C.ScoreRule(1, "REGEX", r"src1\d", 0.5, False),
    C.ScoreRule(2, "EXACT", "src3", 0.0, True),
    C.ScoreRule(3, "REGEX", r"^src[2-4]$", -0.25, True),
    C.ScoreRule(4, "REGEX", r"5$", 0.125, False),
    C.ScoreRule(5, "REGEX", r"src1[5-9]", 0.0, False),
    C.ScoreRule(6, "EXACT", "src11", 1.0, True),
    C.ScoreRule(7, "REGEX", r"1", 0.0, False),
]


def q_score_rules(spark, sf_dir):
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    return IDX.source_table(good, DEMO_RULES).select(
        "title", "docid", F.col("n_lines").cast("long").alias("n_lines"),
        F.round("score", ROUND).alias("score"), "dropped")


def _rules_values() -> str:
    rows = ", ".join(f"({r.rule_no}, {O.q(r.kind)}, {O.q(r.text)}, {r.adj!r}::DOUBLE, {str(r.stop).lower()})"
                     for r in DEMO_RULES)
    return f"rules(rule_no, kind, text, adj, stop) AS (VALUES {rows})"


SQL_SCORE_RULES = "WITH " + _rules_values() + f""",
titles AS (SELECT source AS title, min(doc_id) AS docid, count(*) AS n_lines,
                  CAST(right(source, 1) AS DOUBLE) AS base FROM documents GROUP BY source),
m AS (SELECT t.title, r.* FROM titles t JOIN rules r
      ON CASE WHEN r.kind = 'EXACT' THEN contains(t.title, r.text) ELSE regexp_matches(t.title, r.text) END),
cut AS (SELECT title, min(rule_no) AS cut FROM m WHERE stop OR adj = 0 GROUP BY title),
agg AS (SELECT m.title, bool_or(m.adj = 0) AS dropped, sum(CASE WHEN m.adj <> 0 THEN m.adj ELSE 0 END) AS adj
        FROM m LEFT JOIN cut ON m.title = cut.title WHERE m.rule_no <= coalesce(cut.cut, 1000000) GROUP BY m.title)
SELECT t.title, t.docid, CAST(t.n_lines AS BIGINT) AS n_lines,
       round(round(t.base + coalesce(a.adj, 0), 9), {ROUND}) AS score, coalesce(a.dropped, false) AS dropped
FROM titles t LEFT JOIN agg a ON t.title = a.title"""


def q_source_ids(spark, sf_dir):
    good, _ = C.split_lines(C.lines_from_conversations(spark, sf_dir))
    return IDX.source_table(good, []).select("title", "docid", F.col("n_lines").cast("long").alias("n_lines"))


CONVERSATION_LINES = """conv AS (
  SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS line_no,
         role || ' ' || CAST(turn % 10 AS VARCHAR) AS title, text, CAST(turn % 10 AS DOUBLE) AS score
  FROM conversations)"""

SQL_SOURCE_IDS = "WITH " + CONVERSATION_LINES + """
SELECT title, min(line_no) AS docid, CAST(count(*) AS BIGINT) AS n_lines FROM conv GROUP BY 1"""

REJECT_DELIMITER = r"[.!?] "


def q_rejects(spark, sf_dir):
    _, rejects = C.split_lines(C.lines_from_documents(spark, sf_dir), REJECT_DELIMITER)
    return rejects


TEXT_LINES = """text_lines AS (
  SELECT doc_id * (SELECT max(len(string_split(text, chr(10)))) + 1 FROM documents) + i AS line_no, raw, i
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""

SQL_REJECTS = "WITH " + TEXT_LINES + f""",
s AS (SELECT line_no, raw, regexp_matches(raw, {O.q(REJECT_DELIMITER)}) AS has_delim,
             regexp_extract(raw, {O.q('(?s)^(.*?)' + REJECT_DELIMITER)}, 1) AS title FROM text_lines)
SELECT line_no, substring(raw, 1, 100) AS raw,
       CASE WHEN NOT has_delim THEN 'no delimiter' ELSE 'no score' END AS reason
FROM s WHERE NOT has_delim OR NOT regexp_matches(right(title, 1), '^[0-9]$')"""


# ---------------------------------------------------------------------------
# Excerpts, their scores, expansion, order, limits and the quota.

EXCLUDED_DEMO = ["the", "la", "und"]
LIMITS = [20, 40, 80, 160]
QUOTA_CAP = 3
LENIENT = dict(first_char_strict=False, excluded_strict=False, length_strict=False,
               excluded_penalty=40, first_char_penalty=7, length_penalty=3)


def _cfg(mn: int = 60, mx: int = 180, **kw) -> B.SearchConfig:
    return B.SearchConfig(highlight_min=mn, highlight_max=mx, passage_pick="first", **kw)


def _scored(spark, sf_dir, cfg):
    return B.scored_excerpts(_docs(spark, sf_dir), _terms(spark, sf_dir), cfg)


def _long(*names):
    return [F.col(c).cast("long").alias(c) for c in names]


def q_excerpts(spark, sf_dir):
    """EXC-1..5: every hit within the last expansion limit and its passage."""
    return _scored(spark, sf_dir, _cfg()).select("term_no", "line_no", *_long("rank", "ex_start", "ex_end"), "excerpt")


def q_excerpts_last(spark, sf_dir):
    """EXC-4: the same with the last passage of each hit (the default)."""
    return _scored(spark, sf_dir, B.SearchConfig()).select("term_no", "line_no", *_long("rank", "ex_start", "ex_end"), "excerpt")


def q_excerpt_penalties(spark, sf_dir):
    cfg = _cfg(excluded_words=tuple(EXCLUDED_DEMO))
    return _scored(spark, sf_dir, cfg).select("term_no", "line_no", *_long("penalty"), "skip_reason")


def q_excluded_words(spark, sf_dir):
    cfg = _cfg(scoring=SC.ExcerptScoring.default(60, 180, EXCLUDED_DEMO, **LENIENT))
    return _scored(spark, sf_dir, cfg).select("term_no", "line_no", *_long("penalty"), "skip_reason")


def _sql_word_any(col: str, words: list[str]) -> str:
    alt = "|".join(w.lower() for w in words)
    pat = r"(?:^|[^\p{L}\p{M}\p{Nd}_])(?:" + alt + r")(?:[^\p{L}\p{M}\p{Nd}_]|$)"
    return f"regexp_matches({col}, {O.q(pat)})"


def _sql_penalty_parts(mn: int, mx: int, excluded: bool | str, lenient: dict | None) -> tuple[str, str]:
    """(reason, penalty-without-reason) SQL over columns ``excerpt`` and ``term``."""
    first = r"regexp_matches(excerpt, '^[\p{Ll}\x{AA}\x{BA}]')"
    excl = f"(NOT {_sql_word_any('term', EXCLUDED_DEMO)} AND {_sql_word_any('excerpt', EXCLUDED_DEMO)})" if excluded else "false"
    excl = excluded if isinstance(excluded, str) else excl
    length = f"(length(excerpt) < {mn} OR length(excerpt) > {mx})"
    chars = ("len(regexp_extract_all(excerpt, '[\\p{Pc}\\p{Ps}\\p{Pe}\\p{Po}]')) "
             "+ len(regexp_extract_all(excerpt, '\\p{Lu}')) + len(regexp_extract_all(excerpt, '\\p{Nd}'))")
    if lenient is None:
        reason = (f"CASE WHEN excerpt IS NULL OR excerpt = '' THEN 'empty' WHEN {first} THEN 'first_char' "
                  f"WHEN {excl} THEN 'excluded_word' WHEN {length} THEN 'length' END")
        full = "0"
    else:
        reason = "CASE WHEN excerpt IS NULL OR excerpt = '' THEN 'empty' END"
        full = (f"(CASE WHEN {first} THEN {lenient['first_char_penalty']} ELSE 0 END"
                f" + CASE WHEN {excl} THEN {lenient['excluded_penalty']} ELSE 0 END"
                f" + CASE WHEN {length} THEN {lenient['length_penalty']} ELSE 0 END)")
    return reason, f"1 + {full} + {chars}"


def _sql_scored(mn: int = 60, mx: int = 180, excluded: bool | str = False, lenient: dict | None = None,
                marks: tuple[str, ...] = (), source: str = "excerpts") -> str:
    """... ``sc``: every hit within the last limit with excerpt, reason and penalty.  ``excluded`` may be a condition
    over the columns of ``source``, which ``marks`` define."""
    reason, pen = _sql_penalty_parts(mn, mx, excluded, lenient)
    return O.with_ctes(O.DOCS, O.DOCIDS, O.TERMS, O.GRAMS, O.HITS, O.STATS, O.IDF,
                       O.scored_hits(O.DEFAULT_FORMULA_SQL), O.OFFSETS, O.sentences(mn),
                       "nh AS (SELECT term_no, count(*) AS n_hits FROM hits GROUP BY term_no)",
                       f"""top AS (
  SELECT r.term_no, r.line_no, r.docid, r.rank, r.final_score, h.first_pos, t.term, t.q, nh.n_hits
  FROM ranked r JOIN hits h ON h.term_no = r.term_no AND h.line_no = r.line_no
       JOIN terms t ON t.term_no = r.term_no JOIN nh ON nh.term_no = r.term_no
  WHERE r.rank <= {max(LIMITS)})""",
                       O.passages("top", mn, mx), *marks,
                       f"""sc AS (SELECT *, CASE WHEN reason IS NULL THEN {pen} END AS penalty
       FROM {source}, LATERAL (SELECT {reason} AS reason))""")


SQL_EXCERPTS = _sql_scored() + """
SELECT term_no, line_no, CAST(rank AS BIGINT) AS rank, CAST(ex_start AS BIGINT) AS ex_start,
       CAST(ex_end AS BIGINT) AS ex_end, excerpt FROM sc"""


def _sql_excerpts_last(mn: int = 60, mx: int = 180) -> str:
    """Every token of every match is an occurrence; the first one opens a passage, the next one at or past its end
    another, and so on: a walk from passage to passage, whose last is kept."""
    head = O.with_ctes(O.DOCS, O.DOCIDS, O.TERMS, O.GRAMS, O.HITS, O.STATS, O.IDF,
                       O.scored_hits(O.DEFAULT_FORMULA_SQL), O.OFFSETS, O.sentences(mn),
                       f"""occ AS (
  SELECT DISTINCT r.term_no, r.line_no, r.rank, t.q, f.pos + unnest(range(t.n_toks)) AS first_pos
  FROM ranked r JOIN terms t ON t.term_no = r.term_no JOIN found f ON f.phrase = t.phrase AND f.line_no = r.line_no
  WHERE r.rank <= {max(LIMITS)})""",
                       O.passages("occ", mn, mx),
                       """steps AS (
  SELECT a.term_no, a.line_no, a.rank, a.s, a.ex_start, a.ex_end, a.excerpt, b.s AS next,
         a.s = min(a.s) OVER (PARTITION BY a.term_no, a.line_no) AS opens
  FROM excerpts a ASOF LEFT JOIN (SELECT term_no, line_no, s FROM excerpts) b
    ON a.term_no = b.term_no AND a.line_no = b.line_no AND a.ex_end <= b.s)""",
                       """walk AS (
  SELECT * FROM steps WHERE opens
  UNION ALL
  SELECT n.* FROM walk w JOIN steps n ON n.term_no = w.term_no AND n.line_no = w.line_no AND n.s = w.next)""")
    return "WITH RECURSIVE" + head[len("WITH"):] + """
SELECT term_no, line_no, CAST(rank AS BIGINT) AS rank, CAST(ex_start AS BIGINT) AS ex_start,
       CAST(ex_end AS BIGINT) AS ex_end, excerpt FROM walk WHERE next IS NULL"""


SQL_EXCERPTS_LAST = _sql_excerpts_last()
_SQL_PENALTIES = """
SELECT term_no, line_no, CAST(penalty AS BIGINT) AS penalty, reason AS skip_reason FROM sc"""
SQL_EXCERPT_PENALTIES = _sql_scored(excluded=True) + _SQL_PENALTIES
SQL_EXCLUDED_WORDS = _sql_scored(excluded=True, lenient=LENIENT) + _SQL_PENALTIES

# Excluded words as a file: all words of four letters of the benchmark, and a pattern that is no plain word.
EXCLUDED_PATTERN = "E[nr][a-z]*"


def q_excluded_text(spark, sf_dir):
    """SRC-7, SCO-2, SCO-8: excluded words written as a text file, read as a table and joined with the excerpts' words."""
    path = _folder(spark, "excluded")
    words = C.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("w"))
    (words.filter(F.length("w") == 4).distinct().unionByName(spark.range(1).select(F.lit(EXCLUDED_PATTERN).alias("w")))
     .unionByName(spark.range(1).select(F.lit("").alias("w"))).write.text(path))
    cfg = _cfg(excluded_words=C.read_excluded_words(spark, path))
    return _scored(spark, sf_dir, cfg).select("term_no", "line_no", *_long("penalty"), "skip_reason")


_NO_WORD = r"[^\p{L}\p{M}\p{Nd}_]"
_MARKS = (
    "words AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')) AS w FROM benchmark) WHERE length(w) = 4)",
    "seen AS (SELECT DISTINCT excerpt AS text FROM excerpts UNION SELECT DISTINCT term FROM excerpts)",
    f"""having_word AS (
  SELECT DISTINCT text FROM (SELECT text, unnest(string_split_regex(text, {O.q(_NO_WORD + '+')})) AS w FROM seen) WHERE w IN (SELECT w FROM words)
  UNION
  SELECT text FROM seen WHERE regexp_matches(text, {O.q('(?:^|' + _NO_WORD + ')(?:' + EXCLUDED_PATTERN.lower() + ')(?:' + _NO_WORD + '|$)')}))""",
    """marked_excerpts AS (
  SELECT e.*, he.text IS NOT NULL AND ht.text IS NULL AS excl
  FROM excerpts e LEFT JOIN having_word he ON he.text = e.excerpt LEFT JOIN having_word ht ON ht.text = e.term)""")
SQL_EXCLUDED_TEXT = _sql_scored(excluded="excl", marks=_MARKS, source="marked_excerpts") + _SQL_PENALTIES


def _sql_round(mode: str) -> str:
    """``ord``: the accepted excerpts of each term's last round, in excerpt order."""
    lims = "[" + ", ".join(str(x) for x in LIMITS) + "]"
    lows = [0] + (LIMITS[:-1] if mode == "band" else [0] * (len(LIMITS) - 1))
    counts = ", ".join(f"sum(CASE WHEN penalty IS NOT NULL AND rank > {lo} AND rank <= {x} THEN 1 ELSE 0 END) AS c{i}"
                       for i, (lo, x) in enumerate(zip(lows, LIMITS)))
    low_of_round = ("CASE WHEN rnd.round > 1 THEN " + lims + "[rnd.round - 1] ELSE 0 END") if mode == "band" else "0"
    rounds = " ".join(f"WHEN c{i} >= {LIMITS[0]} THEN {i + 1}" for i in range(1, len(LIMITS)))
    return f""",
cnt AS (SELECT term_no, max(n_hits) AS n_hits, {counts} FROM sc GROUP BY term_no),
rnd AS (SELECT term_no, CASE WHEN c0 >= {LIMITS[0]} OR n_hits < {LIMITS[0]} THEN 1 {rounds} ELSE {len(LIMITS)} END AS round
        FROM cnt),
acc AS (SELECT sc.*, rnd.round FROM sc JOIN rnd ON sc.term_no = rnd.term_no
        WHERE penalty IS NOT NULL AND rank > {low_of_round} AND rank <= {lims}[rnd.round]),
ord AS (SELECT *, row_number() OVER (PARTITION BY term_no ORDER BY penalty, rank, line_no) AS ex_rank FROM acc)"""


def _accepted(spark, sf_dir, mode):
    cfg = _cfg(expand_mode=mode)
    return RK.select_round(_scored(spark, sf_dir, cfg), LIMITS, LIMITS[0], mode)


def q_result_limit(spark, sf_dir, mode: str = "cumulative"):
    """QRY-7, RNK-1, RNK-2: expansion rounds, excerpt order, first 5 per term."""
    cands = RK.order_excerpts(_accepted(spark, sf_dir, mode))
    return RK.limit_results(cands, 5).select(
        "term_no", F.col("ex_rank").cast("long").alias("result_no"), "line_no", *_long("penalty", "round"))


def q_result_limit_band(spark, sf_dir):
    """The same with only the band of the last round (SURVEY Q1)."""
    return q_result_limit(spark, sf_dir, "band")


def _sql_result_limit(mode: str) -> str:
    return _sql_scored() + _sql_round(mode) + """
SELECT term_no, CAST(ex_rank AS BIGINT) AS result_no, line_no, CAST(penalty AS BIGINT) AS penalty,
       CAST(round AS BIGINT) AS round
FROM ord WHERE ex_rank <= 5"""


SQL_RESULT_LIMIT, SQL_RESULT_LIMIT_BAND = _sql_result_limit("cumulative"), _sql_result_limit("band")


def q_expansion_rounds(spark, sf_dir):
    """QRY-7: the round each term's search stopped at and its accepted
    excerpts, for both expansion modes."""
    scored = cut_lineage(_scored(spark, sf_dir, _cfg()))
    out = None
    for mode in ("cumulative", "band"):
        agg = RK.select_round(scored, LIMITS, LIMITS[0], mode).groupBy("term_no").agg(
            F.first("round").cast("long").alias("round"), F.count(F.lit(1)).alias("n_accepted")).withColumn("mode", F.lit(mode))
        out = agg if out is None else out.unionByName(agg)
    return out


SQL_EXPANSION_ROUNDS = " UNION ALL ".join(
    f"SELECT * FROM ({_sql_scored()}{_sql_round(mode)} SELECT term_no, CAST(any_value(round) AS BIGINT) AS round, "
    f"count(*) AS n_accepted, '{mode}' AS mode FROM ord GROUP BY term_no)" for mode in ("cumulative", "band"))


def _batch(spark, sf_dir, cfg):
    return B.run_batch(_docs(spark, sf_dir), C.terms_from_benchmark(spark, sf_dir), cfg)


def q_run_batch(spark, sf_dir):
    """The whole batch search with the default quota, on the stored index."""
    out = B.run_batch(_index(spark, sf_dir), C.terms_from_benchmark(spark, sf_dir), _cfg())
    return out.select("term_no", *_long("result_no"), "term", "excerpt", "title")


def q_source_cap(spark, sf_dir):
    """RNK-3..5 with a cap that binds."""
    return _batch(spark, sf_dir, _cfg(source_cap=QUOTA_CAP)).select("term_no", *_long("result_no"), "docid", "line_no")


def q_source_quota(spark, sf_dir):
    """The same with other excerpt lengths."""
    return _batch(spark, sf_dir, _cfg(20, 400, source_cap=QUOTA_CAP)).select(
        "term_no", *_long("result_no"), "docid", "line_no")


def q_source_usage(spark, sf_dir):
    return RK.source_usage(_batch(spark, sf_dir, _cfg())).select("docid", *_long("n"))


def _sql_batch(cap: int, mn: int = 60, mx: int = 180) -> str:
    """``chosen``: the serial rule, one term after the other: a term takes its
    next candidates whose source still has room, up to five.  ``walk`` keeps the
    number of results of each source so far."""
    head = _sql_scored(mn, mx) + _sql_round("cumulative")
    assert head.startswith("WITH ")
    return "WITH RECURSIVE " + head[len("WITH "):] + f""",
cands AS (SELECT o.term_no, o.ex_rank, o.line_no, o.docid, o.term, o.excerpt,
                 dense_rank() OVER (ORDER BY o.term_no) AS tord FROM ord o),
per_term AS (SELECT tord, list(struct_pack(ex_rank := ex_rank, docid := docid) ORDER BY ex_rank) AS cs FROM cands GROUP BY tord),
walk(i, docid, cnt, took) AS (
  SELECT CAST(0 AS BIGINT), docid, CAST(0 AS BIGINT), []::BIGINT[] FROM (SELECT DISTINCT docid FROM cands)
  UNION ALL
  SELECT i, docid, cnt + len(took), took FROM (
    SELECT x.i, x.docid, x.cnt, coalesce(list(x.ex_rank) FILTER (WHERE x.taken), []::BIGINT[]) AS took
    FROM (
      SELECT y.*, y.eligible AND sum(CASE WHEN y.eligible THEN 1 ELSE 0 END)
               OVER (ORDER BY y.ex_rank NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 5 AS taken
      FROM (
        SELECT w.i + 1 AS i, w.docid, w.cnt, c.ex_rank,
               c.ex_rank IS NOT NULL AND row_number() OVER (PARTITION BY w.docid ORDER BY c.ex_rank) <= {cap} - w.cnt AS eligible
        FROM walk w LEFT JOIN (
          SELECT tord, unnest(cs, recursive := true) FROM per_term) c ON c.tord = w.i + 1 AND c.docid = w.docid
        WHERE w.i < (SELECT max(tord) FROM per_term)) y) x
    GROUP BY x.i, x.docid, x.cnt)),
chosen AS (
  SELECT c.*, CAST(row_number() OVER (PARTITION BY c.term_no ORDER BY c.ex_rank) AS BIGINT) AS result_no
  FROM (SELECT i, unnest(took) AS ex_rank FROM walk) a JOIN cands c ON c.tord = a.i AND c.ex_rank = a.ex_rank)"""


SQL_RUN_BATCH = _sql_batch(129) + """
SELECT c.term_no, c.result_no, c.term, c.excerpt, d.title FROM chosen c JOIN docs d ON d.line_no = c.line_no"""
SQL_SOURCE_USAGE = _sql_batch(129) + "\nSELECT docid, count(*) AS n FROM chosen GROUP BY docid"
_SQL_CHOSEN = "\nSELECT term_no, result_no, docid, line_no FROM chosen"
SQL_SOURCE_CAP = _sql_batch(QUOTA_CAP) + _SQL_CHOSEN
SQL_SOURCE_QUOTA = _sql_batch(QUOTA_CAP, 20, 400) + _SQL_CHOSEN


# ---------------------------------------------------------------------------
# Output formatting rules (SNK-2)

FORMAT_RULES = {"text": [(r"[ \t\n\x0B\f\r]+", " ", False), (r"[0-9]+", "#", True), ("#", "NUM", False),
                         ("[A-Z]", "*", False)]}


def q_format_columns(spark, sf_dir):
    from phrasemill.sources.sinks import format_columns
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return format_columns(docs, FORMAT_RULES)


SQL_FORMAT_COLUMNS = r"""
SELECT doc_id, CASE WHEN regexp_matches(t1, '[0-9]+') THEN regexp_replace(t1, '[0-9]+', '#', 'g')
                    ELSE regexp_replace(regexp_replace(t1, '#', 'NUM', 'g'), '[A-Z]', '*', 'g') END AS text
FROM (SELECT doc_id, regexp_replace(text, '[ 	

]+', ' ', 'g') AS t1 FROM documents)"""


# ---------------------------------------------------------------------------
# Second corpus: conversation turns as corpus lines (title<delim>content split
# by the regular-expression delimiter), searched with the same terms.

def q_conversation_hits(spark, sf_dir):
    good, _ = C.split_lines(C.lines_from_conversations(spark, sf_dir))
    hits = S.phrase_hits(IDX.build_docs(good, []), _terms(spark, sf_dir))
    return hits.select("term_no", "line_no", F.col("tf").cast("long").alias("tf"),
                       F.col("first_pos").cast("long").alias("first_pos"))


DOCS_CONVERSATIONS = f"""docs AS (
  SELECT line_no, title, content, score, toks, n_tokens FROM {O.analyzed(
      "SELECT line_no, title, text AS content, score FROM conv", "content")}
)"""

SQL_CONVERSATION_HITS = O.with_ctes(CONVERSATION_LINES, DOCS_CONVERSATIONS, O.TERMS, O.GRAMS, O.HITS) + """
SELECT term_no, line_no, CAST(tf AS BIGINT) AS tf, CAST(first_pos AS BIGINT) AS first_pos FROM hits"""


# ---------------------------------------------------------------------------
# Text inputs, the stored index and the remaining outputs.  Files are written
# under the shared folder that the session names (spark.checkpoint.dir).

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _index(spark, sf_dir) -> PO.Index:
    path = _folder(spark, "index")
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    # written by write_index at once, offsets included: no checkpoint before
    PO.write_index(IDX.build_docs(good, [], starts=PO.STARTS), path)
    return PO.load_index(spark, path)


def q_postings(spark, sf_dir):
    """IDX-4, TXT-6: every token occurrence of the stored index with its place in the content."""
    return _index(spark, sf_dir).postings.select("token", "line_no", *_long("pos", "start", "end"))


SQL_POSTINGS = O.with_ctes(O.DOCS, O.OFFSETS) + """
SELECT t.token, t.line_no, CAST(t.pos AS BIGINT) AS pos, s.s AS start, s.s + length(t.token) AS "end"
FROM (SELECT line_no, i - 1 AS pos, toks[i] AS token
      FROM (SELECT line_no, toks, unnest(range(1, len(toks) + 1)) AS i FROM docs)) t
JOIN starts s ON s.line_no = t.line_no AND s.pos = t.pos
WHERE t.token <> '' AND t.token <> chr(1)"""


def q_indexed_hits(spark, sf_dir):
    """QRY-2, QRY-3, SRC-8, SNK-3: the same hits from the stored index."""
    hits = PO.phrase_hits(_index(spark, sf_dir), _terms(spark, sf_dir))
    return hits.select("term_no", "line_no", *_long("tf", "first_pos"))


def q_corpus_text(spark, sf_dir):
    """SRC-1..4: the documents' lines written as a text corpus, read and numbered again."""
    path = _folder(spark, "corpus")
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    (docs.repartitionByRange("doc_id", "i").sortWithinPartitions("doc_id", "i")
     .select(F.concat("source", F.lit(".txt:"), "line").alias("value")).write.option("lineSep", "\n").text(path))
    # every written file ends with a line feed: one empty line a file, which is rejected
    lines = C.read_corpus(spark, path).withColumn("line_no", F.col("line_no") - F.col("file_no"))
    good, _ = C.split_lines(lines)
    return good.select("line_no", "title", "content", "base_score")


SQL_CORPUS_TEXT = """
SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, source AS title, line AS content, CAST(right(source, 1) AS DOUBLE) AS base_score
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""


def q_rules_text(spark, sf_dir):
    """SRC-5, IDX-1, IDX-2: one rule per source, written as rule lines, read back and folded."""
    path = _folder(spark, "rules")
    digit = F.substring("source", -1, 1).cast("int")
    (C.table(spark, sf_dir, "documents").select("source").distinct().repartitionByRange("source").sortWithinPartitions("source")
     .select(F.concat_ws("\t", F.when(digit % 2 == 0, "REGEX").otherwise("EXACT"), F.concat("source", F.when(digit % 2 == 0, "$").otherwise("")),
                         ((digit - 3) / 4).cast("string"), F.when(digit % 4 == 0, "T").otherwise("F")).alias("value"))
     .write.text(path))
    good, _ = C.parse_scores(C.staged_from_documents(spark, sf_dir))
    return IDX.source_table(good, C.read_rules(spark, path)).select("title", F.round("score", ROUND).alias("score"), "dropped")


SQL_RULES_TEXT = f"""
WITH titles AS (SELECT source AS title, CAST(right(source, 1) AS DOUBLE) AS base FROM documents GROUP BY source),
rules AS (SELECT row_number() OVER (ORDER BY title) AS rule_no, title AS text, base % 2 = 0 AS regex,
                 (base - 3) / 4 AS adj, base % 4 = 0 AS stop FROM titles),
m AS (SELECT t.title, r.rule_no, r.adj, r.stop FROM titles t JOIN rules r
      ON CASE WHEN r.regex THEN suffix(t.title, r.text) ELSE contains(t.title, r.text) END),
cut AS (SELECT title, min(rule_no) AS cut FROM m WHERE stop OR adj = 0 GROUP BY title),
agg AS (SELECT m.title, bool_or(m.adj = 0) AS dropped, sum(m.adj) AS adj
        FROM m LEFT JOIN cut ON m.title = cut.title WHERE m.rule_no <= coalesce(cut.cut, 1000000) GROUP BY m.title)
SELECT t.title, round(t.base + coalesce(a.adj, 0), {ROUND}) AS score, coalesce(a.dropped, false) AS dropped
FROM titles t LEFT JOIN agg a ON t.title = a.title"""


def q_terms_text(spark, sf_dir):
    """SRC-6, QRY-1: the benchmark's terms written as a term file (some lines blank), read and normalised."""
    path = _folder(spark, "terms")
    terms = C.terms_from_benchmark(spark, sf_dir)
    (terms.repartitionByRange("term_no").sortWithinPartitions("term_no")
     .select(F.explode(F.array(F.concat("term", F.lit(".")), F.lit("  "), F.concat(F.lit("-"), "term"))).alias("value")).write.text(path))
    return S.normalize_terms(C.read_terms(spark, path)).select("term_no", "term", "phrase", *_long("n_toks", "q"))


SQL_TERMS_TEXT = O.with_ctes(O.TERMS) + """,
lines AS (SELECT row_number() OVER (ORDER BY term_no, k) AS term_no, CASE k WHEN 1 THEN term || '.' WHEN 2 THEN '  ' ELSE '-' || term END AS term
          FROM raw_terms, (VALUES (1), (2), (3)) v(k))
SELECT term_no, term, phrase, CAST(len(string_split(phrase, ' ')) AS BIGINT) AS n_toks, CAST(length(term) AS BIGINT) AS q
FROM (SELECT term_no, term, trim(replace(replace(term, '-', ' '), '.', ''), ' ') AS phrase FROM lines)
WHERE trim(term) <> ''"""


def q_results_tsv(spark, sf_dir):
    """SNK-1: the lines of the results file, written and read."""
    path = _folder(spark, "results")
    sinks.write_results_tsv(_batch(spark, sf_dir, _cfg()), path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


SQL_RESULTS_TSV = _sql_batch(129) + r"""
SELECT c.term || chr(9) || regexp_replace(c.excerpt, '[\t\r\n]', ' ', 'g') || chr(9) || regexp_replace(d.title, '[\t\r\n]', ' ', 'g') AS line
FROM chosen c JOIN docs d ON d.line_no = c.line_no"""


def q_adhoc_search(spark, sf_dir):
    """QRY-9: the ranked documents of one phrase on the stored index: the two words of the benchmark that stand side by
    side in most documents."""
    index = _index(spark, sf_dir)
    pairs = S.normalize_terms(C.terms_from_benchmark(spark, sf_dir, sizes=(2,), whole=False))
    pairs = pairs.groupBy("phrase", "toks", "n_toks", "q").agg(F.min("term_no").alias("term_no"))
    counts = PO.phrase_counts(index, pairs).groupBy("term_no").agg(F.count(F.lit(1)).alias("n"))
    best = counts.join(pairs, "term_no").orderBy(F.desc("n"), "phrase").first()
    found = S.search_phrase(index, best["phrase"] if best else "")
    return found.select("line_no", *_long("rank", "tf"), F.round("final_score", ROUND).alias("final_score"))


SQL_ADHOC_SEARCH = O.with_ctes(O.DOCS, O.DOCIDS, O.TERMS, O.GRAMS, O.HITS, O.STATS, O.IDF,
                               O.scored_hits(O.DEFAULT_FORMULA_SQL)) + f"""
SELECT line_no, CAST(rank AS BIGINT) AS rank, CAST(tf AS BIGINT) AS tf, round(final_score, {ROUND}) AS final_score
FROM ranked WHERE rank <= {TOP_N} AND term_no = (
  SELECT min(t.term_no) FROM terms t JOIN (
    SELECT h.phrase, count(*) AS n FROM phrase_hits h JOIN phrases p ON p.phrase = h.phrase WHERE p.n_toks = 2
    GROUP BY h.phrase ORDER BY n DESC, h.phrase LIMIT 1) b ON b.phrase = t.phrase)"""


def q_explain(spark, sf_dir):
    """RNK-7: what became of every excerpt, with a cap that binds."""
    out = B.explain_batch(_docs(spark, sf_dir), C.terms_from_benchmark(spark, sf_dir), _cfg(source_cap=QUOTA_CAP))
    return out.select("term_no", "line_no", *_long("rank", "ex_rank", "result_no", "penalty"), "outcome",
                      F.col("penalties.punctuation").cast("long").alias("punctuation"), F.round("bm25", ROUND).alias("bm25"))


SQL_EXPLAIN = _sql_batch(QUOTA_CAP) + rf""",
last AS (SELECT term_no, max(ex_rank) AS last, count(*) AS n FROM chosen GROUP BY term_no)
SELECT s.term_no, s.line_no, CAST(s.rank AS BIGINT) AS rank, CAST(o.ex_rank AS BIGINT) AS ex_rank, c.result_no,
       CAST(s.penalty AS BIGINT) AS penalty,
       CASE WHEN c.result_no IS NOT NULL THEN 'result' WHEN s.penalty IS NULL THEN s.reason WHEN o.ex_rank IS NULL THEN 'not in round'
            WHEN coalesce(l.n, 0) < 5 OR o.ex_rank < l.last THEN 'quota' ELSE 'limit' END AS outcome,
       CAST(len(regexp_extract_all(s.excerpt, '[\p{{Pc}}\p{{Ps}}\p{{Pe}}\p{{Po}}]')) AS BIGINT) AS punctuation, round(r.bm25, {ROUND}) AS bm25
FROM sc s JOIN ranked r ON r.term_no = s.term_no AND r.line_no = s.line_no
LEFT JOIN ord o ON o.term_no = s.term_no AND o.line_no = s.line_no
LEFT JOIN chosen c ON c.term_no = s.term_no AND c.line_no = s.line_no LEFT JOIN last l ON l.term_no = s.term_no"""

CUSTOM_FORMULA = "max(min(_score, 3), 0.5) + trunc(score / 2) / 10 + haversin(0, 0, 0, score) / 1000"


def q_custom_scoring(spark, sf_dir):
    """UDF-1, UDF-2: a user's criteria and a formula with the helper functions."""
    shout = SC.FullCriterion("shout", lambda e, t: e.contains("!"), penalty=5, strict=False, last=True)
    scoring = SC.ExcerptScoring((shout, SC.length_outside(20, 170)), (SC.CharCriterion("vowels", "[aeiou]", 2),))
    cfg = _cfg(scoring=scoring, formula=CUSTOM_FORMULA)
    return _scored(spark, sf_dir, cfg).select("term_no", "line_no", *_long("rank", "penalty"), "skip_reason",
                                              F.round("final_score", ROUND).alias("final_score"))


def _sql_custom() -> str:
    formula = ("greatest(least(bm25, 3), 0.5) + trunc(score / 2) / 10 "
               "+ 2 * 6371.0 * asin(sqrt(pow(sin(radians(0) / 2), 2) + cos(radians(0)) * cos(radians(0)) * pow(sin(radians(score) / 2), 2))) / 1000")
    head = _sql_scored().replace(O.DEFAULT_FORMULA_SQL, formula)
    return head + f"""
SELECT term_no, line_no, CAST(rank AS BIGINT) AS rank,
       CASE WHEN excerpt = '' THEN NULL WHEN NOT contains(excerpt, '!') AND (length(excerpt) < 20 OR length(excerpt) > 170) THEN NULL
            ELSE CAST(1 + CASE WHEN contains(excerpt, '!') THEN 5 ELSE 0 END + 2 * len(regexp_extract_all(excerpt, '[aeiou]')) AS BIGINT) END AS penalty,
       CASE WHEN excerpt = '' THEN 'empty' WHEN NOT contains(excerpt, '!') AND (length(excerpt) < 20 OR length(excerpt) > 170) THEN 'length' END AS skip_reason,
       round(final_score, {ROUND}) AS final_score
FROM sc"""


SQL_CUSTOM_SCORING = _sql_custom()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "token_counts": q_token_counts,
    "masked_tokens": q_masked_tokens,
    "phrase_hits": q_phrase_hits,
    "term_summary": q_term_summary,
    "conversation_hits": q_conversation_hits,
    "doc_freq": q_doc_freq,
    "bm25_top": q_bm25_top,
    "formula_top": q_formula_top,
    "score_rules": q_score_rules,
    "source_ids": q_source_ids,
    "rejects": q_rejects,
    "excerpt_penalties": q_excerpt_penalties,
    "excluded_words": q_excluded_words,
    "excluded_text": q_excluded_text,
    "format_columns": q_format_columns,
    "result_limit": q_result_limit,
    "result_limit_band": q_result_limit_band,
    "source_cap": q_source_cap,
    "excerpts": q_excerpts,
    "excerpts_last": q_excerpts_last,
    "expansion_rounds": q_expansion_rounds,
    "run_batch": q_run_batch,
    "source_quota": q_source_quota,
    "source_usage": q_source_usage,
    "postings": q_postings,
    "indexed_hits": q_indexed_hits,
    "corpus_text": q_corpus_text,
    "rules_text": q_rules_text,
    "terms_text": q_terms_text,
    "results_tsv": q_results_tsv,
    "adhoc_search": q_adhoc_search,
    "explain": q_explain,
    "custom_scoring": q_custom_scoring,
}

ORACLE: dict[str, str] = {
    "token_counts": SQL_TOKEN_COUNTS,
    "masked_tokens": SQL_MASKED_TOKENS,
    "phrase_hits": SQL_PHRASE_HITS,
    "term_summary": SQL_TERM_SUMMARY,
    "conversation_hits": SQL_CONVERSATION_HITS,
    "doc_freq": SQL_DOC_FREQ,
    "bm25_top": SQL_BM25_TOP,
    "formula_top": SQL_FORMULA_TOP,
    "score_rules": SQL_SCORE_RULES,
    "source_ids": SQL_SOURCE_IDS,
    "rejects": SQL_REJECTS,
    "excerpt_penalties": SQL_EXCERPT_PENALTIES,
    "excluded_words": SQL_EXCLUDED_WORDS,
    "excluded_text": SQL_EXCLUDED_TEXT,
    "format_columns": SQL_FORMAT_COLUMNS,
    "result_limit": SQL_RESULT_LIMIT,
    "result_limit_band": SQL_RESULT_LIMIT_BAND,
    "source_cap": SQL_SOURCE_CAP,
    "excerpts": SQL_EXCERPTS,
    "excerpts_last": SQL_EXCERPTS_LAST,
    "expansion_rounds": SQL_EXPANSION_ROUNDS,
    "run_batch": SQL_RUN_BATCH,
    "source_quota": SQL_SOURCE_QUOTA,
    "source_usage": SQL_SOURCE_USAGE,
    "postings": SQL_POSTINGS,
    "indexed_hits": SQL_PHRASE_HITS,
    "corpus_text": SQL_CORPUS_TEXT,
    "rules_text": SQL_RULES_TEXT,
    "terms_text": SQL_TERMS_TEXT,
    "results_tsv": SQL_RESULTS_TSV,
    "adhoc_search": SQL_ADHOC_SEARCH,
    "explain": SQL_EXPLAIN,
    "custom_scoring": SQL_CUSTOM_SCORING,
}
