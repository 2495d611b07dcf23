"""DuckDB (RE2) renderings of the analysis and search steps, used by the
correctness oracle.  Each function returns a SQL fragment; the registry in
``phrasemill.plans.registry`` assembles them into one statement per query.

RE2 has no look-around, so the sentence-start mask is done in three steps:
abbreviation periods are protected with a private-use character, the mask
runs without its look-behind, and the periods are restored.
"""

from __future__ import annotations

from phrasemill.functions import patterns as P

q = P.sql_str

# The token grammar in RE2, on its own: e-mail; dotted with a final period (the
# character behind it is consumed and cut off again); number chains with a
# separator that is no period, by the place of the first run without a digit;
# hosts; company names; apostrophes; words; single Han, Kana and Bopomofo
# characters.
_CJ = r"\x{3040}-\x{312F}\x{31F0}-\x{31FF}\x{3300}-\x{337F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF65}-\x{FF9F}"
_W = r"(?:[^\P{L}" + _CJ + r"])"
_X = r"(?:[^\P{L}" + _CJ + r"]|\p{Nd})"
TOKEN_RE2 = (
    r"(X+(?:[._\-]X+)*@X+(?:[.\-]X+)+)"
    r"|(X+(?:\.X+)+\.)(?:[^\p{L}\p{Nd}]|\z)"
    r"|(D(?:\.D)*[_\-/,]D(?:[_\-/.,]D)*(?:[_\-/.,]X+(?:[_\-/.,]D[_\-/.,]X+)*(?:[_\-/.,]D)?)?"
    r"|D(?:\.D)*[_\-/,]X+(?:[_\-/.,]D[_\-/.,]X+)*(?:[_\-/.,]D)?"
    r"|D(?:\.D)*\.X+(?:\.D\.X+)*(?:[_\-/,]D(?:[_\-/.,]X+[_\-/.,]D)*(?:[_\-/.,]X+)?"
    r"|\.D[_\-/,]X+(?:[_\-/.,]D[_\-/.,]X+)*(?:[_\-/.,]D)?)"
    r"|X+(?:\.D\.X+)*(?:[_\-/,]D(?:[_\-/.,]X+[_\-/.,]D)*(?:[_\-/.,]X+)?"
    r"|\.D[_\-/,]X+(?:[_\-/.,]D[_\-/.,]X+)*(?:[_\-/.,]D)?)"
    r"|X+(?:\.X+)+|W+[&@]W+|W+(?:'W+)+|X+|[CJ])"
).replace("D", r"(?:W*\p{Nd}X*)").replace("CJ", _CJ).replace("X", _X).replace("W", _W)
SPAN_FIX_RE = r"\.[^\p{L}\p{Nd}]\z"


def masked(col: str) -> str:
    protect = f"regexp_replace({col}, {q(P.ABBREV_PROTECT_RE2)}, '\\1' || chr(57344), 'g')"
    mask = f"regexp_replace({protect}, {q(P.MASK_RE2)}, '\\1\\2', 'g')"
    return f"replace({mask}, chr(57344), '.')"


def token_texts(masked_sql: str) -> str:
    """Token texts before first-word blanking (analysis.tokens_from_spans)."""
    spans = f"regexp_extract_all({masked_sql}, {q(TOKEN_RE2)})"
    span_text = f"list_transform({spans}, lambda s: regexp_replace(s, {q(SPAN_FIX_RE)}, '.'))"
    undot = (f"CASE WHEN suffix(r, '.') AND NOT regexp_matches(r, {q(P.ACRONYM_RE)}) "
             f"THEN left(r, length(r) - 1) ELSE r END")
    return (f"list_transform({span_text}, lambda r: CASE WHEN length(r) > {P.MAX_TOKEN_LENGTH} THEN chr(1) "
            f"ELSE regexp_replace({undot}, {q(P.POSSESSIVE_RE)}, '') END)")


def analyzed(source_sql: str, text_col: str) -> str:
    """``source_sql`` rows plus toks (index tokens) and n_tokens."""
    return f"""(SELECT *, {field_length('toks')} AS n_tokens FROM (
    SELECT *, list_transform(tx, lambda t, i: CASE WHEN i = fi THEN '' ELSE t END) AS toks FROM (
      SELECT *, list_position(list_transform(tx, lambda u: u <> chr(1)), true) AS fi FROM (
        SELECT *, {token_texts(masked(text_col))} AS tx FROM ({source_sql})))))"""


def field_length(toks_sql: str) -> str:
    return f"len(list_filter({toks_sql}, lambda t: t <> chr(1)))"


DOCS = f"""docs AS (
  SELECT line_no, title, content, score, toks, n_tokens FROM {analyzed(
      "SELECT doc_id AS line_no, source AS title, text AS content, CAST(right(source, 1) AS DOUBLE) AS score FROM documents",
      "content")}
)"""

DOCIDS = """docids AS (SELECT title, min(line_no) AS docid FROM docs GROUP BY title)"""

# All windows of 1-3 words of the whole benchmark texts, and each text as one phrase.
TERMS = """bench AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{Nd}]+') AS w FROM benchmark),
bench_width AS (SELECT 4 * (coalesce(max(len(w)), 0) + 1) AS width FROM bench),
raw_terms AS (
  SELECT item_id * width + i * 4 + n AS term_no, array_to_string(list_slice(w, i + 1, i + n), ' ') AS term
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM bench, (VALUES (1), (2), (3)) v(n)), bench_width
  UNION ALL
  SELECT item_id * width, array_to_string(w, ' ') FROM bench, bench_width WHERE len(w) > 0),
terms AS (
  SELECT term_no, term, phrase, CASE WHEN phrase = '' THEN [] ELSE string_split(phrase, ' ') END AS toks,
         CASE WHEN phrase = '' THEN 0 ELSE len(string_split(phrase, ' ')) END AS n_toks, length(term) AS q
  FROM (SELECT term_no, term, trim(replace(replace(term, '-', ' '), '.', ''), ' ') AS phrase FROM raw_terms)
)"""

# Index tokens with the one and two that follow; a long phrase is found by its
# first three tokens and then compared whole.
GRAMS = """grams AS (
  SELECT line_no, i - 1 AS pos, toks[i] AS g1, toks[i] || ' ' || toks[i + 1] AS g2,
         toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2] AS g3
  FROM (SELECT line_no, toks, unnest(range(1, len(toks) + 1)) AS i FROM docs)
)"""

HITS = """phrases AS (SELECT DISTINCT phrase, toks, n_toks FROM terms WHERE n_toks > 0),
found AS (
  SELECT p.phrase, g.line_no, g.pos FROM grams g JOIN phrases p ON p.n_toks = 1 AND p.phrase = g.g1
  UNION ALL
  SELECT p.phrase, g.line_no, g.pos FROM grams g JOIN phrases p ON p.n_toks = 2 AND p.phrase = g.g2
  UNION ALL
  SELECT p.phrase, g.line_no, g.pos
  FROM grams g JOIN (SELECT *, array_to_string(toks[1:3], ' ') AS head FROM phrases WHERE n_toks >= 3) p ON p.head = g.g3
       JOIN docs d ON d.line_no = g.line_no
  WHERE p.n_toks = 3 OR list_slice(d.toks, g.pos + 1, g.pos + p.n_toks) = p.toks
),
phrase_hits AS (SELECT phrase, line_no, count(*) AS tf, min(pos) AS first_pos FROM found GROUP BY phrase, line_no),
hits AS (SELECT t.term_no, h.line_no, h.tf, h.first_pos FROM terms t JOIN phrase_hits h ON h.phrase = t.phrase)"""

STATS = """stats AS (SELECT count(*) AS n_docs, sum(n_tokens) / count(*) AS avgdl FROM docs)"""

IDF = """term_tok AS (SELECT term_no, unnest(toks) AS token FROM terms WHERE n_toks > 0),
dfs AS (
  SELECT token, count(*) AS df
  FROM (SELECT DISTINCT line_no, unnest(toks) AS token FROM docs)
  WHERE token <> '' AND token IN (SELECT token FROM term_tok)
  GROUP BY token
),
idf AS (
  SELECT tt.term_no, sum(ln(1 + ((SELECT n_docs FROM stats) - coalesce(dfs.df, 0) + 0.5) / (coalesce(dfs.df, 0) + 0.5))) AS idf
  FROM term_tok tt LEFT JOIN dfs ON tt.token = dfs.token
  GROUP BY tt.term_no
)"""


def scored_hits(formula_sql: str, k1: float = P.BM25_K1, b: float = P.BM25_B) -> str:
    return f"""scored AS (
  SELECT h.term_no, h.line_no, h.tf, d.n_tokens, d.score, di.docid, i.idf,
         i.idf * h.tf / (h.tf + {k1} * ({1 - b} + {b} * d.n_tokens / (SELECT avgdl FROM stats))) AS bm25
  FROM hits h JOIN docs d ON h.line_no = d.line_no JOIN docids di ON d.title = di.title JOIN idf i ON h.term_no = i.term_no
),
final AS (
  SELECT *, round(greatest(coalesce(CASE WHEN isnan(x) THEN 0 ELSE x END, 0), 0), 9) AS final_score
  FROM (SELECT *, ({formula_sql}) AS x FROM scored)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY term_no ORDER BY final_score DESC, line_no) AS rank FROM final
)"""


DEFAULT_FORMULA_SQL = "CASE WHEN score = 0 THEN 'Infinity'::DOUBLE ELSE bm25 / score END"


# ---------------------------------------------------------------------------
# Excerpts (EXC-1..5) from the rule in SURVEY 2.5.1, first passage of a hit.

_MARK, _MARK2 = "chr(57346)", "chr(57347)"
_LOWER = "regexp_matches({}, '^[\\p{{Ll}}\\x{{AA}}\\x{{BA}}]')"
_UPPER = "regexp_matches({}, '^\\p{{Lu}}')"

# Original start offset of every token: masked offset plus what the mask
# removed before it.
OFFSETS = f"""marked AS (
  SELECT line_no, {masked('content')} AS masked,
         replace(regexp_replace(regexp_replace(content, {q(P.ABBREV_PROTECT_RE2)}, '\\1' || chr(57344), 'g'),
                                {q(P.MASK_3_RE2)}, '\\1\\2' || {_MARK} || '\\3' || {_MARK2}, 'g'), chr(57344), '.') AS mk
  FROM docs),
cuts AS (
  SELECT line_no, sum(strpos(p, {_MARK}) - 1) OVER w AS at, sum(length(p) - strpos(p, {_MARK})) OVER w AS shift
  FROM (SELECT line_no, ps[k] AS p, k
        FROM (SELECT line_no, string_split(mk, {_MARK2}) AS ps, unnest(range(1, len(string_split(mk, {_MARK2})))) AS k
              FROM marked))
  WINDOW w AS (PARTITION BY line_no ORDER BY k)),
tok_starts AS (
  SELECT line_no, i - 1 AS pos, sum(length(ps[i])) OVER (PARTITION BY line_no ORDER BY i) AS at
  FROM (SELECT line_no, ps, unnest(range(1, len(ps))) AS i
        FROM (SELECT line_no, string_split(regexp_replace(masked, {q(TOKEN_RE2)}, {_MARK} || '\\0', 'g'), {_MARK}) AS ps
              FROM marked))),
starts AS (
  SELECT t.line_no, t.pos, CAST(t.at + coalesce(c.shift, 0) AS BIGINT) AS s
  FROM tok_starts t ASOF LEFT JOIN cuts c ON t.line_no = c.line_no AND t.at >= c.at)"""


def sentences(mn: int) -> str:
    """Per document: its length, boundaries, and the acceptable passage starts."""
    step1 = f"regexp_replace(content, {q(P.SENTENCE_1_RE2)}, '\\1\\2\\4' || {_MARK} || '\\3\\5', 'g')"
    step2 = f"regexp_replace({step1}, {q(P.SENTENCE_2_RE2)}, '\\1' || {_MARK} || '\\2', 'g')"
    c, nx, pv = "substr(content, b + 1, 1)", "substr(content, b + 2, 1)", "CASE WHEN b = 0 THEN '' ELSE substr(content, b, 1) END"
    return f"""ends AS (
  SELECT line_no, content, n, 0 AS b, length(ps[1]) > 0 AS real FROM (
    SELECT line_no, content, length(content) AS n, string_split({step2}, {_MARK}) AS ps FROM docs)
  UNION ALL
  SELECT line_no, content, n, CAST(sum(length(ps[k])) OVER (PARTITION BY line_no ORDER BY k) AS BIGINT), coalesce(length(ps[k + 1]), 0) > 0
  FROM (SELECT line_no, content, n, ps, unnest(range(1, len(ps) + 1)) AS k FROM (
    SELECT line_no, content, length(content) AS n, string_split({step2}, {_MARK}) AS ps FROM docs))),
around AS (SELECT line_no, n, b, real, {c} AS c, {nx} AS nx, {pv} AS pv FROM ends),
judged AS (
  SELECT line_no, n, b, c = '.' AND nx <> ' ' AND nx <> ',' AS plus2,
         real AND b + {mn} <= n AND NOT {_LOWER.format('c')}
         AND (c <> '.' OR (nx <> ',' AND (nx <> ' ' OR NOT {_UPPER.format('pv')})))
         AND (c <> ',' OR pv NOT IN ('!', '?', '"', chr(39), ')')) AS ok
  FROM around),
bounds AS (
  SELECT line_no, any_value(n) AS n, list(DISTINCT b) AS bs,
         coalesce(list(DISTINCT b) FILTER (ok AND NOT plus2), []) AS okb, coalesce(list(DISTINCT b) FILTER (ok AND plus2), []) AS okb2
  FROM judged GROUP BY line_no)"""


def passages(hits: str, mn: int, mx: int) -> str:
    """``hits`` (with line_no, first_pos, q) and the excerpt of each."""
    return f"""opened AS (
  SELECT h.*, b.n, b.bs, st.s, greatest(st.s - {mx} + h.q + 2, 0) AS lo,
         greatest(list_max(list_filter(b.okb, lambda x: x <= st.s)), list_max(list_filter(b.okb2, lambda x: x <= st.s))) AS near,
         list_max(list_filter(b.okb2, lambda x: x <= st.s)) AS near2
  FROM {hits} h JOIN starts st ON st.line_no = h.line_no AND st.pos = h.first_pos JOIN bounds b ON b.line_no = h.line_no),
begun AS (
  SELECT *, CASE WHEN best IS NULL THEN 0 WHEN best = near AND best >= lo AND best = near2 THEN best + 2 ELSE best END AS ex_start
  FROM (SELECT *, greatest(near, list_max(list_filter(bs, lambda x: x <= s AND x < lo))) AS best FROM opened)),
closed AS (
  SELECT *, CASE WHEN e <= least(cur + {mx} + 1, n) THEN e ELSE coalesce(list_max(list_filter(bs, lambda x: x > s AND x < minb)), e) END AS ex_end
  FROM (SELECT *, list_min(list_filter(bs, lambda x: x > s AND x >= minb)) AS e
        FROM (SELECT *, least(cur + {mn} + q, n) AS minb
              FROM (SELECT *, CASE WHEN best IS NULL THEN n ELSE ex_start END AS cur FROM begun)))),
excerpts AS (
  SELECT c.* EXCLUDE (bs), substr(d.content, c.ex_start + 1, c.ex_end - c.ex_start) AS excerpt
  FROM closed c JOIN docs d ON d.line_no = c.line_no)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
