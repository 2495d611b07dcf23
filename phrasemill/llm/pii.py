"""Personal data by pattern and by information content (operator 4), DataFrame functions only.

Base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers, leftmost and non-overlapping per kind.  The patterns are written with
possessive quantifiers and start only where a run of their characters starts,
so they match the plain patterns' strings without backtracking.  Offsets are
running sums of the lengths of the pieces between matches (`split`) and of the
matches, taken inside the row; no step looks at a text's beginning again, so
time grows with the text, not with text times spans.

Information-theoretic sanitisation: a protected entity is a value found by a
base pattern.  Words are runs of letters and digits, lower-cased, of the text
with its base spans blanked, so no part of an address or number is a word.
The words beside an entity are those that lie whole within `window`
characters before or after one of its spans.  With counts over the whole corpus,

    IC(e) = -log2 n(e)/N,   PMI(t, e) = log2 (n(t, e) / n(t)) + IC(e),

a term t reveals the share PMI / IC of the entity: 1 if it occurs only beside
it.  n(t, e) counts places of t, each once however many spans of e are near.
Terms at or over `alpha`, seen beside the entity in at least `support`
different texts with different windows (a text counts once, copied passages
count once), are spans of kind "term" wherever they stand in the table: beside
the entity, far from it or in documents without it, but not within a base span.

`sanitise` replaces base spans and terms: base spans and numbers by their kind
(generalised), other terms by nothing (removed).

Results: offsets are code points, end exclusive.  A null text has no spans and
stays null.  Rows of one doc_id and text share their spans, and each row comes
back; other columns come back unchanged (`spans` takes another name if taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import tables as T
from phrasemill.llm.line_dedup import free_name
from phrasemill.session import maybe_broadcast

KINDS = ["email", "ip", "card", "phone", "term"]
_PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
]
# no valid match without these
_NEEDS = [r"@[A-Za-z0-9-]++\.", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[ -]?[0-9]){13}", r"\+[0-9][ ().0-9-]{9}"]
_TERM = r"[\p{L}\p{N}]+"
_KEY = ["d", "x", "l"]
_SPAN = "struct<start:bigint,rank:int,end:bigint,m:string>"
_CHUNK = 256     # code points; a piece of a text is cut from the chunks that it touches
_BLOCK = 256     # numbers summed by one growing array


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _before(a: Column, step, zero: int = 0) -> Column:
    """For each number of array `a`, the fold of those before it.  Blocks are folded by themselves and then
    shifted, so no growing array is copied more than a block's length."""
    start = F.struct(F.lit(zero).cast("long").alias("at"), _none("bigint").alias("out"))

    def fold(v: Column) -> Column:
        return F.aggregate(v, start, lambda acc, x: F.struct(step(acc.at, x).alias("at"), F.array_append(acc.out, acc.at).alias("out")))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / _BLOCK), F.lit(0)).cast("int")),
                             lambda b: fold(F.slice(v, b * _BLOCK + 1, _BLOCK)))
        return _let(blocks, lambda bs: F.flatten(F.transform(
            F.arrays_zip(bs.alias("own"), fold(F.transform(bs, lambda b: b.at)).out.alias("base")),
            lambda z: F.transform(z.own.out, lambda x: step(z.base, x)))))

    return _let(a, whole)


def _sums_before(a: Column) -> Column:
    return _before(a, lambda at, x: at + x)


def _valid(rank: int, m: Column) -> Column:
    """Checks of a match of kind number `rank`."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if rank == 1:
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if rank == 2:
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if rank == 3 else F.lit(True)


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>>: the matches of a pattern and where they stand."""
    def place(z: Column) -> Column:
        size = F.transform(z, lambda p: (F.length(p.gap) + F.coalesce(F.length(p.m), F.lit(0))).cast("long"))
        return F.transform(F.filter(F.arrays_zip(z.alias("p"), _sums_before(size).alias("at")), lambda q: q.p.m.isNotNull()),
                           lambda q: F.struct((q.at + F.length(q.p.gap)).alias("start"),
                                              (q.at + F.length(q.p.gap) + F.length(q.p.m)).alias("end"), q.p.m.alias("m")))

    return _let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), place)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, m>> of the valid matches, ascending; empty for a null text."""
    def of_kind(i: int) -> Column:
        good = F.filter(_placed(text, _PATTERNS[i]), lambda p: _valid(i, p.m))
        spans = F.transform(good, lambda p: F.struct(p.start.alias("start"), F.lit(i).alias("rank"), p.end.alias("end"), p.m.alias("m")))
        return F.when(text.rlike(_NEEDS[i]), spans.cast(f"array<{_SPAN}>")).otherwise(_none(_SPAN))

    return F.array_sort(F.concat(*[of_kind(i) for i in range(len(_PATTERNS))]))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, lo: Column, hi: Column) -> Column:
    """Code points lo..hi of a text cut by `_chunks`."""
    first, last = F.floor(lo / _CHUNK).cast("int"), F.floor((hi - 1) / _CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(hi > lo, F.substring(near, (lo - first * _CHUNK).cast("int") + 1, (hi - lo).cast("int"))).otherwise(F.lit(""))


def _rewrite(text: Column, spans: Column, instead) -> Column:
    """The text with each run of overlapping spans replaced by instead(its first span, its length); spans ascend."""
    def build(s: Column) -> Column:
        reach = _before(F.transform(s, lambda x: x.end), lambda at, x: F.greatest(at, x))
        heads = F.filter(F.arrays_zip(s.alias("s"), reach.alias("reach")), lambda z: z.s.start >= z.reach)
        end = F.array_max(F.transform(s, lambda x: x.end))

        def parts(h: Column) -> Column:
            return _let(_chunks(text), lambda c: F.concat(F.array_join(F.flatten(F.transform(h, lambda z, i: F.array(
                _piece(c, z.reach, z.s.start),
                instead(z.s, F.coalesce(F.get(h, i + 1).reach, end) - z.s.start)))), ""),
                _piece(c, end, F.length(text).cast("long"))))

        return _let(heads, parts)

    return F.when(F.size(spans) > 0, _let(spans, build)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of its spans, of the same length."""
    return _rewrite(text, spans, lambda s, n: F.repeat(F.lit(" "), n.cast("int")))


def _beside(blank: Column, spans: Column, window: int) -> Column:
    """array<struct<rank, e, at, term, w>>: the words near each entity, one row a place; w: hash of a window."""
    def near(c: Column, total: Column, s: Column) -> Column:
        lo, hi = F.greatest(s.start - window, F.lit(0).cast("long")), F.least(s.end + window, total)
        e = F.when(s.rank == 0, F.lower(s.m)).when(s.rank == 1, s.m).otherwise(F.regexp_replace(s.m, "[^0-9]", ""))

        def rows(part: Column, at: Column, w: Column, whole) -> Column:
            return F.transform(F.filter(_placed(part, _TERM), whole), lambda p: F.struct(
                s.rank.alias("rank"), e.alias("e"), (at + p.start).alias("at"), F.lower(p.m).alias("term"), w.alias("w")))

        def words(v: Column) -> Column:
            # a word that the window may cut is left out
            w = F.xxhash64(v.left, v.right)
            return F.concat(rows(v.left, v.lo, w, lambda p: (p.start > 0) | (v.lo == 0)),
                            rows(v.right, s.end, w, lambda p: (s.end + p.end < v.hi) | (v.hi == total)))

        return _let(F.struct(_piece(c, lo, s.start).alias("left"), _piece(c, s.end, hi).alias("right"),
                             lo.alias("lo"), hi.alias("hi")), words)

    def once(rows: Column) -> Column:
        """A place near several spans of one entity is one row."""
        return F.filter(rows, lambda r, i: (i == 0) | (r.at != F.get(rows, i - 1).at) | (r.e != F.get(rows, i - 1).e)
                        | (r.rank != F.get(rows, i - 1).rank))

    found = _let(F.struct(_chunks(blank).alias("c"), F.length(blank).cast("long").alias("n")), lambda v: F.flatten(
        F.transform(spans, lambda s: near(v.c, v.n, s))))
    return _let(F.array_sort(found), once)


def _all_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))


_built: dict = {}


def _once(name: str, build) -> Column:
    """A column over the fixed names __pii_t (text), __pii_s (spans) and __pii_b (blanked text), made once per JVM:
    these expressions take thousands of calls to it."""
    from pyspark import SparkContext
    key = id(SparkContext._active_spark_context._jvm), name
    if key not in _built:
        _built[key] = build()
    return _built[key]


def _spans() -> Column:
    return _once("spans", lambda: base_spans(F.col("__pii_t")))


def _places() -> Column:
    return _once("places", lambda: _placed(F.col("__pii_b"), _TERM))


def _with_blank(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """keep, __pii_t (text), __pii_s (base spans) and __pii_b (the blanked text)."""
    blank = _once("blank", lambda: blanked(F.col("__pii_t"), F.col("__pii_s")))
    return docs.select(*keep, F.col(text_col).cast("string").alias("__pii_t")).withColumn("__pii_s", _spans()).withColumn("__pii_b", blank)


def revealing(docs: DataFrame, text_col: str, window: int, alpha: float, support: int) -> DataFrame:
    """(term): those that reveal an entity beside them."""
    beside = _once(f"beside {window}", lambda: F.when(F.size("__pii_s") > 0, _beside(F.col("__pii_b"), F.col("__pii_s"), window)))
    near = T.write_shared(_with_blank(docs, text_col).select(F.xxhash64("__pii_t").alias("x"), F.explode(beside).alias("r")).select(
        "x", "r.*"), "beside")
    pair = (near.groupBy("rank", "e", "term", "x").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"))
            .groupBy("rank", "e", "term").agg(F.countDistinct("w").alias("texts"), F.sum("n").alias("n_te"))
            .filter(F.col("texts") >= support))
    entity = F.when(F.col("s.rank") == 0, F.lower("s.m")).when(F.col("s.rank") == 1, F.col("s.m")).otherwise(
        F.regexp_replace("s.m", "[^0-9]", ""))
    n_e = docs.select(F.col(text_col).cast("string").alias("__pii_t")).select(F.explode(_spans()).alias("s")).groupBy(F.col("s.rank").alias("rank"), entity.alias("e")).agg(
        F.count(F.lit(1)).alias("n_e"))
    words = _with_blank(docs, text_col).select(F.explode(_all_words(F.col("__pii_b"))).alias("word")).select(F.lower("word").alias("term"))
    counts = T.write_shared(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "words")
    total = counts.agg(F.sum("n_t").alias("total")).first()["total"] or 0
    ic = -F.log2(F.col("n_e") / F.lit(float(total)))
    pmi = F.log2(F.col("n_te") / F.col("n_t")) + ic
    return (pair.join(n_e, ["rank", "e"]).join(counts, "term")
            .filter((ic > 0) & (pmi / ic >= alpha)).select("term").distinct())


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, x, l, hits): where each document holds revealing terms.  The documents that hold any are found first; only
    their words are placed.  A hot term's documents stay where they are read, or are split by the skewed join if the
    terms are too many to broadcast."""
    terms, _ = maybe_broadcast(terms, ["term"])
    src = _with_blank(docs, text_col, *_identity(id_col, F.col(text_col).cast("string")))
    words = src.select(*_KEY, F.explode(F.array_distinct(_all_words(F.col("__pii_b")))).alias("word"))
    holds = words.withColumn("term", F.lower("word")).join(terms, "term", "left_semi").select(*[F.col(k).alias(f"h{k}") for k in _KEY]).distinct()
    holds, _ = maybe_broadcast(T.write_shared(holds, "holds"), [])
    rows = src.join(holds, F.col("d").eqNullSafe(F.col("hd")) & (F.col("x") == F.col("hx")) & (F.col("l") == F.col("hl")), "left_semi")
    placed = rows.select(*_KEY, F.explode(_places()).alias("p")).select(*_KEY, "p.*", F.lower("p.m").alias("term"))
    hit = F.struct("start", F.lit(4).alias("rank"), "end", "m").cast(_SPAN)
    return placed.join(terms, "term").groupBy(*_KEY).agg(F.collect_set(hit).alias("hits"))


def _identity(id_col: str, text: Column) -> list[Column]:
    """Equal rows share their spans."""
    return [F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("x"), F.length(text).alias("l")]


def _label(s: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s.rank + 1)
    return F.when(s.rank < 4, kind).when(s.m.rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).otherwise(F.lit(""))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 96, alpha: float = 0.9,
             support: int = 3) -> DataFrame:
    """The table with `text_col` sanitised, and spans array<struct<start, rank, end, kind>> of the text as it was."""
    terms = T.write_shared(revealing(docs, text_col, window, alpha, support), "terms")
    of = term_spans(docs, terms, id_col, text_col).toDF("__pii_hd", "__pii_hx", "__pii_hl", "__pii_hits")
    text = F.col(text_col).cast("string")
    marked = docs.select("*", *[c.alias(f"__pii_{k}") for k, c in zip(_KEY, _identity(id_col, text), strict=True)])
    joined = marked.join(of, F.col("__pii_d").eqNullSafe(F.col("__pii_hd")) & (F.col("__pii_x") == F.col("__pii_hx"))
                         & F.col("__pii_l").eqNullSafe(F.col("__pii_hl")), "left")
    joined = joined.withColumn("__pii_t", text).withColumn(
        "__pii_s", F.array_sort(F.concat(_spans(), F.coalesce("__pii_hits", _none(_SPAN)))))
    clean = _once("clean", lambda: _rewrite(F.col("__pii_t"), F.col("__pii_s"), lambda s, n: _label(s)))
    kind = F.array(*map(F.lit, KINDS))
    spans = F.transform("__pii_s", lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"),
                                                      F.element_at(kind, s.rank + 1).alias("kind")))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                         spans.alias(free_name(docs, "spans")))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count_kind(kind: str):
    """Step of an aggregate that counts the spans of a kind."""
    return lambda n, s: n + (s.kind == kind).cast("long")
