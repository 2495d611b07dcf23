"""Phrase search (QRY-1..9), set-at-a-time.

All terms are matched in one pass: every document's token array is cut into
n-grams of up to three tokens, and the n-grams are equi-joined with the terms'
first tokens on ``(n_toks, phrase)``; longer terms are compared whole on the
candidates that this leaves.  When the term table is small enough (measured), it is
broadcast and the n-grams are never shuffled: they stream through a hash
probe that drops all non-matching rows inside the scan stage.  Otherwise the
join shuffles on the phrase and AQE splits hot phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.functions import patterns as P
from phrasemill.functions.formula import DEFAULT_FORMULA, sql_formula, validate
from phrasemill.operators import index as IDX
from phrasemill.operators import postings as PO
from phrasemill.operators.phrases import distinct_phrases, for_each_term, one_row_a_line
from phrasemill.session import GROUP_LIMIT, maybe_broadcast, top_per_group
from phrasemill.session import cut_lineage_packed as cut_lineage     # hits are many

SCORE_ROUND = 9
KEY_TOKENS = 3   # tokens of a term that the n-gram join matches; the rest is compared on candidates


def normalize_terms(terms: DataFrame, acronyms: bool = False) -> DataFrame:
    """QRY-1: '-' -> ' ', '.' removed, split on single spaces.  Leading and
    trailing spaces are trimmed; a term without tokens keeps its row, with
    n_toks 0, and never matches.  Adds phrase, toks, n_toks, q (raw term
    length).  ``acronyms`` keeps the periods of words like ``U.S.A.``, as the
    index does."""
    bare = F.trim(F.replace(F.col("term"), F.lit("-"), F.lit(" ")))

    def word(w: Column) -> Column:
        plain = F.replace(w, F.lit("."), F.lit(""))
        return F.when(w.rlike(P.ACRONYM_RE), w).otherwise(plain) if acronyms else plain

    phrase = F.trim(F.array_join(F.transform(F.split(bare, " ", -1), word), " "))
    return (terms.withColumn("phrase", phrase)
            .withColumn("toks", F.when(F.col("phrase") == "", F.array().cast("array<string>"))
                        .otherwise(F.split(F.col("phrase"), " ", -1)))
            .withColumn("n_toks", F.size("toks"))
            .withColumn("q", F.length("term")))


def all_shingles(docs: DataFrame, lengths: list[int], cols: list[str], keep_first: bool = False) -> DataFrame:
    """(cols..., n_toks, pos, phrase) for every window of every length, from
    ONE scan of the index: one row per position holding the next max(L)
    tokens (a zip of shifted slices; past the end they are null), then one
    small row per term length.  No lambda functions."""
    n = F.size("toks")
    top = max(lengths)
    zipped = F.arrays_zip(*[F.slice("toks", k + 1, F.greatest(n - k, F.lit(0))).alias(f"t{k}")
                            for k in range(top)])
    at = docs.select(*cols, F.posexplode(zipped).alias("pos", "g"))
    g = F.col("g")
    per_len = F.array(*[F.struct(F.lit(L).alias("n_toks"),
                                 F.concat_ws(" ", *[g[f"t{k}"] for k in range(L)]).alias("phrase"),
                                 g[f"t{L - 1}"].isNotNull().alias("_ok")) for L in lengths])
    out = (at.select(*cols, "pos", *([g["t0"].alias("_t0")] if keep_first else []), F.inline(per_len))
           .filter(F.col("_ok")).drop("_ok"))
    return out


def _matched(docs: DataFrame, terms: DataFrame, cols: list[str], max_broadcast_bytes: int | None,
             terms_small: bool | None, positions: bool, only: DataFrame | None = None) -> DataFrame | None:
    """(term_no, *cols, pos, n) rows of the n-grams that are terms; None if there are no terms with tokens.
    Without ``positions`` a row may stand for n matches and pos is null.  ``only``: (term_no, line_no) pairs to look at."""
    terms = terms.filter("n_toks > 0")
    lengths = [r["n"] for r in terms.select(F.least("n_toks", F.lit(KEY_TOKENS)).alias("n")).distinct().collect()]
    longer = not terms.filter(F.col("n_toks") > KEY_TOKENS).isEmpty()
    if not lengths:
        return None
    if only is not None:
        lines, _ = maybe_broadcast(only.select("line_no").distinct(), [], max_broadcast_bytes)
        docs = docs.join(lines, "line_no", "left_semi")
        only, _ = maybe_broadcast(only, [], max_broadcast_bytes)
    # A term meets the n-grams with its first KEY_TOKENS tokens, however long it is.
    key = F.array_join(F.slice("toks", 1, KEY_TOKENS), " ")
    want = F.when(F.col("n_toks") > KEY_TOKENS, F.col("toks"))
    keyed = terms.select("term_no", F.col("n_toks").alias("_len"), F.least("n_toks", F.lit(KEY_TOKENS)).alias("n_toks"),
                         key.alias("phrase"), want.alias("_want"))
    if terms_small is None:
        keyed, small = maybe_broadcast(keyed, ["phrase"], max_broadcast_bytes,
                                       extra=F.coalesce(F.length(F.array_join("_want", "        ")), F.lit(0)))
    else:
        keyed, small = (F.broadcast(keyed), True) if terms_small else (keyed, False)
    one = F.lit(1).cast("long").alias("n")
    checked = False
    if small:
        # The tokens move once, by line; a document's matches are then counted where its n-grams are made.
        docs = docs.select(*cols, "toks").repartition("line_no")
        # Candidates of longer terms are compared whole in the document's row.
        checked = longer and one_row_a_line(docs)
        grams = all_shingles(docs, sorted(lengths), [*cols, *(["toks"] if checked else [])])
        matched = grams.join(keyed, ["n_toks", "phrase"])
        if checked:
            matched = matched.filter(F.col("_want").isNull() | (F.slice("toks", F.col("pos") + 1, F.col("_len")) == F.col("_want")))
        matched = matched.select("term_no", *cols, "pos", one, "_len")
    else:
        grams = all_shingles(docs, sorted(lengths), cols, keep_first=True)
        # QRY-3 candidate pruning: the distinct first tokens of the terms are
        # far fewer than the terms; n-grams whose first token is not among
        # them are dropped before anything is shuffled.
        firsts = terms.select(F.element_at("toks", 1).alias("_t0")).distinct()
        firsts, _ = maybe_broadcast(firsts, ["_t0"], max_broadcast_bytes)
        grams = grams.join(firsts, "_t0", "left_semi").drop("_t0")
        keyed = keyed.drop("_want")
        # Pre-aggregate repeats of one phrase inside a document before the
        # shuffle, so a hot one-word phrase moves one row per document.
        grams = grams.groupBy(*cols, "n_toks", "phrase")
        if positions or longer:
            matched = (grams.agg(F.collect_list("pos").alias("_ps")).join(keyed, ["n_toks", "phrase"])
                       .select("term_no", *cols, F.explode("_ps").alias("pos"), one, "_len"))
        else:
            matched = grams.agg(F.count(F.lit(1)).alias("n")).join(keyed, ["n_toks", "phrase"]).select(
                "term_no", *cols, F.lit(None).cast("int").alias("pos"), "n", "_len")
    if only is not None:
        matched = matched.join(only, ["term_no", "line_no"], "left_semi")
    if longer and not checked:
        # Candidates of longer terms are compared whole.
        want = terms.select("term_no", F.col("toks").alias("_want"))
        whole = (matched.filter(F.col("_len") > KEY_TOKENS).join(want, "term_no")
                 .join(docs.select("line_no", "toks"), "line_no")
                 .filter(F.slice("toks", F.col("pos") + 1, F.col("_len")) == F.col("_want")))
        matched = matched.filter(F.col("_len") <= KEY_TOKENS).unionByName(whole.select(*matched.columns))
    return matched


def _no_hits(docs: DataFrame, carry: tuple[str, ...], starts: bool) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in docs.select(*carry).schema}
    ddl = ", ".join(["term_no long", "line_no long", "tf long", *(["starts array<int>", "first_pos int"] * starts), *(f"{c} {types[c]}" for c in carry)])
    return docs.sparkSession.createDataFrame([], ddl)


def phrase_hits(docs: DataFrame, terms: DataFrame, carry: tuple[str, ...] = ("n_tokens", "score", "docid"),
                max_broadcast_bytes: int | None = None, terms_small: bool | None = None,
                only: DataFrame | None = None) -> DataFrame:
    """QRY-2: (term_no, line_no, tf, starts, first_pos, *carry) — one row per document
    containing the phrase, ``starts`` = sorted token positions of the matches.

    ``terms`` must be normalised.  ``carry`` document columns ride along so
    that ranking needs no second join with the document table.  The n-grams
    of all lengths come from one scan of the index and meet the terms in one
    join."""
    once, same = (terms, None) if only is not None else distinct_phrases(terms, max_broadcast_bytes)
    matched = _matched(docs, once, ["line_no", *carry], max_broadcast_bytes, terms_small, True, only)
    if matched is None:
        return _no_hits(docs, carry, True)
    # what a caller doesn't read of these (positions above all) is never built
    hits = (matched.groupBy("term_no", "line_no", *carry)
            .agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("starts"), F.min("pos").alias("first_pos")))
    return for_each_term(hits, same)


def phrase_counts(docs: DataFrame, terms: DataFrame, carry: tuple[str, ...] = ("n_tokens", "score", "docid"),
                  max_broadcast_bytes: int | None = None, terms_small: bool | None = None) -> DataFrame:
    """(term_no, line_no, tf, *carry): what ranking needs of the hits, without positions."""
    once, same = distinct_phrases(terms, max_broadcast_bytes)
    matched = _matched(docs, once, ["line_no", *carry], max_broadcast_bytes, terms_small, False)
    if matched is None:
        return _no_hits(docs, carry, False)
    return for_each_term(matched.groupBy("term_no", "line_no", *carry).agg(F.sum("n").alias("tf")), same)


def with_starts(source: DataFrame | PO.Index, hits: DataFrame, terms: DataFrame,
                max_broadcast_bytes: int | None = None) -> DataFrame:
    """The second phase of a ranked search: ``hits`` with the positions of their matches, which are looked up for
    these (term, document) pairs only.  ``hits`` is read twice: it should be written or checkpointed."""
    once, same = distinct_phrases(terms, max_broadcast_bytes)
    only = hits.select("term_no", "line_no")
    if same is not None:
        only = only.join(once.select("term_no"), "term_no", "left_semi")    # equal phrases have equal rows
    if isinstance(source, PO.Index):
        found = PO.phrase_hits(source, once, max_broadcast_bytes, only)
    else:
        found = phrase_hits(source, once, (), max_broadcast_bytes, only=only)
    return hits.join(for_each_term(found.select("term_no", "line_no", "starts"), same), ["term_no", "line_no"])


def term_idf(source: DataFrame | PO.Index, terms: DataFrame, n_docs: int) -> DataFrame:
    """(term_no, idf): sum over the phrase's tokens (repeats count again) of
    ln(1 + (N - df + 0.5) / (df + 0.5)).  An index has the df of every token stored."""
    term_toks = terms.select("term_no", F.explode("toks").alias("token"))
    dfs = PO.token_df(source, term_toks) if isinstance(source, PO.Index) else IDX.doc_freq(source, term_toks)
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (term_toks.join(dfs, "token", "left").fillna({"df": 0})
            .groupBy("term_no").agg(F.sum(idf).alias("idf")))


def bm25(tf: Column, dl: Column, idf: Column, avgdl: float, k1: float = P.BM25_K1, b: float = P.BM25_B) -> Column:
    """QRY-4 (no (k1+1) factor)."""
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl.cast("double") / F.lit(avgdl))
    return idf * tf / (tf + norm)


def formula_score(formula: str) -> Column:
    """QRY-5: a Spark SQL expression over _score, score, docid, docMatchCount;
    negative and NaN results become 0."""
    x = F.expr(sql_formula(formula)).cast("double")
    x = F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x)
    return F.round(F.greatest(x, F.lit(0.0)), SCORE_ROUND)


def ranked_hits(source: DataFrame | PO.Index, terms: DataFrame, formula: str = DEFAULT_FORMULA,
                limit: int | None = None, usage: DataFrame | None = None,
                stats: tuple[int, float] | None = None, max_broadcast_bytes: int | None = None,
                starts: bool = True) -> DataFrame:
    """QRY-2..6: (term_no, line_no, tf, n_tokens, score, docid, idf, n_hits,
    bm25, final_score, rank, starts), rank by final_score desc then line_no.

    ``source`` is the document table or a stored index.  Two phases: counts of
    all hits are ranked, then the matches' positions (``starts``, if asked for)
    are looked up for the hits that the limit keeps.

    ``usage`` (docid, n) gives docMatchCount = 1 + n (RNK-6).  An invalid
    formula raises before anything is read."""
    indexed = isinstance(source, PO.Index)
    validate((source.docs if indexed else source).sparkSession, formula)
    if stats is None:
        stats = (source.n_docs, source.avgdl) if indexed else IDX.corpus_stats(source)
    n_docs, avgdl = stats
    # Equal phrases rank alike: counted and ranked once, given to each of their terms behind the limit.
    every, (terms, same) = terms, distinct_phrases(terms, max_broadcast_bytes)
    # One size check of the term table decides both broadcasts below: the
    # per-term table has at most one narrower row per term.
    _, small = maybe_broadcast(terms.select("term_no", "n_toks", "phrase"), ["phrase"], max_broadcast_bytes)
    # The hits feed both the per-term counts and the ranking; materialise
    # them once (reliable checkpoint) instead of running the n-gram join twice.
    hits = cut_lineage(PO.phrase_counts(source, terms, max_broadcast_bytes) if indexed else phrase_counts(
        source, terms, max_broadcast_bytes=max_broadcast_bytes, terms_small=small))
    idf = term_idf(source, terms, n_docs)
    # Per-term table: idf and the total hit count (QRY-8), one row per term.
    counts = hits.groupBy("term_no").agg(F.count(F.lit(1)).alias("n_hits"))
    per_term = idf.join(counts, "term_no")
    hits = hits.join(F.broadcast(per_term) if small else per_term, "term_no")
    hits = hits.withColumn("bm25", bm25(F.col("tf"), F.col("n_tokens"), F.col("idf"), avgdl))
    if usage is not None:
        used = usage.groupBy("docid").agg((F.sum("n") + 1).cast("double").alias("docMatchCount"))
        hits = hits.join(used, "docid", "left").fillna({"docMatchCount": 1.0})
    else:
        hits = hits.withColumn("docMatchCount", F.lit(1.0))
    hits = (hits.withColumn("_score", F.col("bm25"))
            .withColumn("final_score", formula_score(formula)).drop("_score"))
    order = [F.desc("final_score"), F.asc("line_no")]
    if limit is not None:
        hits = top_per_group(hits, ["term_no"], order, limit, "rank")
    else:
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("term_no").orderBy(*order)))
    hits = for_each_term(hits, same)
    return with_starts(source, cut_lineage(hits), every, max_broadcast_bytes) if starts else hits


def term_summary(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """QRY-8: total hits per term, zero-hit terms included."""
    counts = hits.groupBy("term_no").agg(F.count(F.lit(1)).alias("n_hits"))
    return (terms.select("term_no", "term").join(counts, "term_no", "left")
            .fillna({"n_hits": 0}))


def search_phrase(source: DataFrame | PO.Index, phrase: str, limit: int = 20, formula: str = DEFAULT_FORMULA) -> DataFrame:
    """QRY-9: ranked documents for one phrase (no excerpts).

    On an index the phrase is looked up: its tokens' row groups are read, and the
    documents by their line numbers (at most ``limit``, which the scan tests)."""
    docs = source.docs if isinstance(source, PO.Index) else source
    one = normalize_terms(docs.sparkSession.createDataFrame([(1, phrase)], "term_no long, term string"))
    hits = cut_lineage(ranked_hits(source, one, formula=formula, limit=limit))
    bodies = docs.select("line_no", "title", "content")
    if limit <= GROUP_LIMIT:
        bodies = bodies.filter(F.col("line_no").isin([r["line_no"] for r in hits.select("line_no").collect()]))
    return hits.join(bodies, "line_no").orderBy("rank")
