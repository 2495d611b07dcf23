"""Text analysis as Spark column expressions (TXT-1..6).

Content goes through four steps; 1 to 3 are JVM-side built-ins:

1. ``mask_sentence_starts``: delete capitalised sentence-initial words
   (one ``regexp_replace`` with the Java pattern, look-behind included).
2. ``token_spans``: one ``regexp_extract_all`` of the token grammar over the
   masked text.
3. ``tokens_from_spans``: fix the dotted forms, strip possessives, replace
   over-long tokens by a sentinel that keeps their position, blank the first
   token of the document.
4. offsets: gaps between tokens come from a ``split`` with the same grammar;
   prefix sums turn gap and span lengths into start offsets, and the mask's own
   match list maps masked offsets back to the original content (Spark has no
   prefix sum over an array: numpy over whole Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasemill.functions import patterns as P

def mask_sentence_starts(content: Column) -> Column:
    return F.regexp_replace(content, P.MASK_JAVA, P.MASK_REPLACEMENT_JAVA)


def token_spans(masked: Column) -> Column:
    """Every match of the token grammar."""
    return F.regexp_extract_all(masked, F.lit(P.TOKEN_RE_JAVA), F.lit(0))


def _token_text(raw: Column) -> Column:
    # Dotted forms keep their final period only when they are acronyms.
    undotted = F.when(raw.endswith(".") & ~raw.rlike(P.ACRONYM_RE),
                      raw.substr(F.lit(1), F.length(raw) - 1)).otherwise(raw)
    # Few tokens end like a possessive; only they meet the expression.
    return (F.when(F.length(raw) > P.MAX_TOKEN_LENGTH, F.lit(P.SENTINEL))
            .when(raw.endswith("s") | raw.endswith("S"), F.regexp_replace(raw, P.POSSESSIVE_RE, ""))
            .otherwise(undotted))


def tokens_from_spans(spans: Column) -> Column:
    """Index tokens, one per span; position i of the array is position i of
    the document.  The first kept token becomes the empty string."""
    texts = F.transform(spans, lambda s: _token_text(s))
    return blank_first(texts)


def blank_first(texts: Column) -> Column:
    # No lambda may capture an array-wide expression: Spark would evaluate it
    # once per element.  slice/concat keep this linear.
    f = F.when(F.get(texts, F.lit(0)) != P.SENTINEL, F.lit(1).cast("long")).otherwise(
        F.array_position(F.transform(texts, lambda t: t != F.lit(P.SENTINEL)), True))
    n = F.size(texts)
    blanked = F.concat(F.slice(texts, 1, f - 1), F.array(F.lit("")), F.slice(texts, f + 1, F.greatest(n - f, F.lit(0))))
    return F.when(f > 0, blanked).otherwise(texts)


def with_tokens(df: DataFrame, content: str = "content", out: str = "toks", starts: str | None = None) -> DataFrame:
    """Add index tokens and their field length.  The token texts get their
    own projection: the blanking step reads them several times, and Spark
    keeps an expensive column in its own projection rather than inline it
    into several uses.

    ``starts`` names a column for the tokens' offsets in the original content
    (TXT-6); both then come from one mask pass and one token pass."""
    if starts is not None:
        return _with_tokens_and_starts(df, F.col(content), out, starts)
    texts = F.transform(token_spans(mask_sentence_starts(F.col(content))),
                        lambda s: _token_text(s))
    return (df.withColumn("_tx", texts)
            .withColumn(out, blank_first(F.col("_tx")))
            .drop("_tx")
            .withColumn("n_tokens", field_length(F.col(out))))


def field_length(toks: Column) -> Column:
    """Document length for relevance: tokens kept by the length rule
    (the blanked first token counts)."""
    return F.when(F.array_contains(toks, P.SENTINEL), F.size(F.filter(toks, lambda t: t != F.lit(P.SENTINEL)))).otherwise(F.size(toks))


# ---------------------------------------------------------------------------
# Offsets (TXT-6).

def _flat(arrays: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a batch of arrays one after another, and each array's length (null: 0)."""
    size = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inclusive prefix sums within each array."""
    total = np.concatenate(([0], np.cumsum(values)))
    before = np.cumsum(size) - size
    return total[1:] - np.repeat(total[before], size)


def _arrays(values: np.ndarray, size: np.ndarray, like: pa.ListArray | None = None) -> pa.ListArray:
    """Arrays of these lengths; null where ``like`` is."""
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    at = pa.array(ends, mask=None if like is None else np.append(like.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(at, pa.array(values.astype(np.int32)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def array_cumsum(arrs: pa.Array) -> pa.Array:
    """Inclusive prefix sums of int arrays.  The batch stays in Arrow's flat buffers: no object per row."""
    values, size = _flat(arrs)
    return _arrays(_sums(values, size), size, arrs)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _original_starts(tok_piece_len: pa.Array, kept_len: pa.Array, removed_len: pa.Array) -> pa.Array:
    """Original-content start offset of every token.

    ``tok_piece_len``: lengths of the masked text split before each token
    (piece 0 is the leading gap, piece i >= 1 is token i-1 + the gap after
    it), so the masked starts are prefix sums.  ``kept_len``/``removed_len``: per mask
    match, masked-text length up to and including its kept part, and the
    removed length; a sorted search maps each masked start to the removals
    before it.  One search serves the batch: keys are (row, offset)."""
    pieces, n_pieces = _flat(tok_piece_len)
    kept, n_kept = _flat(kept_len)
    removed, _ = _flat(removed_len)
    row = np.repeat(np.arange(len(n_pieces)), n_pieces)
    last = np.zeros(len(pieces), bool)
    last[np.cumsum(n_pieces)[n_pieces > 0] - 1] = True
    start, row = _sums(pieces, n_pieces)[~last], row[~last]
    return _arrays(_original(start, row, kept, removed, n_kept), np.maximum(n_pieces - 1, 0))


def _original(start: np.ndarray, row: np.ndarray, kept: np.ndarray, removed: np.ndarray, n_kept: np.ndarray) -> np.ndarray:
    """Masked offsets of these rows as offsets in the original content."""
    at_row = np.repeat(np.arange(len(n_kept)), n_kept)
    at, shift = _sums(kept, n_kept), _sums(removed, n_kept)
    found = np.searchsorted((at_row << 32) + at, (row << 32) + start, side="right") - 1
    if not len(at):
        return start
    return start + np.where((found >= 0) & (at_row[found] == row), shift[found], 0)


def mask_marked(content: Column) -> Column:
    """The mask applied with each removed part kept between MARK and MARK2."""
    return F.regexp_replace(content, P.MASK_JAVA_3, "$1$2" + P.MARK + "$3" + P.MARK2)


def unmark(marked: Column) -> Column:
    """Masked text from ``mask_marked`` output."""
    return F.regexp_replace(marked, P.MARK + "[^" + P.MARK2 + "]*" + P.MARK2, "")


def original_token_starts(marked: Column, masked: Column) -> Column:
    """Start offset in the original content of every index token (same order
    as the token array); two regex passes per document in total (the mask
    pass that produced ``marked`` and one token pass)."""
    return _starts(_piece_lengths(masked), marked)


def _piece_lengths(masked: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(masked, P.TOKEN_RE_JAVA, P.MARK + "$0"), P.MARK, -1), lambda p: F.length(p))


def _starts(tok_len: Column, marked: Column) -> Column:
    mpieces = F.split(marked, P.MARK2, -1)
    # every piece but the last ends with MARK + removed text
    mpieces = F.slice(mpieces, 1, F.greatest(F.size(mpieces) - 1, F.lit(0)))
    kept = F.transform(mpieces, lambda p: F.instr(p, P.MARK) - 1)
    removed = F.transform(mpieces, lambda p: F.length(p) - F.instr(p, P.MARK))
    return _original_starts(tok_len, kept, removed)


ROWS_AT_ONCE = 1000     # rows of an Arrow batch whose pieces are held at a time


def _lengths(pieces: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The pieces of all rows one after another, their lengths in code points, and how many a row has."""
    flat = pieces.flatten()
    size = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64), size


def _replaced(texts: pa.StringArray, which: pa.BooleanArray, by: Callable[[pa.StringArray], pa.StringArray]) -> pa.StringArray:
    return pc.replace_with_mask(texts, which, by(texts.filter(which)))


def _index_tokens(between: pa.StringArray, marked: pa.StringArray) -> pa.StructArray:
    # what stands between tokens, token, between, token, ..., between
    flat, length, size = _lengths(pc.split_pattern(between, P.MARK))
    n = size // 2
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    odd = np.flatnonzero(nth % 2 == 1)
    row = np.repeat(np.arange(len(n)), n)
    raw, start = flat.take(pa.array(odd)), (_sums(length, size) - length)[odd]
    # as _token_text has it
    toks = _replaced(raw, pc.ends_with(raw, "."), lambda t: pc.if_else(
        pc.match_substring_regex(t, P.ACRONYM_RE), t, pc.utf8_slice_codeunits(t, 0, -1)))
    toks = _replaced(toks, pc.or_(pc.ends_with(raw, "s"), pc.ends_with(raw, "S")),
                     lambda t: pc.replace_substring_regex(t, P.POSSESSIVE_RE, ""))
    short = length[odd] <= P.MAX_TOKEN_LENGTH
    toks = pc.if_else(pa.array(short), toks, P.SENTINEL)
    # as blank_first has it
    kept = np.flatnonzero(short)
    first = np.zeros(len(row), bool)
    first[kept[np.append(True, row[kept][1:] != row[kept][:-1])[:len(kept)]]] = True
    toks = pc.if_else(pa.array(first), "", toks)
    # kept, removed, kept, ..., kept
    _, cut, n_cut = _lengths(pc.split_pattern_regex(marked, f"[{P.MARK}{P.MARK2}]"))
    nth = np.arange(len(cut)) - np.repeat(np.cumsum(n_cut) - n_cut, n_cut)
    removed = np.flatnonzero(nth % 2 == 1)
    start = _original(start, row, cut[removed - 1], cut[removed], n_cut // 2)
    at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(at, toks), _arrays(start, n), pa.array(np.bincount(row[short], minlength=len(n)).astype(np.int32))],
        names=["toks", "starts", "n_tokens"], mask=between.is_null())


@F.arrow_udf(T.StructType([T.StructField("toks", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.IntegerType())]))
def index_tokens(between: pa.Array, marked: pa.Array) -> pa.Array:
    """Index tokens, their original starts and the field length, from the masked text with each match of the token
    grammar between two MARKs, and the marked text.  What the regular expressions found is only cut and counted here."""
    return pa.concat_arrays([_index_tokens(between.slice(i, ROWS_AT_ONCE), marked.slice(i, ROWS_AT_ONCE))
                             for i in range(0, max(len(between), 1), ROWS_AT_ONCE)])


def _with_tokens_and_starts(df: DataFrame, content: Column, out: str, starts: str) -> DataFrame:
    # a content that holds a mark itself is analysed by the expressions that need none
    plain = ~(content.contains(P.MARK) | content.contains(P.MARK2))
    df = df.withColumn("_marked", mask_marked(content)).withColumn("_masked", unmark(F.col("_marked")))
    between = F.when(plain, F.regexp_replace("_masked", P.TOKEN_RE_JAVA, P.MARK + "$0" + P.MARK))
    df = (df.withColumn("_tx", F.when(~plain, F.transform(token_spans(mask_sentence_starts(content)), lambda s: _token_text(s))))
          .withColumn("_old", _starts(F.when(~plain, _piece_lengths(F.col("_masked"))), F.when(~plain, F.col("_marked"))))
          .withColumn("_new", index_tokens(between, F.col("_marked")))
          .withColumn(out, F.coalesce("_new.toks", blank_first(F.col("_tx"))))
          .withColumn(starts, F.when(F.col("_new").isNotNull(), F.col("_new.starts")).otherwise(F.col("_old"))))
    return df.withColumn("n_tokens", F.coalesce("_new.n_tokens", field_length(F.col(out)))).drop("_marked", "_masked", "_tx", "_old", "_new")


def sentence_pieces(content: Column) -> Column:
    """The content cut at its sentence boundaries."""
    return F.split(F.regexp_replace(content, P.SENTENCE_END_JAVA, "$0" + P.MARK), P.MARK, -1)


def sentence_boundaries(content: Column) -> Column:
    """Sorted sentence boundaries including 0 and the content length."""
    lens = F.transform(sentence_pieces(content), lambda p: F.length(p))
    return F.array_distinct(F.concat(F.array(F.lit(0)), array_cumsum(lens)))
