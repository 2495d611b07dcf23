"""Line dedup (operator 10), DataFrame functions only.

Lines are exploded with their positions; a line's key (stripped, A-Z
lower-cased) is hashed to 128 bits (two xxhash64); documents are counted per hash with partial
sums, so a line that a third of the corpus holds is one row per task; positions
of lines whose hash reaches the threshold are gathered per document, and the
text is put together again from the runs between them.

Results: a null or empty text is one empty line (never dropped for keys of at
least one character).  Rows with one doc_id count as one document for the
threshold, and each comes back as its own row; a null doc_id counts as one
document, too.  All other columns come back unchanged; the two counters take
another name (`n_lines_1`) where the table already has such a column.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import tables as T

SALTS = 16
WHITE = " \t\n\u000b\f\r"  # \x20 and \x09-\x0D


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name_1`, `name_2` ... if the table has it (Spark ignores case)."""
    taken, n, out = {c.lower() for c in df.columns}, 0, name
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def _line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               min_chars: int = 1) -> DataFrame:
    """The table with `text_col` rebuilt from the lines that stay, plus n_lines (before dropping) and n_dropped."""
    text = F.col(text_col).cast("string")
    # a row's identity: equal rows lose the same lines
    ident = [F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("x"), F.length(text).alias("l")]
    lines = docs.select(*ident, F.posexplode(_lines(text)).alias("p", "line"))
    key, h = _line_key(F.col("line")), ["h1", "h2"]
    # keys are hashed once: both uses below read the written table
    keyed = T.write_shared(lines.filter(F.length(F.btrim("line", F.lit(WHITE))) >= min_chars).select(
        "d", "x", "l", "p", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")), "lines")

    hot = (keyed.groupBy(*h, "d").agg(F.lit(1).alias("one"))
           .groupBy(*h).agg(F.count("one").alias("n")).filter(F.col("n") >= min_docs).select(*h))
    # a hot line's rows are split over salts; the threshold bounds the lines that are copied
    salted = hot.select(*h, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = keyed.withColumn("salt", F.pmod(F.xxhash64("d", "x"), F.lit(SALTS)).cast("int")).join(salted, [*h, "salt"]).groupBy(
        "d", "x", "l").agg(F.array_sort(F.collect_set("p")).alias("gone"))

    marked = docs.select("*", *[c.alias(n) for c, n in zip(
        (F.col(id_col).cast("long"), F.xxhash64(text), F.length(text)), ("__ld_d", "__ld_x", "__ld_l"), strict=True)])
    joined = marked.join(gone, F.col("__ld_d").eqNullSafe(F.col("d")) & (F.col("__ld_x") == F.col("x"))
                         & F.col("__ld_l").eqNullSafe(F.col("l")), "left")
    none = F.array().cast("array<int>")
    dropped = F.coalesce(F.col("gone"), none)

    def rebuild(parts: Column) -> Column:
        """Runs of lines between dropped positions; `parts` is bound once, not split per run."""
        left = F.concat(F.array(F.lit(-1)), dropped)
        right = F.concat(dropped, F.array(F.size(parts)))
        return F.array_join(F.flatten(F.zip_with(left, right, lambda a, b: F.slice(parts, a + 2, b - a - 1))), "\n")

    new_text = F.when(F.col("gone").isNull(), text).otherwise(
        F.element_at(F.transform(F.array(_lines(text)), rebuild), 1))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    return joined.select(
        *[new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(_lines(text)).cast("long").alias(n_lines), F.size(dropped).cast("long").alias(n_dropped))
