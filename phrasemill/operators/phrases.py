"""Equal phrases among the terms are searched once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.session import cut_lineage, maybe_broadcast


def distinct_phrases(terms: DataFrame, max_broadcast_bytes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The terms with tokens, each phrase once (under its smallest term_no), and (term_no, _of): whose rows each term
    gets.  Rows of equal phrases are alike, and a frequent word can be a term hundreds of times.  None where a term_no
    repeats or is null: such terms share rows and stay as they are."""
    terms = terms.filter("n_toks > 0")
    n = terms.agg(F.count(F.lit(1)).alias("all"), F.countDistinct("term_no").alias("own"), F.countDistinct("phrase").alias("phrases")).first()
    if n["own"] < n["all"] or n["phrases"] == n["all"]:
        return terms, None
    first = terms.groupBy("phrase").agg(F.min("term_no").alias("_of"))
    same = terms.select("term_no", "phrase").join(first, "phrase").select("term_no", "_of")
    same, _ = maybe_broadcast(cut_lineage(same), [], max_broadcast_bytes)
    once = terms.join(same.filter("term_no = _of").select("term_no"), "term_no", "left_semi")
    return once, same


def for_each_term(rows: DataFrame, same: DataFrame | None) -> DataFrame:
    """Rows of distinct phrases, given to every term with the phrase."""
    if same is None:
        return rows
    columns = rows.columns
    return rows.withColumnRenamed("term_no", "_of").join(same, "_of").select(*columns)


def one_row_a_line(docs: DataFrame) -> bool:
    n = docs.agg(F.count(F.lit(1)).alias("all"), F.countDistinct("line_no").alias("own")).first()
    return n["all"] == n["own"]
