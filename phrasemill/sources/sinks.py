"""Sinks (SNK-1..3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv_clean(col: Column) -> Column:
    """Tabs, carriage returns and newlines become spaces."""
    return F.regexp_replace(col, r"[\t\r\n]", " ")


def results_tsv_rows(results: DataFrame) -> DataFrame:
    """SNK-1 rows: term, excerpt, title (the term is written as given)."""
    return results.select("term", tsv_clean(F.col("excerpt")).alias("excerpt"),
                          tsv_clean(F.col("title")).alias("title"))


def write_results_tsv(results: DataFrame, path: str) -> None:
    """SNK-1: ``term<TAB>excerpt<TAB>title`` lines, written as plain text
    (no quoting, no trimming — the CSV writer would do both), overwriting
    ``path`` (a directory of part files, as every Spark sink)."""
    rows = results_tsv_rows(results)
    (rows.select(F.concat_ws("\t", "term", "excerpt", "title").alias("value"))
     .write.mode("overwrite").text(path))


def write_results_parquet(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def format_columns(df: DataFrame, rules: dict[str, list[tuple[str, str, bool]]]) -> DataFrame:
    """SNK-2: per column, ordered (pattern, replacement, stop_after) rules,
    each a replace-all; once a ``stop_after`` rule has matched, the later
    rules of that column are not applied.  Each step is its own projection so
    the expression does not grow with the number of rules."""
    out = df
    for col, rule_list in rules.items():
        out = out.withColumn("_stop", F.lit(False))
        for pattern, replacement, stop_after in rule_list:
            out = out.withColumn("_m", ~F.col("_stop") & F.col(col).rlike(pattern))
            out = out.withColumn(col, F.when(F.col("_stop"), F.col(col))
                                 .otherwise(F.regexp_replace(F.col(col), pattern, replacement)))
            if stop_after:
                out = out.withColumn("_stop", F.col("_stop") | F.col("_m"))
        out = out.drop("_stop", "_m")
    return out
