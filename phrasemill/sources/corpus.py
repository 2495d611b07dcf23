"""Readers (SRC-1..8) and adapters that map the driver tables onto the
corpus model.

Model: a corpus is a table of lines ``(line_no, raw)``; a line is
``title <delimiter> content`` and the last character of the title is the
document score.  Tables that already carry a key (the driver's ``documents``)
skip numbering and map their columns directly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.functions import patterns as P
from phrasemill.session import cut_lineage, maybe_broadcast

def number_lines(df: DataFrame, text: str | None = None) -> DataFrame:
    """1-based line numbers in file order, without moving the lines.

    Each input split is a contiguous run of lines.  One pass counts the lines
    of every (file, split) — a table with one row per split, so its size is
    bounded by the number of splits — and a broadcast join adds each split's
    starting line number to the row's position inside the split.

    With the name of the ``text`` column, a file whose last byte is a line feed
    has one more, empty line at its end, as a reader that splits at line feeds
    gives it (Spark's does not): its lines and line feeds make up the file's
    whole size.  ``file_no`` counts the files from 0.
    """
    tagged = (df.withColumn("_file", F.col("_metadata.file_path"))
                .withColumn("_size", F.col("_metadata.file_size"))
                .withColumn("_block", F.col("_metadata.file_block_start"))
                .withColumn("_mid", F.monotonically_increasing_id()))
    size = F.octet_length(text) + 1 if text else F.lit(0)
    blocks = (tagged.groupBy("_file", "_block")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), F.sum(size.cast("long")).alias("_bytes"),
                   F.first("_size").alias("_size")))
    # Lines before each file (one row per file), and before each split within
    # its file: no window sees more than the files, or one file's splits.
    # A byte order mark of three bytes is no part of the first line.
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_own"), (F.first("_size") - F.sum("_bytes")).isin(0, 3).alias("_tail"))
    tail = F.col("_tail").cast("long") if text else F.lit(0).cast("long")
    ahead = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("_lines", F.col("_own") + tail).withColumn(
        "_before", F.coalesce(F.sum("_lines").over(ahead), F.lit(0))).withColumn("file_no", F.count(F.lit(1)).over(ahead))
    files = files.select("_file", "_before", "_lines", "file_no", (tail > 0).alias("_tail"))
    inside = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    skip = blocks.withColumn("_skip", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(files, "_file").select(
        "_file", "_block", "_first", "file_no", (F.col("_before") + F.col("_skip")).alias("_base"))
    skip, _ = maybe_broadcast(skip, ["_file"])
    out = (tagged.join(skip, ["_file", "_block"])
           .withColumn("line_no", F.col("_base") + F.col("_mid") - F.col("_first") + 1)
           .drop("_file", "_size", "_block", "_mid", "_first", "_base"))
    if text is None:
        return out
    empty = files.filter("_tail").select(F.lit("").alias(text), "file_no", (F.col("_before") + F.col("_lines")).alias("line_no"))
    return out.unionByName(empty)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1/2: (line_no, raw, file_no), split on ``\\n`` only (``\\r`` stays in the line);
    a file that ends with a line feed has an empty last line.  (Of a compressed
    file the size says nothing; it gets none.)"""
    lines = spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "raw")
    return number_lines(lines, "raw").select("line_no", "raw", "file_no")


def split_lines(lines: DataFrame, delimiter: str = P.DEFAULT_DELIMITER) -> tuple[DataFrame, DataFrame]:
    """SRC-3/4 + IDX-5: (line_no, title, content, base_score) and rejects.

    The delimiter is a regular expression; the first match splits the line
    (Java ``split(regex, 2)``).  Lines without it are rejected.
    """
    parts = F.split(F.col("raw"), delimiter, 2)
    staged = lines.select(
        "line_no", "raw",
        parts.getItem(0).alias("title"),
        F.when(F.size(parts) >= 2, parts.getItem(1)).alias("content"),
    )
    return parse_scores(staged)


def parse_scores(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-4: the score is the last character of the title, one ASCII digit.

    ``staged`` has (line_no, raw, title, content); content is null when the
    line had no delimiter."""
    last = F.substring(F.col("title"), -1, 1)
    score = F.when(last.rlike(r"^[0-9]\z"), last.cast("double"))
    staged = staged.withColumn("base_score", score).withColumn(
        "reason", F.when(F.col("content").isNull(), F.lit("no delimiter"))
                   .when(F.col("base_score").isNull(), F.lit("no score")))
    good = staged.filter(F.col("reason").isNull()).select("line_no", "title", "content", "base_score")
    rejects = staged.filter(F.col("reason").isNotNull()).select(
        "line_no", F.substring("raw", 1, 100).alias("raw"), "reason")
    return good, rejects


# ---------------------------------------------------------------------------
# Score rules, terms, excluded words: tables, like the corpus.

@dataclass(frozen=True)
class ScoreRule:
    rule_no: int
    kind: str      # "REGEX" or "EXACT"
    text: str
    adj: float
    stop: bool


def parse_rule_lines(lines: list[str]) -> list[ScoreRule]:
    """SRC-5: tab-separated (kind, text, adjustment, stop) rules in file order.

    Comments are whole lines matching ``^\\s*#.+``; a line without exactly four
    fields (trailing empty fields do not count) is skipped; a bad number aborts.
    """
    import re
    rules: list[ScoreRule] = []
    for line in lines:
        if re.fullmatch(r"[ \t\n\x0B\f\r]*#.+", line):
            continue
        fields = line.split("\t")
        while fields and fields[-1] == "":
            fields.pop()
        if len(fields) != 4:
            continue
        kind = "EXACT" if fields[0] == "EXACT" else "REGEX"
        try:
            adj = float(fields[2].strip())
        except ValueError as exc:
            raise ValueError(f"invalid score offset in rule: {line!r}") from exc
        rules.append(ScoreRule(len(rules) + 1, kind, fields[1], adj, fields[3] == "T"))
    return rules


RULE_COLUMNS = "rule_no long, kind string, text string, adj double, stop boolean"


def rules_table(spark: SparkSession, rules: list[ScoreRule]) -> DataFrame:
    """Rules given as values, as a table."""
    return spark.createDataFrame([(r.rule_no, r.kind, r.text, float(r.adj), bool(r.stop)) for r in rules], RULE_COLUMNS)


def parse_rules(lines: DataFrame) -> DataFrame:
    """SRC-5 on a table of lines (line_no, value): (rule_no, kind, text, adj, stop, line), rule_no being the line's
    number; adj is null where it is no number."""
    value = F.regexp_replace("value", r"\r\z", "")
    fields = F.split(F.regexp_replace(value, r"\t+\z", ""), "\t", -1)
    kept = lines.select(F.col("line_no").alias("rule_no"), value.alias("line"), fields.alias("f")).filter(
        ~F.col("line").rlike(r"\A[ \t\n\x0B\f\r]*#.+\z") & (F.size("f") == 4))
    f = F.col("f")
    return kept.select("rule_no", F.when(f[0] == "EXACT", "EXACT").otherwise("REGEX").alias("kind"), f[1].alias("text"),
                       F.trim(f[2]).try_cast("double").alias("adj"), (f[3] == "T").alias("stop"), "line")


def check_rules(rules: DataFrame) -> DataFrame:
    """Raise on a bad adjustment or regular expression, before any corpus is read: one job for all rules."""
    valid = F.when(F.col("kind") == "REGEX", F.rlike(F.lit("x"), F.col("text")).cast("int"))
    try:
        bad = rules.agg(F.min(F.when(F.col("adj").isNull(), F.col("line"))).alias("bad"), F.sum(valid)).first()["bad"]
    except Exception as exc:
        raise ValueError("invalid regular expression in a rule") from exc
    if bad is not None:
        raise ValueError(f"invalid score offset in rule: {bad!r}")
    return rules


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: the rules of a file, or of several in order of their names, as a table."""
    lines = number_lines(spark.read.option("lineSep", "\n").text(path))
    rules = cut_lineage(parse_rules(lines.select("line_no", "value")))   # parsed once; also read by every search plan
    return check_rules(rules).drop("line")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: one term per line, blank lines skipped, not trimmed or deduplicated."""
    lines = spark.read.text(path).withColumnRenamed("value", "term")
    numbered = number_lines(lines).withColumnRenamed("line_no", "term_no")
    return numbered.filter(F.trim(F.col("term")) != "").select("term_no", "term")


def read_excluded_words(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: (word), one pattern per line; empty lines are none."""
    return spark.read.text(path).withColumnRenamed("value", "word").filter("word <> ''")


# ---------------------------------------------------------------------------
# Driver tables.

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> already-split lines: line_no = doc_id, title = source,
    content = text; the score digit is the last character of the source."""
    docs = table(spark, sf_dir, "documents")
    # A missing text is an empty document (a line "title.txt:" is valid).
    # Non-null content also lets the per-title pass read only doc_id and
    # source: the delimiter check folds away.
    return docs.select(F.col("doc_id").cast("long").alias("line_no"),
                       F.substring("text", 1, 100).alias("raw"),
                       F.col("source").alias("title"), F.coalesce(F.col("text"), F.lit("")).alias("content"))


def within(df: DataFrame, count) -> int:
    """One more than the largest per-row count (a Column) of the table: the
    width that keeps (row id, position) apart as row id * width + position."""
    return int(df.agg(F.max(count).alias("m")).first()["m"] or 0) + 1


def lines_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, numbered by (document, line)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    width = within(docs, F.size("ls"))
    return docs.select("doc_id", F.posexplode("ls").alias("i", "raw")).select(
        (F.col("doc_id") * F.lit(width).cast("long") + F.col("i")).alias("line_no"), "raw")


def lines_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary corpus: one line per turn, title = role + ' ' + turn % 10."""
    conv = table(spark, sf_dir, "conversations")
    width = within(conv, F.col("turn"))
    return conv.select(
        (F.col("conv_id") * F.lit(width).cast("long") + F.col("turn")).cast("long").alias("line_no"),
        F.concat_ws(".txt:", F.concat_ws(" ", F.col("role"), (F.col("turn") % 10).cast("string")),
                    F.col("text")).alias("raw"))


def terms_from_benchmark(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (1, 2, 3), whole: bool = True,
                         only_at: int | None = None) -> DataFrame:
    """Terms from the whole ``benchmark`` texts: every window of ``sizes``
    words, and (``whole``) all words of the text as one phrase.  Identical
    phrases stay apart: term_no = item * width + 4 * first word + size (0: the
    whole text).  ``only_at`` keeps the windows that start at one word (bench)."""
    bench = table(spark, sf_dir, "benchmark").select(
        "item_id", F.regexp_extract_all(F.col("text"), F.lit(P.AN), F.lit(0)).alias("w"))
    width = 4 * within(bench, F.size("w"))
    n_words = F.size("w")

    def window(n: int):
        first = F.sequence(F.lit(0), n_words - n) if only_at is None else F.array(F.lit(only_at))
        fits = n_words >= n if only_at is None else n_words >= only_at + n
        return F.when(fits, F.transform(first, lambda i: F.struct(
            (i * 4 + n).alias("k"), F.array_join(F.slice("w", i + 1, n), " ").alias("term")))).otherwise(
                F.array().cast("array<struct<k:int,term:string>>"))

    parts = [window(n) for n in sizes]
    if whole:
        parts.append(F.when(n_words > 0, F.array(F.struct(F.lit(0).alias("k"), F.array_join("w", " ").alias("term")))
                            ).otherwise(F.array().cast("array<struct<k:int,term:string>>")))
    return bench.select("item_id", F.explode(F.concat(*parts)).alias("t")).select(
        (F.col("item_id") * F.lit(width).cast("long") + F.col("t.k")).cast("long").alias("term_no"), "t.term")
