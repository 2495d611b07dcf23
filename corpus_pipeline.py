"""Corpus pipeline: five stages over `documents`, each one operator of phrasemill.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs.  All but the last return the columns of
their input; where a stage changes texts, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import packing, pii, quality, simhash
from phrasemill.llm import tables as T
from phrasemill.llm.line_dedup import line_dedup

THRESHOLD = 0.3


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The input's columns; n_chars counted anew."""
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                        for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (operator 9)."""
    labels = T.read(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    meta = tuple(c for c in ("n_chars",) if c in docs.columns)
    model = quality.train(docs, labels, "quality", metadata=meta)
    scored = quality.score(docs, model, metadata=meta, out_col="__score")
    return scored.filter(F.col("__score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go (operator 10)."""
    return _as_before(line_dedup(docs), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (operator 8)."""
    return simhash.keep_one(docs)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced (operator 4)."""
    return _as_before(pii.sanitise(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows (operator 2): one row per piece with its ids (little-endian unsigned 32-bit)."""
    return packing.pack_documents(docs, T.tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("simhash", one_of_each), ("pii", hide_personal),
          ("packing", pack)]

# A learned classifier and a tokenizer take part: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written to the shared folder and read again."""
    docs = T.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = T.write_shared(docs, f"pipeline-{name}")
    return docs
