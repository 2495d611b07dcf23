"""The driver's tables as DataFrames, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from phrasemill.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_shared(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once to the folder in spark.checkpoint.dir and read back: cuts the
    lineage, survives lost executors, and later branches don't recompute it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file (installed beside Python on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN
