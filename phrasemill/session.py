"""Session helpers: a tuned SparkSession, the shared checkpoint folder, and
size-checked broadcasts.

Nothing here changes how Spark plans a query; it only sets the knobs a user of
this library would set on a cluster (AQE, skew join, shuffle sizing) and offers
two guards the operators use: a reliable checkpoint location read from the
session, and a broadcast that is only taken when the side is proven small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # reliable checkpoints are removed once the DataFrames using them are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Largest side we are willing to broadcast by our own decision (bytes).  Above
# it the operators fall back to a shuffle join.
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, app: str = "phrasemill",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The folder must be set by the deployment (a shared file system); this
    library sets none of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master == "local" or sc.master.startswith("local["):
        # one process, nothing is shared: beside the session's warehouse
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir must name a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_packed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for very many rows: the checkpoint holds compressed Arrow batches, a fraction of the rows' size."""
    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packet"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet in batch["packet"]:
                yield from pa.ipc.open_stream(packet.as_buffer())

    return cut_lineage(df.mapInArrow(shut, "packet binary")).mapInArrow(opened, df.schema)


def estimated_bytes(df: DataFrame, string_cols: list[str], fixed_bytes_per_row: int = 16,
                    extra=None) -> int:
    """Row count and payload of a DataFrame about to be broadcast: one
    aggregate (one row to the driver).  ``extra`` is an optional Column of
    additional bytes per row (e.g. the size of a nested array)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(f"b{i}") for i, c in enumerate(string_cols)]
    if extra is not None:
        aggs.append(F.coalesce(F.sum(extra), F.lit(0)).alias("bx"))
    row = df.agg(*aggs).first()
    n = row["n"]
    payload = sum(row[f"b{i}"] for i in range(len(string_cols)))
    if extra is not None:
        payload += row["bx"]
    return int(n * fixed_bytes_per_row + payload)


def maybe_broadcast(df: DataFrame, string_cols: list[str], max_bytes: int | None = None,
                    extra=None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when its measured size is under the cap."""
    cap = DEFAULT_MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    size = estimated_bytes(df, string_cols, extra=extra)
    if size <= cap:
        return F.broadcast(df), True
    return df, False


# Above this many rows per group Spark plans no group limit inside the tasks.
GROUP_LIMIT = 1000


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in column ``name``.

    Up to GROUP_LIMIT rows, Spark keeps only the first n of a group inside
    each task.  Beyond, a first ranking per group and salt cuts every salt to
    n rows, so a hot group is never sorted whole in one task."""
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(64))
        few = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_part", F.row_number().over(few))
              .filter(F.col("_part") <= n).drop("_salt", "_part"))
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= n)
