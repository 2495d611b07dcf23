"""Search term files as they arrive (foreachBatch over a file stream)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.operators import postings as PO
from phrasemill.operators import ranking as RK
from phrasemill.plans import batch as B
from phrasemill.session import cut_lineage
from phrasemill.sources import sinks


USAGE = "docid long, n long"


def number_terms(terms: DataFrame, epoch_id: int) -> DataFrame:
    """term_no = epoch * 2^40 + position in the batch: partitions are numbered
    one after another, so a batch uses as many numbers as it has terms."""
    rows = cut_lineage(terms.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))   # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_id")) - 1
    return rows.withColumn("_part", part).join(sizes, "_part").select(
        (F.lit(epoch_id).cast("long") * F.lit(1 << 40) + place).alias("term_no"), "term")


def search_term_files(spark: SparkSession, source: DataFrame | PO.Index, terms_dir: str, out_dir: str,
                      checkpoint_location: str, cfg: B.SearchConfig = B.SearchConfig(),
                      available_now: bool = True):
    """Start the query on the document table or a stored index; returns the StreamingQuery.

    Each micro-batch: number its terms (epoch-major, so earlier batches keep
    priority), run the batch search with the usage so far, append the TSV
    rows under ``out_dir/epoch=N`` and rewrite the usage table (written to a
    new folder, then read back — never overwritten while being read)."""
    usage_root = os.path.join(out_dir, "_usage")

    def per_batch(df: DataFrame, epoch_id: int) -> None:
        prev_dir = os.path.join(usage_root, f"epoch={epoch_id - 1}")
        # every batch writes its table, so the one before is there (or the read raises)
        usage = spark.read.schema(USAGE).parquet(prev_dir) if epoch_id > 0 else spark.createDataFrame([], USAGE)
        this_dir = os.path.join(usage_root, f"epoch={epoch_id}")
        if df.isEmpty():
            usage.write.mode("overwrite").parquet(this_dir)
            return
        terms = number_terms(df.select(F.col("value").alias("term")).filter(F.trim("term") != ""), epoch_id)
        res = B.run_batch(source, terms, cfg, usage)
        res = cut_lineage(res)
        sinks.write_results_tsv(res, os.path.join(out_dir, f"epoch={epoch_id}"))
        RK.source_usage(res, usage).write.mode("overwrite").parquet(this_dir)

    stream = spark.readStream.schema("value string").text(terms_dir)
    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
