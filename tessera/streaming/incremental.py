"""Clean-and-bucket as a Structured Streaming query.

The job is row-local (no aggregation, no state), so new stage-1 files can be
processed as they land: ``readStream`` → the same column expressions as the
batch job → ``foreachBatch`` appending each micro-batch to the
``split=``-partitioned dataset.  The checkpoint location (shared storage) makes
the query restartable after a driver or executor loss; the file sink is
appended per batch id, so a replayed batch rewrites its own files only when the
caller's path layout includes the batch id (``batch_subdir=True``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.jobs import clean_and_bucket


def stream_clean_and_bucket(spark: SparkSession, source_dir: str, schema, out_dir: str,
                            checkpoint_dir: str, width: int = 500, json_mode: str = "exact",
                            available_now: bool = True, batch_subdir: bool = True):
    """Start the streaming job; returns the ``StreamingQuery``.  Input rows
    need ``ord`` (positions assigned at ingest), ``prompt`` and ``completion``."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    out = clean_and_bucket(src, width=width, json_mode=json_mode)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out_dir}/batch={batch_id}" if batch_subdir else out_dir
        mode = "overwrite" if batch_subdir else "append"
        batch.hint("rebalance", F.col("split")).write.mode(mode).partitionBy("split").parquet(target)

    w = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
