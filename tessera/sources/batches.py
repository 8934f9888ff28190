"""Tables stored by batch (J3, W2): requests and responses of a batch lie in the same bucket.

Grouping requests by batch, joining responses to them and joining any later answers each shuffle both
sides by ``batch_id``.  Stored once in hash buckets of ``batch_id``, with the same number of buckets on either
side, these steps need no exchange; Spark plans that itself from the table's bucket specification.  A
batch holds at most ``batch_size`` rows, so buckets are even.

A bucketed table must be in the session's catalogue.  It is registered as an external table over its
folder, under a name made from the folder, so another session opens it again with ``open_table``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.position import input_partitions

KEY = "batch_id"


def _name(path: str) -> str:
    return "by_batch_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]


def publish(df: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Store ``df`` by ``batch_id`` in a new folder and return the stored table.  ``buckets``: by the bytes of
    the tables that ``df`` reads (default)."""
    spark, n = df.sparkSession, buckets or input_partitions(df)
    order = [c for c in (KEY, "pos") if c in df.columns]
    (df.repartition(n, KEY).write.mode("errorifexists").option("path", path).bucketBy(n, KEY).sortBy(*order)
     .format("parquet").saveAsTable(_name(path)))
    return spark.table(_name(path))


def publish_like(df: DataFrame, other: str, path: str) -> DataFrame:
    """Store ``df`` in as many buckets as the table stored in the folder ``other`` has."""
    return publish(df, path, bucket_count(df.sparkSession, other))


def bucket_count(spark: SparkSession, path: str) -> int:
    """Number of buckets of the table stored in ``path``, as the catalogue has it."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_name(path)}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)


def open_table(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """A table stored by another session; ``schema`` and ``buckets`` as it was written."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({schema}) USING parquet CLUSTERED BY ({KEY}) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(_name(path))


def forget(spark: SparkSession, path: str) -> None:
    """Take the table out of the catalogue; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
