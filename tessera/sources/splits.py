"""A dataset is one folder; its named splits are ``split=`` partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One named split (S1); the ``split`` filter prunes partitions at the scan."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == F.lit(split))


def read_splits_like(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """All splits whose name starts with ``prefix`` (partition pruning)."""
    return spark.read.parquet(path).where(F.startswith(F.col("split"), F.lit(prefix)))


def write_splits(df: DataFrame, path: str, split_col: str = "split",
                 max_records_per_file: int = 1_000_000, mode: str = "overwrite") -> None:
    """Write every split of ``df`` in one job (S3, S4).  Dynamic partition
    overwrite replaces only the splits present in ``df``.  Rows are rebalanced
    by split first: a small split is one file however many tasks there are, a
    large (skewed) split is divided by size; ``maxRecordsPerFile`` caps files."""
    (df.hint("rebalance", F.col(split_col)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .option("maxRecordsPerFile", max_records_per_file).partitionBy(split_col).parquet(path))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def parse_range_split(col, prefix: str):
    """``{prefix}_{start}_{end}`` → ``(start, end)`` columns."""
    rx = "^" + prefix.replace(".", r"\.") + r"_([0-9]+)_([0-9]+)$"
    return (F.regexp_extract(col, rx, 1).try_cast("bigint"),
            F.regexp_extract(col, rx, 2).try_cast("bigint"))
