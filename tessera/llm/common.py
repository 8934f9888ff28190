"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import scratch_dir

#: Fixed value: a word is a run of anything but the six ASCII blanks.  ``bytes.split()`` cuts at
#: exactly these bytes, so Python code splits encoded text instead of running the pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a task takes, before a table is worth more tasks than twice the cores.
ROWS_A_TASK = 100_000


def fewer_tasks(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` of at most ``rows`` rows (None: unknown) in no more tasks than it is worth: a task and its file cost
    more than a few rows.  From ``ROWS_A_TASK`` rows a partition on nothing changes."""
    return df if rows is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: cuts the lineage and
    survives lost executors, whatever recomputes later reads the same rows."""
    path = scratch_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_draw(*cols) -> Column:
    """A number in (0, 1) decided by the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * (2.0 ** -53)


def bucket_of(n: int, *cols) -> Column:
    """A bucket 0..n-1 decided by the columns alone."""
    return F.pmod(F.xxhash64(F.lit("bucket"), *cols), F.lit(n)).cast("int")


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list, value: str | None,
                out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (rows, if None) over the rows of the group that come
    earlier in (bucket, order).  The bucket column splits every group into even parts, so no task
    sorts a whole hot group: parts are summed on their own and shifted by the earlier parts'
    totals (one row per group and bucket).  Group columns must not be null."""
    v = F.lit(1).cast("bigint") if value is None else F.col(value).cast("bigint")
    totals = df.groupBy(*groups, bucket).agg(F.sum(v).alias("_total"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*groups, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    inside = (Window.partitionBy(*groups, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    parts = df.withColumn("_inside", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return (parts.join(shifts, [*groups, bucket])
            .withColumn(out, F.col("_shift") + F.col("_inside")).drop("_shift", "_inside"))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker: functions are shipped by value, so their
    module globals are new in each task, while ``sys.modules`` stays.  Caches of other names go, as
    the next operator on the same worker needs the memory."""
    mod = sys.modules.setdefault("_tessera_worker_cache", types.ModuleType("_tessera_worker_cache"))
    for other in [k for k, v in mod.__dict__.items() if isinstance(v, dict) and k != name and not k.startswith("__")]:
        del mod.__dict__[other]
    return mod.__dict__.setdefault(name, {})
