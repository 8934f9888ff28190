"""Do index ranges cover a table (R8)?  Gaps, overlaps and ranges outside of it, by a sweep over their ends.

Shards are published as ``{prefix}_{start}_{end}`` by separate jobs; before they are joined, their half-open
ranges should cover ``[0, total)`` once.  The sweep adds +1 where a range starts and -1 where one ends,
sums equal points first (a point that many ranges share is one row) and carries the depth from point to
point.  Points are range-partitioned: depth and next point are found inside a partition, and a
table with one row per partition carries both across borders, so no task sees all points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_dir


class CoverageError(RuntimeError):
    """Raised by ``require_coverage``."""


def range_coverage(ranges: DataFrame, total: int, start_col: str = "start", end_col: str = "end",
                   num_partitions: int | None = None) -> DataFrame:
    """Faults of the ranges against ``[0, total)``: rows ``kind, begin, finish, depth`` where

    * ``gap``: part of ``[0, total)`` that no range covers (depth 0);
    * ``overlap``: a stretch that ``depth`` >= 2 ranges cover;
    * ``outside``: a stretch below 0 or from ``total`` on that ``depth`` ranges cover;
    * ``invalid``: a range with a null end or one that holds nothing; its own ends, depth null.

    No rows: every position is covered once.  Touching stretches of different depth are separate rows; one of
    equal depth is one row."""
    spark = ranges.sparkSession
    r = ranges.select(F.col(start_col).cast("bigint").alias("s"), F.col(end_col).cast("bigint").alias("e"))
    valid = F.coalesce(F.col("s") < F.col("e"), F.lit(False))
    ends = r.where(valid).select(F.inline(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("step")),
                                                  F.struct(F.col("e").alias("p"), F.lit(-1).alias("step")))))
    border = spark.range(1).select(F.inline(F.array(F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).alias("step")),
                                                    F.struct(F.lit(int(total)).cast("bigint").alias("p"), F.lit(0).alias("step")))))
    points = (ends.unionByName(border).groupBy("p").agg(F.sum("step").alias("step"))
              .where((F.col("step") != 0) | F.col("p").isin(0, int(total))))
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, "coverage")
    # stored with the partition's number: a recomputed range exchange could draw other borders
    points.repartitionByRange(n, "p").withColumn("part", F.spark_partition_id()).write.parquet(path)
    points = spark.read.parquet(path)
    per_part = points.groupBy("part").agg(F.sum("step").alias("sum"), F.min("p").alias("first"))
    order = Window.orderBy("part")                                    # one row per partition
    carried = per_part.select("part", F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                              F.lead("first").over(order).alias("after"))
    inside = Window.partitionBy("part").orderBy("p")
    swept = (points.join(F.broadcast(carried), "part")
             .select(F.col("p").alias("begin"), F.coalesce(F.lead("p").over(inside), F.col("after")).alias("finish"),
                     (F.col("before") + F.sum("step").over(inside)).cast("bigint").alias("depth")))
    within = (F.col("begin") >= 0) & (F.col("begin") < int(total))
    kind = (F.when(within & (F.col("depth") == 0), "gap").when(within & (F.col("depth") > 1), "overlap")
            .when(~within & (F.col("depth") > 0), "outside"))
    faults = swept.where(F.col("finish").isNotNull()).select(kind.alias("kind"), "begin", "finish", "depth").where("kind is not null")
    bad = r.where(~valid).select(F.lit("invalid").alias("kind"), F.col("s").alias("begin"), F.col("e").alias("finish"),
                                 F.lit(None).cast("bigint").alias("depth"))
    return faults.unionByName(bad)


def require_coverage(ranges: DataFrame, total: int, start_col: str = "start", end_col: str = "end") -> None:
    """Raise ``CoverageError`` naming the first faults unless the ranges cover ``[0, total)`` exactly once."""
    faults = range_coverage(ranges, total, start_col, end_col).orderBy("begin", "finish").limit(5).collect()
    if faults:
        raise CoverageError("; ".join(f"{f.kind} [{f.begin}, {f.finish})" for f in faults))
