"""Row positions (``ord``), index ranges, batches and worker slices.

Spark rows have no order, so position is made explicit once, from a unique
key, and carried as a ``bigint`` column.  ``with_ord`` never funnels the data
through one task: it range-partitions by the key, numbers rows inside each
partition, and adds per-partition offsets from a table with one row per
partition (its size is bounded by the partition count, so it is broadcast).

The range-partitioned, numbered rows are written once as a parquet table under
the session's shared ``spark.checkpoint.dir`` before they are counted: range
bounds come from a sample whose result depends on row order inside upstream
shuffle output, so counting and numbering must read one materialised result,
not two recomputations of it.  The table is columnar, so later steps read only
the columns they use.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, scratch_dir

_LOCAL_BITS = 33   # monotonically_increasing_id(): partition id << 33 | row index


PARTITION_BYTES = 128 << 20


def input_partitions(df: DataFrame) -> int:
    """A partition per 128 MB of the tables that ``df`` reads, and at least the configured shuffle
    width (work on the rows is CPU-bound, so small inputs still get all cores)."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)      # frames without statistics report the largest number
    return max(width, -(-known // PARTITION_BYTES))


def with_ord(df: DataFrame, order_by, ord_col: str = "ord",
             num_partitions: int | None = None, materialize: str = "table",
             ranged: bool = False, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add a dense 0-based position in ``order_by`` order (keys must be unique).
    A frame that has ``ord_col`` already keeps it: positions are given once, at
    ingest.  Partitions are sized by the bytes of the tables read
    (``input_partitions``).

    ``materialize="table"`` writes the numbered rows as parquet under the
    shared checkpoint folder; ``"checkpoint"`` uses a reliable ``checkpoint()``
    there instead (row format, no column pruning on re-read).

    ``ranged``: ``df`` lies in range partitions of ``order_by`` already, so nothing is exchanged and ``df``
    is not computed a second time to draw the range bounds.

    ``then``: costly work on each row by itself (``DataFrame -> DataFrame``, the keys stay).  It is done behind the
    exchange, so once; the rows before it are computed twice, as the range bounds are drawn from them."""
    if ord_col in df.columns:
        return then(df) if then else df
    cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    spark = df.sparkSession
    if not ranged:
        df = df.repartitionByRange(num_partitions or input_partitions(df), *cols)
    numbered = (then(df) if then else df).sortWithinPartitions(*cols).withColumn("_mid", F.monotonically_increasing_id())
    if materialize == "checkpoint":
        ensure_checkpoint_dir(spark)
        stored = numbered.checkpoint(eager=True)
    else:
        path = scratch_dir(spark, "ord")
        numbered.write.parquet(path)
        stored = spark.read.parquet(path)
    # numbering is stored with the rows, so how they are read back does not matter
    ranged = (stored
              .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    per_part = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_part.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(ord_col, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_mid", "_pid", "_local", "_off"))


def slice_range(df: DataFrame, start: int, end: int | None = None,
                ord_col: str = "ord") -> DataFrame:
    """``dataset.select(range(start, min(end, len)))`` on the ``ord`` column.
    The clamp is implicit: positions past the end do not exist."""
    cond = F.col(ord_col) >= F.lit(start)
    if end is not None:
        cond = cond & (F.col(ord_col) < F.lit(end))
    return df.where(cond)


def clamped_end(df: DataFrame, end: int | None) -> int:
    """``min(end, len(df))`` — one count action."""
    n = df.count()
    return n if end is None else min(end, n)


def deinterleave(df: DataFrame, labels=("en", "vi"), ord_col: str = "ord",
                 out: str = "lang") -> DataFrame:
    """Label rows of an interleaved table by position: ``ord % k`` picks the label."""
    k = len(labels)
    expr = F.when(F.col(ord_col) % k == 0, F.lit(labels[0]))
    for i, lab in enumerate(labels[1:], start=1):
        expr = expr.when(F.col(ord_col) % k == i, F.lit(lab))
    return df.withColumn(out, expr)


def interleave(frames: list[DataFrame], ord_col: str = "ord") -> DataFrame:
    """Alternate rows of several tables (each with ``ord``) until the shortest
    is exhausted: new ``ord = ord * k + source``.  One count per input."""
    k = len(frames)
    shortest = min(f.count() for f in frames)
    out = None
    for src, f in enumerate(frames):
        g = (f.where(F.col(ord_col) < F.lit(shortest))
             .withColumn(ord_col, F.col(ord_col) * F.lit(k) + F.lit(src))
             .withColumn("source", F.lit(src)))
        out = g if out is None else out.unionByName(g)
    return out


def with_batches(df: DataFrame, batch_size: int, start: int = 0,
                 ord_col: str = "ord") -> DataFrame:
    """``batch_id = (ord - start) div k`` and 1-based ``pos`` in the batch."""
    rel = F.col(ord_col) - F.lit(start)
    return (df.withColumn("_rel", rel).withColumn("batch_id", F.expr(f"_rel div {int(batch_size)}L")).drop("_rel")
              .withColumn("pos", (rel % F.lit(batch_size) + 1).cast("int")))


def worker_slices(df: DataFrame, workers: int, per_worker: int, start: int = 0,
                  ord_col: str = "ord") -> tuple[DataFrame, dict]:
    """Contiguous worker slices over ``ord``.  The reference processes
    ``total // workers`` rows per worker and silently drops the remainder; here
    every row in ``[start, start + total)`` is kept and the remainder goes to
    the last worker.  Returns the rows with ``slice_id`` and a plan summary."""
    available = df.where(F.col(ord_col) >= F.lit(start)).count()
    total = min(available, workers * per_worker)
    per = total // workers
    planned = {"planned": total, "per_worker": per, "reference_covered": per * workers}
    rows = df.where((F.col(ord_col) >= F.lit(start)) & (F.col(ord_col) < F.lit(start + total)))
    if per == 0:
        sid = F.lit(0)
    else:
        sid = F.least(F.expr(f"(`{ord_col}` - {int(start)}L) div {int(per)}L"), F.lit(workers - 1))
    return rows.withColumn("slice_id", sid.cast("int")), planned
