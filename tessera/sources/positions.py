"""Row positions of a stored table, kept beside it (W1): rows are numbered without being moved.

``with_ord`` numbers a frame by sorting and rewriting all its columns.  For a table that lies in parquet
files a row already has an address, its file and its place in that file, so only ``(keys, address)``
are sorted and what is kept is ``(address, ord)``:

* ``append`` numbers the rows of files that the positions do not know yet, behind the ones they
  know.  The keys are shuffled once and the addresses twice, both without any other column.  Positions that were
  given never change.
* ``read`` scans the table and looks every row's position up by its address.  The plan has no exchange;
  the lookup is an Arrow UDF that sees the address alone, so the other columns stay in the JVM.

Addresses are cut into chunks of ``CHUNK`` rows, so a task holds the positions of one chunk (1 MB) however
long a file is, and chunks are dealt to folders by hash.  The list of known files is written last: an
``append`` that dies leaves positions that nobody reads, and the next one writes over them.

Ties in the keys (and null keys, which come first) are ordered by address, so every row has a
position.  One ``append`` runs at a time.  A table whose known files were removed or rewritten is refused.
The driver holds the list of files, as Spark's own file listing does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.position import _LOCAL_BITS, PARTITION_BYTES
from tessera.session import scratch_dir
from tessera.sources.ledger import _filesystem

CHUNK_BITS = 17
CHUNK = 1 << CHUNK_BITS                # rows of one file whose positions are looked up together
_ROWS_PER_FOLDER = 1 << 23
_FILES = "file string, modified timestamp, n bigint, gen int, folders int"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per numbered file: ``file, modified, n, gen, folders``."""
    if not _exists(spark, f"{path}/files"):
        return spark.createDataFrame([], _FILES)
    return spark.read.schema(_FILES).parquet(f"{path}/files")


def _addressed(df: DataFrame) -> DataFrame:
    return (df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
            .withColumn("_modified", F.col("_metadata.file_modification_time")))


def _check(spark: SparkSession, table: str, known: dict) -> list[str]:
    """Files of the table, URL-encoded as ``_metadata.file_path`` names them; an error if a numbered one is gone."""
    # a local file is listed as file:///a and named file:/a
    present = [re.sub("^file:/+", "file:/", f) for f in spark.read.parquet(table).inputFiles()]
    gone = set(known) - set(present)
    if gone:
        raise ValueError(f"{len(gone)} numbered files of {table} are gone, such as {min(gone)}")
    return present


def append(spark: SparkSession, table: str, path: str, order_by) -> int:
    """Number the rows of new files of ``table`` in ``order_by`` order, after the rows numbered before.
    Returns how many rows were numbered.  Only the key columns of new files are read."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    known = {r.file: r for r in known_files(spark, path).collect()}
    new = sorted(set(_check(spark, table, known)) - set(known))
    if not new:
        return 0
    gen = max((r.gen for r in known.values()), default=-1) + 1
    first = sum(r.n for r in known.values())
    rows = spark.read.option("basePath", table).parquet(*map(unquote, new))
    files = (rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
             .agg(F.count(F.lit(1)).alias("n")))
    counts = files.collect()
    total = sum(r.n for r in counts)
    folders = max(1, -(-total // _ROWS_PER_FOLDER))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(width, -(-total * 64 // PARTITION_BYTES))
    keys = [F.col(f"_k{i}") for i in range(len(cols))]
    keyed = _addressed(rows).select("_file", "_row", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)])
    scratch = scratch_dir(spark, "positions")
    # stored before it is counted: a recomputed range exchange could draw other borders
    (keyed.repartitionByRange(n, *keys, "_file", "_row").sortWithinPartitions(*keys, "_file", "_row")
     .select("_file", "_row", F.monotonically_increasing_id().alias("_mid")).write.parquet(scratch))
    numbered = spark.read.parquet(scratch).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)       # one row per partition
    offsets = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select(
        "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + first).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = (numbered.join(F.broadcast(offsets), "_pid")
           .select("_file", F.shiftright("_row", CHUNK_BITS).alias("chunk"), "_row", (F.col("_off") + local).alias("ord"))
           .withColumn("folder", _folder("_file", "chunk", F.lit(folders))))
    (out.repartition(min(n, folders * 8), "_file", "chunk").sortWithinPartitions("folder", "_file", "chunk", "_row")
     .select("folder", F.col("_file").alias("file"), "chunk", F.col("_row").alias("place"), "ord")
     .write.mode("overwrite").option("parquet.block.size", 1 << 21).partitionBy("folder").parquet(f"{path}/ords/gen={gen}"))
    done = [(r.file, r.modified, r.n, gen, folders) for r in counts] + [
        (f, None, 0, gen, folders) for f in set(new) - {r.file for r in counts}]       # files without rows
    spark.createDataFrame(done, _FILES).coalesce(1).write.mode("append").parquet(f"{path}/files")
    return total


def _folder(file, chunk, folders) -> F.Column:
    return F.pmod(F.xxhash64(file, chunk), folders).cast("int")


def _lookup(path: str):
    """The position of each address; holds the positions of one chunk at a time."""
    @F.pandas_udf("bigint")
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        store, root = _filesystem(path)
        held, ords = None, None
        for gens, folder, files, rows in batches:
            place = rows.to_numpy()
            chunks = place >> CHUNK_BITS
            out = np.empty(len(place), dtype=np.int64)
            codes, names = pd.factorize(files)
            edges = np.flatnonzero(np.diff(codes) | np.diff(chunks)) + 1
            for a, b in zip([0, *edges], [*edges, len(place)]):
                if a == b:
                    continue
                name, chunk = names[codes[a]], int(chunks[a])
                if held != (name, chunk):
                    where = f"{root}/ords/gen={gens.iloc[a]}/folder={folder.iloc[a]}"
                    found = ds.dataset(where, filesystem=store, format="parquet").to_table(
                        columns=["place", "ord"], filter=(pc.field("file") == name) & (pc.field("chunk") == chunk))
                    ords = np.full(CHUNK, -1, dtype=np.int64)
                    ords[found["place"].to_numpy() - chunk * CHUNK] = found["ord"].to_numpy()
                    held = (name, chunk)
                out[a:b] = ords[place[a:b] - chunk * CHUNK]
            if (out < 0).any():
                raise ValueError("a row has no position: its file was rewritten")
            yield pd.Series(out)

    return find


def read(spark: SparkSession, table: str, path: str, columns: list[str] | None = None, ord_col: str = "ord",
         broadcast_files: int = 100_000) -> DataFrame:
    """The numbered rows of ``table`` with their position; files that were not appended yet are left out.
    ``columns``: those wanted, so that the scan reads no other.  The list of files is broadcast up to
    ``broadcast_files`` of them (some 200 bytes each) and joined as Spark sees fit beyond."""
    known = known_files(spark, path)
    rows_of = known.where("n > 0").collect()
    _check(spark, table, {r.file: r for r in rows_of})
    if not rows_of:
        empty = spark.read.parquet(table)
        return empty.select(*(columns or empty.columns), F.lit(None).cast("bigint").alias(ord_col)).where("false")
    rows = spark.read.option("basePath", table).parquet(*[unquote(r.file) for r in rows_of])
    kept = columns or rows.columns
    files = known.where("n > 0").select(F.col("file").alias("_file"), F.col("modified").alias("_known"),
                                        F.col("gen").alias("_gen"), F.col("folders").alias("_folders"))
    if len(rows_of) <= broadcast_files:
        files = F.broadcast(files)
    found = _addressed(rows).select(*kept, "_file", "_row", "_modified").join(files, "_file", "left")
    gen = F.when(F.col("_known") == F.col("_modified"), F.col("_gen")).otherwise(
        F.raise_error(F.concat(F.lit("rewritten after it was numbered: "), "_file")))
    folder = _folder("_file", F.shiftright("_row", CHUNK_BITS), F.col("_folders"))
    return found.withColumn(ord_col, _lookup(path)(gen, folder, F.col("_file"), F.col("_row"))).select(*kept, ord_col)
