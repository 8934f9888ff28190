"""A survey kept beside a growing dataset (A1, A2, A6): an append surveys new files only.

The state has one row per ``(file, part count, label)``: rows, parsed rows, and the least and greatest token
count.  All of a survey follows from sums, least and greatest over such rows, so surveys of files are
merged instead of repeated:

* ``update`` lists the files with their time of change, surveys those that are new or were rewritten and
  adds their rows as a new folder of the state;
* ``survey``, ``histogram`` and ``token_minmax`` merge the rows of the files that are present as they were
  surveyed, so rows of removed or replaced files do not count.

A state folder is visible once it is whole (it is written under a hidden name and renamed).  If two updates
survey the same file, its rows are counted once.  Only the driver's list of changed files grows, with
the files of one append.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import survey as sv

_SCHEMA = ("file string, modified timestamp, part_count bigint, parsed boolean, label string, n bigint, "
           "min_tokens bigint, max_tokens bigint, run string")


def _files(spark: SparkSession, table: str) -> DataFrame:
    """``file, modified`` of the table; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(table)
    return listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def update(spark: SparkSession, table: str, path: str, tokens: Column | None = None, label_col: str | None = None,
           completion_col: str = "completion") -> int:
    """Survey the files that the state does not know as they are now; returns how many there were.
    ``tokens``: token count of a row; ``label_col``: the group of ``token_minmax`` (such as a language)."""
    known = read_state(spark, path).select("file", "modified").distinct()
    new = [r.file for r in _files(spark, table).join(known, ["file", "modified"], "left_anti").collect()]
    if not new:
        return 0
    listed = _files(spark, table).where(F.col("file").isin(new))
    rows = spark.read.option("basePath", table).parquet(*new)
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    counted = sv.with_part_count(rows.select(
        address.alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"),
        F.col(completion_col).alias("completion"), (tokens if tokens is not None else F.lit(None)).cast("bigint").alias("_tokens"),
        (F.col(label_col) if label_col else F.lit(None)).cast("string").alias("label")))
    state = counted.groupBy(F.col("_file").alias("file"), F.col("_modified").alias("modified"), "part_count", "parsed", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("_tokens").alias("min_tokens"), F.max("_tokens").alias("max_tokens"))
    # files without rows are known too
    empty = listed.join(state.select("file").distinct(), "file", "left_anti").select(
        "file", "modified", F.lit(None).cast("bigint").alias("part_count"), F.lit(False).alias("parsed"), F.lit(None).cast("string").alias("label"),
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("min_tokens"), F.lit(None).cast("bigint").alias("max_tokens"))
    run = uuid.uuid4().hex
    whole = state.unionByName(empty).withColumn("run", F.lit(run))
    hidden, shown = f"{path}/_{run}", f"{path}/run={run}"
    whole.write.parquet(hidden)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(fs_path(hidden), fs_path(shown)):
        raise OSError(f"cannot make {shown} visible")
    return len(new)


def current(spark: SparkSession, table: str, path: str) -> DataFrame:
    """State rows of the files that are there as they were surveyed; of a file surveyed twice, one run's."""
    state = read_state(spark, path).join(_files(spark, table), ["file", "modified"], "left_semi")
    one = state.groupBy("file", "modified").agg(F.min("run").alias("run"))
    return state.join(one, ["file", "modified", "run"], "left_semi")


def survey(state: DataFrame, expected_parts: int | None = None) -> DataFrame:
    """The row of ``operators.survey.survey`` over all surveyed files."""
    n, pc, exp = F.col("n"), F.col("part_count"), F.lit(expected_parts).cast("bigint")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    valid = (pc > 0) & (n > 0)
    row = state.agg(total(F.lit(True)).alias("total"), total(valid).alias("valid"),
                    F.coalesce(F.max(F.when(valid, pc)), F.lit(0)).cast("bigint").alias("max_parts"),
                    F.count_distinct(F.when(valid, pc)).cast("bigint").alias("n_distinct"),
                    total(valid & (pc == exp)).alias("consistent_rows"))
    return row.withColumn("is_consistent", F.lit(expected_parts is not None) & (F.col("consistent_rows") == F.col("valid"))
                          & (F.col("n_distinct") == 1) & (F.col("consistent_rows") > 0))


def histogram(state: DataFrame, include_zero: bool = False) -> DataFrame:
    """The rows of ``operators.survey.histogram`` over all surveyed files."""
    counts = (state.where("parsed") if include_zero else state.where("part_count > 0")).groupBy("part_count").agg(
        F.sum("n").cast("bigint").alias("n"))
    return sv.with_share(counts)


def token_minmax(state: DataFrame) -> DataFrame:
    """Least and greatest token count per label over all surveyed files."""
    return state.where("n > 0").groupBy("label").agg(F.min("min_tokens").alias("min_tokens"), F.max("max_tokens").alias("max_tokens"))
