"""Failed-id, retry and invalid-position logs.

The reference keeps a log as one JSON object holding the whole id array.  That
funnels every failed id through one writer, so here a log is a folder:
``summary/`` (one JSON line, counts and names only) and ``ids/`` (a parquet
table written by all tasks).  ``read_failed_log`` also reads the reference's
single-file form: files longer than one range of ``split_json`` in byte ranges, shorter ones by Spark's JSON reader.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import log_file_stem
from tessera.operators.position import with_ord
from tessera.session import delete_path
from tessera.sources import split_json

# Field names and name prefixes of the logs (here and below), so existing logs can be read.
REF_LOG_SCHEMA = ("dataset string, split string, start_index bigint, failed_count bigint, "
                  "failed_sample_ids array<string>, timestamp string")
SUMMARY_FIELDS = ("dataset", "split", "start_index", "failed_count", "timestamp")


def timestamp_now() -> str:
    return _dt.datetime.now().strftime("%Y%m%d_%H%M%S")


def failed_log_name(dataset: str, split: str, start_index: int, ts: str) -> str:
    """``failed_ids_{dataset with / as _}_{split}_{start}_{timestamp}``."""
    return f"failed_ids_{log_file_stem(dataset)}_{split}_{start_index}_{ts}"


def write_id_log(ids: DataFrame, folder: str, summary: dict, count_field: str,
                 id_col: str = "id") -> int:
    """Write ``ids/`` (``id, list_pos`` in order of the id) then a one-line ``summary/`` with the id
    count.  Nothing is left when there are no ids (the reference writes no file then)."""
    spark = ids.sparkSession
    ids = with_ord(ids.select(F.col(id_col).cast("string").alias("id")), "id", "list_pos")
    ids.write.mode("overwrite").parquet(f"{folder}/ids")
    n = spark.read.parquet(f"{folder}/ids").count()
    if n == 0:
        delete_path(spark, folder)
        return 0
    row = dict(summary, **{count_field: n})
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    return n


def write_failed_log(ids: DataFrame, base: str, dataset: str, split: str,
                     start_index: int, id_col: str = "id", ts: str | None = None) -> tuple[str, int]:
    """Failed ids of a multi-turn run (S5, A14).  Returns ``(folder, count)``."""
    ts = ts or timestamp_now()
    folder = f"{base}/{failed_log_name(dataset, split, start_index, ts)}"
    n = write_id_log(ids, folder, {"dataset": dataset, "split": split,
                                   "start_index": int(start_index), "timestamp": ts},
                     "failed_count", id_col)
    return folder, n


def write_retry_log(ids: DataFrame, base: str, original_log: str, retry_dataset: str,
                    retry_split: str, id_col: str = "id", ts: str | None = None) -> tuple[str, int]:
    """Ids that failed again, under ``{base}/retry/``."""
    ts = ts or timestamp_now()
    stem = original_log.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    folder = f"{base}/retry/retry_failed_{stem}_{ts}"
    n = write_id_log(ids, folder, {"original_failed_json": original_log,
                                   "retry_dataset": retry_dataset, "retry_split": retry_split,
                                   "retry_timestamp": ts,
                                   "note": "ids that failed again in the retry"},
                     "retry_failed_count", id_col)
    return folder, n


def write_invalid_positions(positions: DataFrame, folder: str, ord_col: str = "ord") -> None:
    """Rejected positions of a reasoning run (S7), sorted by the writer."""
    (positions.select(F.col(ord_col).cast("bigint").alias("invalid_index"))
     .orderBy("invalid_index").write.mode("overwrite").parquet(folder))


def read_retry_log(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Ids and summary of a log written by ``write_retry_log``."""
    return read_failed_log(spark, path)


def read_failed_log(spark: SparkSession, path: str, missing_ok: bool = False) -> tuple[DataFrame, dict]:
    """Failed ids (S2) as ``(ids DataFrame[id string, list_pos bigint], summary)``.

    ``path`` is a folder written by ``write_failed_log`` or a single JSON file
    in the reference's layout.  A missing path raises ``FileNotFoundError``, or with ``missing_ok``
    gives no ids and an empty summary (a run without failures writes no log)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        if missing_ok:
            return spark.createDataFrame([], "id string, list_pos bigint"), {}
        raise FileNotFoundError(path)
    if fs.getFileStatus(jvm_path).isDirectory():
        summary = spark.read.json(f"{path}/summary").first().asDict()
        return spark.read.parquet(f"{path}/ids"), summary
    if fs.getFileStatus(jvm_path).getLen() > split_json.RANGE_BYTES:
        ids, rest = split_json.read_id_array(spark, path, range_bytes=split_json.RANGE_BYTES)
        return ids, {name: rest.get(name) for name in SUMMARY_FIELDS}
    raw = spark.read.schema(REF_LOG_SCHEMA).option("multiLine", True).json(path)
    summary = raw.drop("failed_sample_ids").first().asDict()
    ids = raw.select(F.posexplode("failed_sample_ids").alias("list_pos", "id"))
    return ids.select("id", F.col("list_pos").cast("bigint")), summary
