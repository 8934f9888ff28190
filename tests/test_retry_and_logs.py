"""Retry joins, summaries, names and logs."""

import json
import os
import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import retry
from tessera.session import scratch_dir
from tessera.sources import logs, splits


def test_found_and_missing(spark):
    data = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "id string, v int")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "id string")
    found = retry.failed_rows(data, ids)
    assert sorted(r.v for r in found.collect()) == [1, 2, 3]
    assert [r.id for r in retry.missing_ids(ids, data).collect()] == ["z"]


def test_summary_reference_ratio(spark):
    ids = spark.createDataFrame([(s,) for s in "abcd"], "id string")
    found = ids
    retried = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)],
                                    "id string, is_failed boolean")
    s = retry.retry_summary(ids, found, retried).first()
    assert (s.requested, s.found, s.not_found, s.succeeded, s.failed) == (4, 4, 0, 3, 1)
    assert s.success_rate_ref == 75.0


def test_merge_retry(spark):
    first = spark.createDataFrame([("a", 0, True), ("b", 2, False), ("c", 1, True)],
                                  "id string, generated long, is_failed boolean")
    again = spark.createDataFrame([("a", 2, False), ("c", 0, True)],
                                  "id string, generated long, is_failed boolean")
    m = {r.id: (r.source, r.generated, r.is_failed) for r in retry.merge_retry(first, again).collect()}
    assert m == {"a": ("retry", 2, False), "b": ("first", 2, False), "c": ("first", 1, True)}


def test_retry_split_names(spark):
    df = spark.createDataFrame([("x/failed_ids_d_s_0_t.json", "s", 7, dt.datetime(2026, 1, 2, 3, 4, 5)),
                                ("x/mine.json", "s", 7, dt.datetime(2026, 1, 2, 3, 4, 5))],
                               "p string, split string, n int, ts timestamp")
    got = [r[0] for r in df.select(names.retry_split_name(F.col("p"), F.col("split"), F.col("n"),
                                                          F.col("ts"))).collect()]
    assert got == ["retry_d_s_0_t_7samples", "retry_mine_s_7samples_20260102_030405"]
    assert names.parts_split_name("en_part_1", 0, 10, True, 1) == "en_part_1_0_10_1parts"
    assert names.parts_split_name("en_part_1", 0, 10, False, 1) == "en_part_1_0_10"


def test_failed_log_roundtrip_and_reference_format(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    folder, n = logs.write_failed_log(ids, scratch_dir(spark, "t"), "user/ds", "sp", 5, ts="20260101_000000")
    assert n == 2 and folder.endswith("failed_ids_user_ds_sp_5_20260101_000000")
    back, summary = logs.read_failed_log(spark, folder)
    assert [(r.id, r.list_pos) for r in back.orderBy("list_pos").collect()] == [("a", 0), ("b", 1)] and summary["failed_count"] == 2
    folder, n = logs.write_failed_log(ids.limit(0), scratch_dir(spark, "t"), "user/ds", "sp", 5)
    assert n == 0 and logs.read_failed_log(spark, folder, missing_ok=True)[0].count() == 0
    ref = tmp_path / "failed_ids_x.json"
    ref.write_text(json.dumps({"dataset": "d", "split": "s", "start_index": 0, "failed_count": 3,
                               "failed_sample_ids": ["q", "r", "q"], "timestamp": "t"}, indent=2))
    back, summary = logs.read_failed_log(spark, str(ref))
    assert [r.id for r in back.orderBy("list_pos").collect()] == ["q", "r", "q"]
    assert summary["split"] == "s"
    try:
        logs.read_failed_log(spark, str(tmp_path / "missing.json"))
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_write_and_read_splits(spark):
    path = scratch_dir(spark, "splits")
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "v int, split string")
    splits.write_splits(df, path)
    splits.write_splits(df.where("split = 's1'").limit(2), path)   # replaces only s1
    sizes = {r.split: r.n_rows for r in splits.split_sizes(splits.read_split(spark, path)).collect()}
    assert sizes == {"s0": 10, "s1": 2, "s2": 10}
    assert splits.read_split(spark, path, "s2").count() == 10


def test_splits_are_few_files_and_large_ones_divided(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).selectExpr("id", "concat('s', id % 20) AS split")
    splits.write_splits(df, str(tmp_path / "small"))
    files = list((tmp_path / "small").glob("split=*/part-*.parquet"))
    assert 20 <= len(files) <= 25
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        big = spark.range(0, 40000, 1, 16).selectExpr("id", "if(id % 10 = 0, 'b', 'a') AS split", "sha2(cast(id as string), 256) AS x")
        splits.write_splits(big, str(tmp_path / "big"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "big").glob("split=a/part-*.parquet"))) > 1
