"""Positions kept beside a table (W1): appended rows get new ones, nothing else is moved."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tessera.session import scratch_dir
from tessera.sources import positions


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_positions_of_appended_files_follow(spark):
    table, path = scratch_dir(spark, "my table"), scratch_dir(spark, "positions")
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), F.lit("x").alias("ord_text"),
                                    F.when(F.col("id") % 5 > 0, F.repeat(F.lit("t"), 9)).alias("text"))
    rows.where("k % 2 = 0").repartition(3).write.parquet(table)
    assert positions.append(spark, table, path, "k") == rows.where("k % 2 = 0").count()
    first = {r.k: r.ord for r in positions.read(spark, table, path).collect()}
    assert [k for k, _ in sorted(first.items(), key=lambda x: x[1])] == sorted(first)
    rows.where("k % 2 = 1").repartition(2).write.mode("append").parquet(table)
    assert positions.read(spark, table, path).count() == len(first)          # not numbered yet
    assert positions.append(spark, table, path, "k") == 1000 - len(first)
    assert positions.append(spark, table, path, "k") == 0
    after = positions.read(spark, table, path)
    assert after.columns == ["k", "ord_text", "text", "ord"]
    both = {r.k: r.ord for r in after.collect()}
    assert sorted(both.values()) == list(range(1000)) and all(both[k] == o for k, o in first.items())
    late = sorted(set(both) - set(first), key=both.get)
    assert late == sorted(late)
    assert "Exchange" not in plan(after).replace("BroadcastExchange", "")


def test_ties_nulls_chunks_and_files_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(positions, "CHUNK_BITS", 4)
    monkeypatch.setattr(positions, "CHUNK", 16)
    monkeypatch.setattr(positions, "_ROWS_PER_FOLDER", 100)
    table, path = scratch_dir(spark, "table"), scratch_dir(spark, "positions")
    (spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), F.col("id").alias("v"))
     .repartition(3).write.option("parquet.block.size", 1 << 10).parquet(table))
    assert positions.append(spark, table, path, ["k"]) == 500
    got = sorted((r.ord, -1 if r.k is None else r.k) for r in positions.read(spark, table, path).collect())
    assert [o for o, _ in got] == list(range(500))
    assert [k for _, k in got] == sorted(k for _, k in got)
    only = positions.read(spark, table, path, columns=["v"])
    assert only.columns == ["v", "ord"] and only.select("v").distinct().count() == 500


def test_empty_table_and_changed_files(spark):
    table, path = scratch_dir(spark, "table"), scratch_dir(spark, "positions")
    spark.range(0).write.parquet(table)
    positions.append(spark, table, path, "id")
    assert positions.read(spark, table, path).count() == 0
    spark.range(5).write.mode("append").parquet(table)
    assert positions.append(spark, table, path, "id") == 5
    assert {r.id: r.ord for r in positions.read(spark, table, path).collect()} == {i: i for i in range(5)}
    spark.range(5).write.mode("overwrite").parquet(table)
    with pytest.raises(ValueError, match="gone"):
        positions.append(spark, table, path, "id")
