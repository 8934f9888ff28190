"""Positions, slices, batches, worker slices, interleave."""

from pyspark.sql import functions as F

from tessera.operators import position


def test_with_ord_dense_and_partition_independent(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"))
    expect = sorted(r.k for r in df.collect())
    for parts in (1, 8):
        got = position.with_ord(df.repartition(parts), "k", num_partitions=parts).collect()
        by_ord = sorted((r.ord, r.k) for r in got)
        assert [o for o, _ in by_ord] == list(range(5000))
        assert [k for _, k in by_ord] == expect


def test_slice_batches_and_names(spark):
    df = position.with_ord(spark.range(10).withColumnRenamed("id", "k"), "k")
    assert position.slice_range(df, 5, 20).count() == 5
    assert position.slice_range(df, 12, 20).count() == 0
    assert position.clamped_end(df, 20) == 10
    b = position.with_batches(df, 4).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [4, 4, 2]
    pos = [r.pos for r in position.with_batches(df, 4).orderBy("ord").collect()]
    assert pos == [1, 2, 3, 4, 1, 2, 3, 4, 1, 2]


def test_worker_slices_keep_remainder(spark):
    df = position.with_ord(spark.range(10).withColumnRenamed("id", "k"), "k")
    rows, plan = position.worker_slices(df, workers=4, per_worker=100, start=0)
    assert plan == {"planned": 10, "per_worker": 2, "reference_covered": 8}
    sizes = {r.slice_id: r["count"] for r in rows.groupBy("slice_id").count().collect()}
    assert sizes == {0: 2, 1: 2, 2: 2, 3: 4}


def test_deinterleave_and_interleave(spark):
    a = position.with_ord(spark.createDataFrame([(i, "a") for i in range(5)], "k int, s string"), "k")
    b = position.with_ord(spark.createDataFrame([(i, "b") for i in range(3)], "k int, s string"), "k")
    mixed = position.interleave([a, b]).orderBy("ord").collect()
    assert [(r.s, r.k) for r in mixed] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2)]
    lab = position.deinterleave(position.interleave([a, b]))
    assert {r.s: r.lang for r in lab.collect()} == {"a": "en", "b": "vi"}


def test_with_ord_checkpoint_mode_matches_table_mode(spark):
    df = spark.range(0, 500).select((F.col("id") * 37 % 1009).alias("k"))
    a = sorted(map(tuple, position.with_ord(df, "k", materialize="table").collect()))
    b = sorted(map(tuple, position.with_ord(df, "k", materialize="checkpoint").collect()))
    assert a == b


def test_existing_positions_are_kept(spark):
    df = spark.createDataFrame([(7, 3), (9, 1)], "ord long, k int")
    assert sorted(map(tuple, position.with_ord(df, "k").collect())) == [(7, 3), (9, 1)]


def test_partitions_follow_the_input(spark, monkeypatch):
    df = spark.range(1000)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert position.input_partitions(df) == width
    monkeypatch.setattr(position, "PARTITION_BYTES", 100)
    assert position.input_partitions(df) == 80


def test_scratch_tables_are_dropped(spark):
    from tessera import session
    with session.scratch_space(spark):
        out = position.with_ord(spark.range(50).withColumnRenamed("id", "k"), "k")
        assert out.count() == 50
        made = session._SPACES[-1][:]
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(made[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert made and not any(fs.exists(jvm(p)) for p in made)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from tessera import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_ranged_rows_are_numbered_where_they_lie(spark):
    """Rows that lie in key ranges already get the same positions without a second exchange."""
    df = spark.range(1000).selectExpr("(id * 37) % 500 AS k")
    df = df.repartitionByRange(5, "k").groupBy("k").count()
    got = position.with_ord(df, "k", ranged=True).collect()
    assert sorted((r.ord, r.k) for r in got) == [(i, i) for i in range(500)]
