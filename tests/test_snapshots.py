"""Published versions (S3, S4): whole versions only, conflicts, pinned readers."""

import pytest
from pyspark.sql import functions as F

from tessera.session import scratch_dir
from tessera.sources import snapshots


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, split string")


def rows(df):
    return sorted(((r.id, r.split) for r in df.collect()), key=repr)


def test_versions_and_pinned_readers(spark):
    path = scratch_dir(spark, "dataset")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    odd = "a/b=%c d[1]"
    assert snapshots.publish(frame(spark, [(1, "en"), (2, odd), (3, None), (4, "2020")]), path) == 1
    pinned = snapshots.read(spark, path)
    assert rows(pinned) == sorted([(1, "en"), (2, odd), (3, None), (4, "2020")], key=repr)
    assert snapshots.publish(frame(spark, [(5, "en"), (6, "vi")]), path) == 2
    assert rows(pinned) == rows(snapshots.read(spark, path, version=1))
    assert rows(snapshots.read(spark, path)) == sorted([(5, "en"), (6, "vi"), (2, odd), (3, None), (4, "2020")], key=repr)
    assert rows(snapshots.read(spark, path, "en", 1)) == [(1, "en")]
    assert rows(snapshots.read(spark, path, odd)) == [(2, odd)] and rows(snapshots.read(spark, path, "no")) == []
    assert snapshots.changed_splits(spark, path, 1) == ["en", "vi"]
    assert snapshots.publish(frame(spark, []), path) == 3                     # nothing new, still a version
    assert snapshots.publish(frame(spark, [(9, "en")]), path, replace_all=True) == 4
    assert rows(snapshots.read(spark, path)) == [(9, "en")]
    with pytest.raises(ValueError, match="columns differ"):
        snapshots.publish(frame(spark, [(1, "en")]).withColumn("more", F.lit(1)), path)
    assert snapshots.vacuum(spark, path, keep=1)
    assert snapshots.versions(spark, path) == [4] and rows(snapshots.read(spark, path)) == [(9, "en")]


def test_failed_publication_leaves_the_old_version(spark):
    path = scratch_dir(spark, "dataset")
    snapshots.publish(frame(spark, [(i, "en") for i in range(20)]), path)
    broken = spark.range(1000, 1100, numPartitions=4).select("id", F.lit("en").alias("split")).withColumn(
        "id", F.when(F.col("id") == 1090, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(broken, path)
    assert snapshots.versions(spark, path) == [1]
    assert rows(snapshots.read(spark, path)) == sorted([(i, "en") for i in range(20)], key=repr)
    snapshots.vacuum(spark, path)                                             # the dead publication's folder goes
    assert len(snapshots._names(spark, f"{path}/data")) == 1


def test_publishers_that_race(spark, monkeypatch):
    path = scratch_dir(spark, "dataset")
    snapshots.publish(frame(spark, [(1, "en"), (2, "vi")]), path)
    real, other = snapshots._commit, []

    def late(s, p, body):
        if not other:                        # someone else publishes just before the rename
            other.append(True)
            snapshots.publish(frame(s, [(3, "vi")]), p)
        return real(s, p, body)

    monkeypatch.setattr(snapshots, "_commit", late)
    assert snapshots.publish(frame(spark, [(4, "en")]), path) == 3            # other splits: takes the next version
    assert rows(snapshots.read(spark, path)) == [(3, "vi"), (4, "en")]
    other.clear()
    with pytest.raises(snapshots.PublishConflict):
        snapshots.publish(frame(spark, [(5, "vi")]), path)
    with pytest.raises(snapshots.PublishConflict):
        snapshots.publish(frame(spark, [(5, "en")]), path, base=1)            # made from rows that were replaced since
    assert rows(snapshots.read(spark, path)) == [(3, "vi"), (4, "en")]
