"""Tables stored by batch (J3, W2): same rows as un-batching by a shuffle, without one."""

import contextlib
import io

from pyspark.sql import functions as F

from tessera.operators import requests as rq, responses as rs
from tessera.operators.position import with_batches
from tessera.session import scratch_dir
from tessera.sources import batches


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def tables(spark):
    reqs = with_batches(spark.range(200).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("completion")), 4)
    reqs = reqs.unionByName(spark.createDataFrame([(900, "x", None, 1)], "ord long, completion string, batch_id long, pos int"))
    n = F.col("id")
    block = lambda i: F.concat(F.lit(f"<sample_{i}> b"), n.cast("string"), F.lit(f"p{i} </sample_{i}>"))
    text = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 5 == 0, block(2)).otherwise(F.concat(*[block(i) for i in (1, 2, 3, 4)]))
    return reqs, spark.range(45).select(n.alias("batch_id"), text.alias("response"))


def test_same_rows_without_exchange(spark):
    reqs, answers = tables(spark)
    want = sorted(map(tuple, rs.unbatch(reqs, answers, 4).select("ord", "batch_id", "pos", "content", "new_length").collect()))
    assert len(want) == 201 and sum(r[3] is not None for r in want) > 100
    plain = rs.unbatch_colocated(reqs, answers, 4)                            # also right on tables stored otherwise
    assert sorted(map(tuple, plain.select("ord", "batch_id", "pos", "content", "new_length").collect())) == want
    first = scratch_dir(spark, "requests")
    a = batches.publish(reqs, first, buckets=6)
    b = batches.publish_like(answers, first, scratch_dir(spark, "responses"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)                # large tables are not broadcast
    try:
        out = rs.unbatch_colocated(a, b, 4)
        assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
        assert "Exchange" not in plan(rq.batch_requests(a))
        assert sorted(map(tuple, out.select("ord", "batch_id", "pos", "content", "new_length").collect())) == want
        batches.forget(spark, first)
        again = batches.open_table(spark, first, "ord long, completion string, batch_id long, pos int", 6)
        assert batches.bucket_count(spark, first) == 6
        assert "Exchange" not in plan(rs.unbatch_colocated(again, b, 4)) and again.count() == 201
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
