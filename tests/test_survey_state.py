"""A survey kept beside a dataset (A1, A2, A6): same rows as a full survey, new files only."""

from pyspark.sql import functions as F

from tessera.operators import survey as full
from tessera.session import scratch_dir
from tessera.sources import survey_state


def docs(spark, lo, hi):
    i = F.col("id")
    body = F.when(i % 9 == 0, F.lit("{}")).when(i % 10 == 0, F.lit("broken")).when(i % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit('<json>{"parts":{"part_1":{}'), F.when(i % 3 == 0, F.lit(',"part_2":{}')).otherwise(F.lit("")), F.lit("}}</json>")))
    return spark.range(lo, hi).select("id", body.alias("completion"), F.when(i % 2 == 0, "en").otherwise("vi").alias("lang"))


def check(spark, table, path):
    state = survey_state.current(spark, table, path)
    rows = full.with_part_count(spark.read.parquet(table))
    assert survey_state.survey(state, 2).first() == full.survey(rows, 2).first()
    assert survey_state.survey(state).first() == full.survey(rows).first()
    for zero in (False, True):
        assert survey_state.histogram(state, zero).collect() == full.histogram(rows, include_zero=zero).collect()
    want = full.token_minmax(rows.withColumn("n_tokens", F.col("id") % 50)).collect()
    assert sorted(map(tuple, survey_state.token_minmax(state).collect())) == sorted(map(tuple, want))


def test_merged_state_is_the_full_survey(spark):
    table, path = scratch_dir(spark, "a table+1%"), scratch_dir(spark, "state")
    run = lambda: survey_state.update(spark, table, path, F.col("id") % 50, "lang")
    docs(spark, 0, 100).repartition(3).write.parquet(table)
    assert run() == 3 and run() == 0
    check(spark, table, path)
    docs(spark, 100, 150).repartition(2).write.mode("append").parquet(table)
    docs(spark, 0, 0).coalesce(1).write.mode("append").parquet(table)
    assert run() == 3 and run() == 0
    check(spark, table, path)
    # the same files surveyed by two updates at once count once
    first = survey_state.read_state(spark, path).collect()
    twice = spark.createDataFrame(first, survey_state._SCHEMA).withColumn("run", F.lit("other"))
    twice.write.parquet(f"{path}/run=other")
    check(spark, table, path)
    docs(spark, 500, 520).coalesce(1).write.mode("overwrite").parquet(table)
    assert run() == 1
    check(spark, table, path)


def test_empty_dataset(spark):
    table, path = scratch_dir(spark, "table"), scratch_dir(spark, "state")
    docs(spark, 0, 0).coalesce(1).write.parquet(table)
    assert survey_state.update(spark, table, path) == 1
    row = survey_state.survey(survey_state.current(spark, table, path)).first()
    assert (row.total, row.valid, row.max_parts, row.is_consistent) == (0, 0, 0, False)
