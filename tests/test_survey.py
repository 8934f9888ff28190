"""Survey, histogram, gate."""

import pytest

from pyspark.sql import functions as F

from tessera.operators import survey


def pc_df(spark, counts):
    return spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, part_count bigint")


def test_survey_consistent(spark):
    s = survey.survey(pc_df(spark, [2, 2, 0, 2]), expected_parts=2).first()
    assert (s.total, s.valid, s.max_parts, s.is_consistent) == (4, 3, 2, True)


def test_survey_inconsistent_histogram(spark):
    df = pc_df(spark, [2, 2, 1])
    s = survey.survey(df, expected_parts=2).first()
    assert (s.max_parts, s.is_consistent) == (2, False)
    h = [(r.part_count, r.n, r.pct) for r in survey.histogram(df).collect()]
    assert h == [(1, 1, 33.3), (2, 2, 66.7)]
    with pytest.raises(survey.SurveyGateError):
        survey.gate(survey.survey(df, 2), 2, "stop")
    assert survey.gate(survey.survey(df, 2), 2, "warn")["max_parts"] == 2


def test_gate_stops_without_valid_rows(spark):
    with pytest.raises(survey.SurveyGateError):
        survey.gate(survey.survey(pc_df(spark, [0, 0])))


def test_histogram_include_zero(spark):
    h = survey.histogram(pc_df(spark, [0, 1, 1, 0, 0]).withColumn("parsed", F.col("i") < 4), include_zero=True).collect()
    assert [(r.part_count, r.n, r.pct) for r in h] == [(0, 2, 50.0), (1, 2, 50.0)]
