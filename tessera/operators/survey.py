"""Dataset surveys: part-count distribution, consistency gate, length audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.jsonx import json_block, part_count as doc_part_count
from tessera.functions.tokens import approx_token_count


class SurveyGateError(RuntimeError):
    """Raised by ``gate`` when a run must stop (no valid row, or inconsistent)."""


def with_part_count(df: DataFrame, completion_col: str = "completion",
                    out: str = "part_count") -> DataFrame:
    """Add the part count and ``parsed``: the document is one non-empty JSON object."""
    return (df.withColumn("_doc", json_block(F.col(completion_col)))
              .withColumn(out, doc_part_count(F.col("_doc")))
              .withColumn("parsed", F.coalesce(F.size(F.json_object_keys("_doc")) > 0, F.lit(False))).drop("_doc"))


def survey(df: DataFrame, expected_parts: int | None = None,
           part_col: str = "part_count") -> DataFrame:
    """One-row survey (A1, A3): ``total, valid, max_parts, n_distinct,
    consistent_rows, is_consistent``.  A row is valid when its document parsed,
    is non-empty and has at least one part.  One partial+final aggregation."""
    pc = F.col(part_col)
    valid = pc > 0
    exp = F.lit(expected_parts).cast("bigint")
    agg = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(valid).cast("bigint").alias("valid"),
        F.coalesce(F.max(F.when(valid, pc)), F.lit(0)).cast("bigint").alias("max_parts"),
        F.count_distinct(F.when(valid, pc)).cast("bigint").alias("n_distinct"),
        F.count_if(valid & (pc == exp)).cast("bigint").alias("consistent_rows"),
    )
    consistent = (F.lit(expected_parts is not None)
                  & (F.col("consistent_rows") == F.col("valid"))
                  & (F.col("n_distinct") == 1) & (F.col("consistent_rows") > 0))
    return agg.withColumn("is_consistent", consistent)


def histogram(df: DataFrame, part_col: str = "part_count",
              include_zero: bool = False) -> DataFrame:
    """Part-count histogram (A2/A4): ``part_count, n, pct`` ordered by count.
    With ``include_zero`` parsed documents without parts count too (``parsed``
    of ``with_part_count``); rows without a document never do.
    ``pct`` is the share of counted rows, rounded half-up to one decimal with
    integer arithmetic.  The histogram has one row per distinct count, so the
    ``sum over ()`` window runs on a handful of rows."""
    rows = df.where("parsed") if include_zero else df.where(F.col(part_col) > 0)
    return with_share(rows.groupBy(part_col).agg(F.count(F.lit(1)).cast("bigint").alias("n")), part_col)


def with_share(counts: DataFrame, part_col: str = "part_count") -> DataFrame:
    """Counts ``n`` per part count, with their share ``pct``, in order."""
    tot = F.sum("n").over(Window.partitionBy())
    return (counts.withColumn("_tot", tot)
            .withColumn("pct", F.expr("CAST((2000 * n + _tot) div (2 * _tot) AS DOUBLE) / 10"))
            .drop("_tot").orderBy(part_col))


def gate(survey_df: DataFrame, expected_parts: int | None = None,
         on_mismatch: str = "stop") -> dict:
    """Driver-side check of the one-row survey (F9): raise when no row is valid,
    or when ``expected_parts`` is given and the data is not consistent and
    ``on_mismatch == "stop"``.  Returns the survey as a dict."""
    row = survey_df.first().asDict()
    if not row["max_parts"]:
        raise SurveyGateError("no valid rows")
    if expected_parts is not None and not row["is_consistent"] and on_mismatch == "stop":
        raise SurveyGateError(f"not every valid row has {expected_parts} parts")
    return row


def lang_counts(df: DataFrame, kept_col: str, lang_col: str = "lang") -> DataFrame:
    """Rows, kept and removed per language (A10)."""
    return df.groupBy(lang_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count_if(F.col(kept_col)).cast("bigint").alias("n_kept"),
        F.count_if(~F.col(kept_col)).cast("bigint").alias("n_removed"))


def token_minmax(df: DataFrame, tokens_col: str = "n_tokens", by: str = "lang") -> DataFrame:
    """Min and max token length per group (A6); an empty group has no row."""
    return df.groupBy(by).agg(F.min(tokens_col).cast("bigint").alias("min_tokens"),
                              F.max(tokens_col).cast("bigint").alias("max_tokens"))


def length_audit(df: DataFrame, limit: int, prompt_col: str = "prompt",
                 completion_col: str = "completion", counter=approx_token_count) -> DataFrame:
    """Per-row prompt / completion spans and over-limit flag."""
    return (df.withColumn("n_prompt", counter(F.col(prompt_col)))
              .withColumn("n_completion", counter(F.col(completion_col)))
              .withColumn("n_total", F.col("n_prompt") + F.col("n_completion"))
              .withColumn("over_limit", F.col("n_total") > F.lit(limit)))


def length_audit_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count_if(F.col("over_limit")).cast("bigint").alias("n_over_limit"),
        F.max("n_total").cast("bigint").alias("max_tokens"),
        F.sum("n_prompt").cast("bigint").alias("sum_prompt_tokens"),
        F.sum("n_completion").cast("bigint").alias("sum_completion_tokens"))
