"""Parse model responses: un-batch, numbered turns, verdicts, wide/long shapes,
accept/reject of single answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonx import completion_part_count
from tessera.functions.text import (first_blocks, first_tag_or_null, is_blank, not_blank, strip,
                                    strip_long, stretch_tokens, tag_from_tokens, tag_stretches, with_tag)

TURN_FIELDS = (("input", "prompt"), ("think", "think"), ("json", "json"))


def unbatch(requests: DataFrame, responses: DataFrame, batch_size: int,
            response_col: str = "response") -> DataFrame:
    """Give every request row its ``<sample_pos>`` block.

    Each response is tokenised once (sample tags and the text around them),
    all ``batch_size`` samples are cut from those tokens, and the response side
    is exploded to ``(batch_id, pos)`` *before* the shuffle, so only sample
    contents travel; a left join
    keeps every request row (``content`` null when the batch failed or the
    sample is missing; ``new_length`` is then 0).  The outer explode matters: for an inner one Spark
    infers a filter on the array and copies the tokenising into it, once per sample.  The join is a merge:
    the size that Spark expects of texts made in the plan is that of the stored columns behind them, far too
    small for a choice to broadcast."""
    samples = (_sample_blocks(responses, batch_size, response_col)
               .select("batch_id", F.posexplode_outer("_blocks").alias("_i", "content"))
               .select("batch_id", (F.col("_i") + 1).cast("int").alias("pos"), "content")
               .where(F.col("content").isNotNull()))
    out = requests.join(samples.hint("merge"), ["batch_id", "pos"], "left")
    return out.withColumn("new_length", F.coalesce(F.length("content"), F.lit(0)).cast("bigint"))


def _sample_blocks(responses: DataFrame, batch_size: int, response_col: str) -> DataFrame:
    """``batch_id, _blocks``: the samples of every response in order, tokenised once.  No Python here: its
    step would lose the buckets that ``unbatch_colocated`` joins by."""
    tags, pieces = stretch_tokens("_s")
    blocks = F.transform(F.sequence(F.lit(1), F.lit(batch_size)), lambda i: strip_long(
        tag_from_tokens("_t", "_p", F.concat(F.lit("sample_"), i.cast("string")))))
    return (responses.select("batch_id", tag_stretches(F.col(response_col), ["sample"]).alias("_s"))
            .select("batch_id", tags.alias("_t"), pieces.alias("_p")).select("batch_id", blocks.alias("_blocks")))


def unbatch_colocated(requests: DataFrame, responses: DataFrame, batch_size: int,
                      response_col: str = "response") -> DataFrame:
    """``unbatch`` for tables stored by ``batch_id`` (``sources.batches``): a response meets its requests
    where they lie and every request takes the block of its own place, so nothing is shuffled.  On
    other tables it is right too, but whole responses travel.  ``batch_id`` is unique in ``responses``."""
    samples = _sample_blocks(responses, batch_size, response_col)
    out = requests.join(samples, "batch_id", "left").withColumn("content", F.get("_blocks", F.col("pos") - 1)).drop("_blocks")
    return out.withColumn("new_length", F.coalesce(F.length("content"), F.lit(0)).cast("bigint"))


def with_turns(df: DataFrame, max_parts: int | None = None, content_col: str = "content",
               out: str = "turns") -> DataFrame:
    """Add ``array<struct<turn, input, think, json>>`` of the turns that exist in the row's own tags,
    in order (X8, P16); an absent field of an existing turn is ``""``.

    The content is searched once; a row's work depends on its own tags only.
    Turns after ``max_parts`` are ignored, as the answers of parts the dataset does not have."""
    last = 2**31 - 1 if max_parts is None else max_parts
    names = [tag for _, tag in TURN_FIELDS]

    @F.arrow_udf("array<struct<turn: int, " + ", ".join(f"{name}: string" for name, _ in TURN_FIELDS) + ">>")
    def turns(contents: pa.Array) -> pa.Array:
        row, field, number, content = first_blocks(contents, names, last)
        turn, at = np.unique(row << 31 | number, return_inverse=True)
        columns = []
        for i in range(len(names)):
            where = np.full(len(turn), -1)
            where[at[field == i]] = np.flatnonzero(field == i)
            columns.append(pc.fill_null(content.take(pa.array(where, mask=where < 0)), ""))
        ends = np.searchsorted(turn >> 31, np.arange(len(contents) + 1))
        flat = pa.StructArray.from_arrays([pa.array(turn & (2**31 - 1), pa.int32()), *columns], ["turn", *[n for n, _ in TURN_FIELDS]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return df.withColumn(out, turns(with_tag(content_col, names)))


def _complete(t) -> Column:
    return not_blank(t["input"]) & not_blank(t["think"]) & not_blank(t["json"])


def verdict(parsed: DataFrame, max_parts: int | None = None, content_col: str = "content",
            completion_col: str = "completion") -> DataFrame:
    """Per-row verdict (C2, A13): ``turns`` array, ``generated`` (complete turns),
    ``original_parts`` and ``is_failed``; the row is kept either way.  A
    ``part_count`` column is used if there is one.  Store the result once (as the jobs do) before
    filtering on it: pushdown would copy the turn expressions into the filter."""
    parts = F.col("part_count") if "part_count" in parsed.columns else completion_part_count(F.col(completion_col))
    filled = lambda t: (t["input"] != "") & (t["think"] != "") & (t["json"] != "")  # noqa: E731 - ``_complete``: the turns are stripped
    return (with_turns(parsed, max_parts, content_col)
            .withColumn("generated", F.size(F.filter("turns", filled)).cast("bigint"))
            .withColumn("original_parts", parts)
            .withColumn("is_failed", (F.col("generated") == 0) | (F.col("generated") != F.col("original_parts"))))


def turns_long(judged: DataFrame, keep=("id",)) -> DataFrame:
    """One row per ``(id, turn)`` with ``input, think, json, complete`` (F5).  Exploded with rows that have
    no turn, which then go: an inner explode would copy the turn expressions into a filter below it."""
    t = F.explode_outer("turns").alias("t")
    return judged.select(*keep, t).where(F.col("t").isNotNull()).select(
        *keep, F.col("t.turn").cast("int").alias("turn"), "t.input", "t.think", "t.json",
        _complete(F.col("t")).alias("complete"))


def widen(judged: DataFrame, max_parts: int, keep=("id",),
          original_col: str = "completion") -> DataFrame:
    """``max_parts``: the width that the survey measured.  Wide rows ``id, original_completion, new_length, input_i, think_i, json_i``
    for i in 1..max_parts with ``""`` defaults (P14, P15) — a projection of the
    row's own turn array, no pivot and no shuffle."""
    cols = [*keep, F.coalesce(F.col(original_col), F.lit("")).alias("original_completion"),
            F.coalesce(F.col("new_length"), F.lit(0)).cast("bigint").alias("new_length")]
    by_turn = judged.withColumn("_turns", F.map_from_entries(F.transform(
        "turns", lambda t: F.struct(t["turn"], t))))
    for i in range(1, max_parts + 1):
        for out, _ in TURN_FIELDS:
            cols.append(F.coalesce(F.try_element_at("_turns", F.lit(i))[out], F.lit("")).alias(f"{out}_{i}"))
    return by_turn.select(*cols)


def unwiden(wide: DataFrame, max_parts: int, keep=("id",)) -> DataFrame:
    """Wide rows → long turns (R10); blank turns are dropped and each turn
    becomes a training pair: prompt = input, completion = think ⏎⏎ json."""
    arr = F.array(*[F.struct(F.lit(i).alias("turn"), F.col(f"input_{i}").alias("input"),
                             F.col(f"think_{i}").alias("think"), F.col(f"json_{i}").alias("json"))
                    for i in range(1, max_parts + 1)])
    t = wide.select(*keep, F.explode(arr).alias("t")).where(_complete(F.col("t")))
    return t.select(*keep, F.col("t.turn").cast("int").alias("turn"),
                    F.col("t.input").alias("prompt"),
                    F.concat(F.lit("<think>\n"), F.col("t.think"), F.lit("\n</think>\n\n<json>\n"),
                             F.col("t.json"), F.lit("\n</json>")).alias("completion"))


def accept_counts(judged: DataFrame) -> DataFrame:
    """Accepted and rejected rows (A12), one row."""
    return judged.agg(F.count_if("accepted").cast("bigint").alias("n_accepted"),
                      F.count_if(~F.col("accepted")).cast("bigint").alias("n_rejected"))


def accept(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Accept/reject one answer (F2, P6): ``<valid>`` stripped must equal ``Yes``
    and the untrimmed description and think blocks must be non-empty
    (whitespace-only passes).  ``accepted`` is never null."""
    r = F.col(response_col)
    valid = first_tag_or_null(r, "valid")
    desc = first_tag_or_null(r, "description")
    think = first_tag_or_null(r, "think")
    ok = ((strip(valid) == "Yes") & (F.length(desc) > 0) & (F.length(think) > 0))
    return (df.withColumn("accepted", F.coalesce(ok, F.lit(False)))
              .withColumn("description", F.when(F.col("accepted"), F.concat(
                  F.lit("<description>"), desc, F.lit("</description>"))))
              .withColumn("reasoning", F.when(F.col("accepted"), F.concat(
                  F.lit("<think>"), think, F.lit("</think>")))))


__all__ = ["unbatch", "unbatch_colocated", "with_turns", "verdict", "turns_long", "widen", "unwiden", "accept", "is_blank"]
