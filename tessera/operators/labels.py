"""Which characters and tokens of a rendered conversation carry loss."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import template as tp
from tessera.functions.tokens import APPROX_TOKEN_PATTERN

OFFSETS = "array<struct<begin: int, end: int>>"


def make_token_offsets(offsets_fn: Callable[[str], Iterable[tuple[int, int]]]):
    """Wrap a user callable (e.g. ``lambda s: tok.encode(s).offsets``) as an Arrow UDF that gives the
    characters of each token; null text gives null."""

    @F.arrow_udf(OFFSETS)
    def _offsets(texts: pa.Array) -> pa.Array:
        return offset_arrays(texts, offsets_fn)

    return _offsets


def offset_arrays(texts: pa.Array, offsets_fn: Callable[[str], Iterable[tuple[int, int]]]) -> pa.Array:
    """The offsets of a batch in flat arrays, eight bytes a token; the Python objects are those of one
    text at a time."""
    begins, ends, starts = array("i"), array("i"), array("i", [0])
    for text in texts:
        if text.is_valid:
            for begin, end in offsets_fn(text.as_py()):
                begins.append(begin)
                ends.append(end)
        starts.append(len(begins))
    flat = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
    tokens = pa.StructArray.from_arrays([flat(begins), flat(ends)], ["begin", "end"])
    return pa.ListArray.from_arrays(flat(starts), tokens, mask=texts.is_null() if texts.null_count else None)


def approx_offsets(text: str) -> list[tuple[int, int]]:
    """Offsets of the tokens that ``approx_token_count`` counts."""
    import regex
    # the pattern spells code points the JVM's way
    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", APPROX_TOKEN_PATTERN)
    return [m.span() for m in regex.finditer(pattern, text)]


def with_label_spans(df: DataFrame, template: tp.Template, messages_col: str = "messages", offsets=None, **variables) -> DataFrame:
    """Add ``text`` (the rendered messages) and ``spans``: ``array<struct<begin, end, first_token,
    n_tokens>>``, the stretches that training learns from (``{% generation %}`` in the template) in
    characters and in tokens.  A token belongs to every span it shares a character with.  No span: an
    empty array; null messages: nulls."""
    step = df.withColumn("_segments", template.segments(F.col(messages_col), **variables))
    step = step.withColumn("text", tp.joined("_segments")).withColumn("_learnt", tp.learnt_spans("_segments")).drop("_segments")
    step = step.withColumn("_tokens", (offsets or make_token_offsets(approx_offsets))(F.col("text")))

    def tokens(s) -> tuple[Column, Column]:
        before = F.size(F.filter("_tokens", lambda t: t["end"] <= s["begin"]))
        return before, F.size(F.filter("_tokens", lambda t: (t["end"] > s["begin"]) & (t["begin"] < s["end"])))

    spans = F.transform("_learnt", lambda s: F.struct(
        s["begin"].alias("begin"), s["end"].alias("end"), tokens(s)[0].alias("first_token"), tokens(s)[1].alias("n_tokens")))
    return step.withColumn("spans", spans).drop("_learnt", "_tokens")


def span_rows(labelled: DataFrame, keep=()) -> DataFrame:
    """One row per span: ``keep, span`` (from 0), ``begin, end, first_token, n_tokens, learnt`` (its text)."""
    rows = labelled.select(*keep, "text", F.posexplode("spans").alias("span", "s"))
    return rows.select(*keep, "span", "s.begin", "s.end", "s.first_token", "s.n_tokens",
                       F.expr("substring(text, s.begin + 1, s.end - s.begin)").alias("learnt"))
