"""Token counting and length buckets."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import WS_CLASS, _c

# Fixed value: the default pre-tokenizer pattern — a run of letters, a single
# digit, or a run of other non-space symbols counts as one token.
APPROX_TOKEN_PATTERN = r"\p{L}+|\p{N}|[^" + WS_CLASS[1:-1] + r"\p{L}\p{N}]+"


def approx_token_count(col) -> Column:
    """Approximate token count, JVM-side (``regexp_count``): no tokenizer library
    is needed and it stays inside whole-stage codegen."""
    return F.regexp_count(_c(col), F.lit(APPROX_TOKEN_PATTERN)).cast("bigint")


def make_token_counter(count_fn: Callable[[str], int]):
    """Wrap a user callable (e.g. ``lambda s: len(tok.encode(s))``) as an
    Arrow-batched pandas UDF returning ``bigint``; null text gives null."""

    @F.pandas_udf(T.LongType())
    def _count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else int(count_fn(s))).astype("Int64")

    return _count


def bucket_start(n, width: int = 500) -> Column:
    """``(n // width) * width``."""
    n = _c(n).cast("bigint")
    return n - F.pmod(n, F.lit(int(width)))


def bucket_label(n, width: int = 500) -> Column:
    """``range_{start}_{start+width}``."""
    s = bucket_start(n, width)
    return F.format_string("range_%d_%d", s, s + F.lit(width))
