"""Canonical JSON: one text per value.

Python's reader decides what a text means (the last of repeated keys counts, NaN and Infinity are
numbers); the canonical text has sorted keys, no blanks, ASCII escapes only, and one spelling per
number: whole numbers without point or exponent (1e2, 100.0 and 100 are one value, -0 is 0), others as
Python spells them.  ``true`` and ``1`` stay different.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.jsonx import is_strict_json
from tessera.functions.text import _c


def _value(x):
    if isinstance(x, float):
        return int(x) if math.isfinite(x) and x == int(x) else x
    if isinstance(x, dict):
        return {k: _value(v) for k, v in x.items()}
    return [_value(v) for v in x] if isinstance(x, list) else x


def canonical_text(text: str | None) -> str | None:
    """The canonical form of one text; None if it is no JSON."""
    if text is None:
        return None
    try:
        return json.dumps(_value(json.loads(text)), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text)


def canonical_json(col) -> Column:
    """Canonical text of a JSON column; null for what is no JSON."""
    return _canonical(_c(col))


def json_digest(col) -> Column:
    """SHA-256 of the canonical text: equal values have equal digests."""
    return F.sha2(canonical_json(col).cast("binary"), 256)


def same_value(a, b) -> Column:
    """Do two texts hold the same JSON value?  Texts that are equal letter by letter are only tested
    for being JSON, in the JVM; of the others Python compares the canonical forms.  Never null."""
    a, b = _c(a), _c(b)
    equal = F.coalesce(a == b, F.lit(False))
    differs = lambda x: F.when(~equal, x)
    return F.coalesce(F.when(equal, is_strict_json(a)).otherwise(canonical_json(differs(a)) == canonical_json(differs(b))), F.lit(False))
