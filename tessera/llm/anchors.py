"""Content-defined anchors: positions chosen so that equal stretches have equal anchors.

Of every ``span`` consecutive items the run of ``k`` items with the smallest hash is an anchor, so a
stretch of ``span`` items that occurs twice has the same anchor at the same place in both.  About
``2 / (span - k + 2)`` of the positions are anchors.  Equal stretches are then found by comparing
only what surrounds equal anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` hashes the position of its smallest (the leftmost, if several)."""
    if len(h) < w:
        return np.empty(0, np.int64)
    best, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < w:
        step = min(width, w - width)                  # the last doubling overlaps
        right = best[step:] < best[:len(best) - step]
        at = np.where(right, at[step:], at[:len(at) - step])
        best = np.where(right, best[step:], best[:len(best) - step])
        width += step
    return at


def owners(h: np.ndarray, k: int, span: int) -> np.ndarray:
    """``h``: hashes of the runs of ``k`` items.  For each window of ``span`` items, the position of
    its anchor."""
    return window_minima(h, span - k + 1)


def recurring(rows: DataFrame, condition: str, **least_most) -> DataFrame:
    """Anchors (column ``anchor``) that meet ``condition`` over the given aggregates."""
    return stored(rows.groupBy("anchor").agg(*[e.alias(n) for n, e in least_most.items()])
                  .where(condition).select("anchor"), "anchors-recurring")


def per_text(rows: DataFrame, found: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The recurring anchors of each text as a list (no longer than the text)."""
    return stored(rows.join(found, "anchor").groupBy(*keys).agg(F.collect_set(value).alias(out)), "anchors-of-texts")
