"""Vector tables: which rows take part, and Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """``id, vec`` of the rows that take part: id and vector present, no null or non-finite
    component (``nonzero``: not all zero either).  Rows that repeat an id all take part."""
    x = F.col("vec")
    ok = F.col("id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    if nonzero:
        ok = ok & F.exists(x, lambda c: c != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(ok)


def matrices(ids: pa.Array, vecs: pa.Array):
    """``(ids, matrix)`` per vector length in one Arrow batch, as float64."""
    ids = ids.to_numpy(zero_copy_only=False)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vecs.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield ids[at], flat[starts[at][:, None] + np.arange(d)]


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` highest scores (ties to the smaller id)."""
    by_id = np.argsort(ids, kind="stable")
    s = scores[:, by_id]
    k = min(k, s.shape[1])
    rows, cols = [], []
    for a in range(0, s.shape[0], 256):
        part = s[a:a + 256]
        worst = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] if k else None
        r, c = np.nonzero(part >= worst[:, None])
        order = np.lexsort((c, -part[r, c], r))
        r, c = r[order], c[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        rows.append(r[nth < k] + a)
        cols.append(by_id[c[nth < k]])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, int), np.empty(0, int))
