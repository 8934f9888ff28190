"""Connected components of a link table, in rounds of joins; no link ever reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fewer_tasks, stored

_CHUNK = 500_000             # links that a task looks at together


def _stars(batches):
    """Links of a chunk -> links of its nodes to the smallest node that the chunk connects them with."""
    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[:len(u)], at[len(u):]
        label = np.arange(len(ids))
        while (label[a] != label[b]).any():
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        child = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[child], pa.int64()), pa.array(ids[label[child]], pa.int64())],
                                          names=["u", "v"])

    held, n = [], 0
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += x.num_rows
        if n >= _CHUNK:
            yield star(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield star(*map(np.concatenate, zip(*held)))


def _is_flat(links: DataFrame, rows: int) -> bool:
    """Whether every node with a smaller neighbour has that one alone, and no larger ones."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    deep = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0")
    return fewer_tasks(deep, rows).count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id of ``links``.  ``rows``: how many links there are
    at most, if that is known.

    Each task first reduces chunks of links to stars.  Then two steps alternate until the stars are flat: every
    node points its larger neighbours, then its smaller ones, to the smallest of them.  Stars of any depth flatten in
    a logarithmic number of rounds.  Tables are written between steps, so the joins sit directly on exchanges and the
    skew join can split a node with very many links.  No step has more links than the one before."""
    pairs = stored(fewer_tasks(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
                   .distinct(), rows), "links")
    now = stored(fewer_tasks(pairs.mapInArrow(_stars, "u long, v long").distinct(), pairs.count()), "links")
    n = 2 * now.count()                  # nodes, and links from both ends
    while not _is_flat(now, n):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(fewer_tasks(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n), "least")
        large = stored(fewer_tasks(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct(), n), "links")
        least = stored(fewer_tasks(large.groupBy("u").agg(F.min("v").alias("m")), n), "least")
        now = stored(fewer_tasks(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), n), "links")
    # every node now points to the smallest id of its component
    return stored(fewer_tasks(now.select(F.col("u").alias("id"), F.col("v").alias("component"))
                  .unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), n), "components")
