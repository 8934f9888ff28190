"""Exact top-k search by tiled matrix products.

Vectors are quantised to integers (``floor(scale * x)`` in double) and packed into tiles of at
most ``tile_rows`` rows, query rows into tiles of their own.  Candidate tiles are dealt to hash
shards; each query tile goes once to every shard and meets its tiles in an equi-join.  Each pair of
tiles is one matrix product that keeps only the ``k`` best per query; the short lists are merged
per (query, shard) and then per query, so no step holds more than a tile or sorts more than short
lists, and a task's rows are bounded by the tile size whatever the data.

Products run in float64 while every sum is below 2**53 (exact), else in Python integers.

Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no
part; vectors of another length than the query's are no candidates.  Every row is a candidate but the
query's own: rows are numbered when they are read, so rows that repeat an id count each.  Ties go to
the smaller id.  Scores beyond 63 bits are given as the largest (smallest) long, and such ties go to
the smaller id as well.  Fewer than ``k`` candidates: all of them.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.vectors import matrices, top_rows, usable

TILE = "dim int, ids binary, rows binary, data binary, big boolean"


def _tiles(rows: DataFrame, scale: float, tile_rows: int) -> DataFrame:
    """Quantised vectors as tiles ``dim, ids, rows, data, big`` (int32 data, or float64 if big)."""
    def build(batches):
        kept: dict[int, list] = {}

        def flush(d):
            ids, own, m = (np.concatenate([x[i] for x in kept[d]]) for i in range(3))
            del kept[d]
            out = {"dim": [], "ids": [], "rows": [], "data": [], "big": []}
            for a in range(0, len(ids), tile_rows):
                part = m[a:a + tile_rows]
                big = bool(np.abs(part).max(initial=0) >= 2 ** 31)
                out["dim"].append(d)
                out["ids"].append(ids[a:a + tile_rows].astype("<i8").tobytes())
                out["rows"].append(own[a:a + tile_rows].astype("<i8").tobytes())
                out["data"].append(part.astype("<f8" if big else "<i4").tobytes())
                out["big"].append(big)
            return pa.RecordBatch.from_pydict(out, pa.schema([
                ("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("data", pa.binary()), ("big", pa.bool_())]))

        for b in batches:
            rows, ids = b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            for at, m in matrices(pa.array(np.arange(b.num_rows)), b.column(1)):
                kept.setdefault(m.shape[1], []).append((ids[at], rows[at], np.floor(scale * m)))
                if sum(len(x[0]) for x in kept[m.shape[1]]) >= tile_rows:
                    yield flush(m.shape[1])
        for d in list(kept):
            yield flush(d)

    return rows.mapInArrow(build, TILE)


def _unpack(ids, rows, data, big):
    i = np.frombuffer(ids.as_py(), "<i8")
    return i, np.frombuffer(rows.as_py(), "<i8"), np.frombuffer(data.as_py(), "<f8" if big.as_py() else "<i4").astype(np.float64).reshape(len(i), -1)


def _products(k: int):
    """Per pair of tiles: the ``k`` best candidates of each query, without the query's own row."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])

    def run(batches):
        for b in batches:
            for n in range(b.num_rows):
                r = {name: b.column(i)[n] for i, name in enumerate(b.schema.names)}
                qi, qr, q = _unpack(r["q_ids"], r["q_rows"], r["q_data"], r["q_big"])
                ci, cr, c = _unpack(r["ids"], r["rows"], r["data"], r["big"])
                bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)
                if bound < 2 ** 53:
                    s = q @ c.T
                else:
                    ints = lambda m: np.array([[int(x) for x in row] for row in m], object)
                    s = ints(q) @ ints(c).T
                    s = np.clip(s, -2 ** 63 + 1, 2 ** 63 - 1).astype(np.int64)
                for a in range(0, len(qi), 256):
                    part, own = s[a:a + 256], qr[a:a + 256][:, None] == cr[None, :]
                    x, y = top_rows(part, ci, k + 1)     # one more: the query itself may be among them
                    keep = ~own[x, y]
                    x, y = x[keep], y[keep]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(qr[a + x]), pa.array(qi[a + x]), pa.array(ci[y]), pa.array(part[x, y].astype(np.int64)),
                        pa.array(np.full(len(x), r["shard"].as_py(), np.int32))], schema=schema)

    return run


def merge_top(lists: DataFrame, k: int, group: str, order: list[Column]) -> DataFrame:
    """Merge short lists in two rounds, per (query, ``group``) and per query (``query_row``): adds ``rank``."""
    first = Window.partitionBy("query_row", group).orderBy(*order)
    last = Window.partitionBy("query_row").orderBy(*order)
    return (lists.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, tile_rows: int = 2048,
                query_rows: int = 1024, shards: int = 64, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query`` (a condition on the
    column ``id``) the ``k`` other rows of highest integer inner product."""
    rows = stored(usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    cand = _tiles(rows, scale, tile_rows).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    q = _tiles(rows.where(is_query), scale, query_rows).select(
        "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("data").alias("q_data"), F.col("big").alias("q_big"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    pairs = q.join(cand, ["shard", "dim"])
    best = pairs.mapInArrow(_products(k), "query_row long, query_id long, vec_id long, score long, shard int")
    return merge_top(best, k, "shard", [F.col("score").desc(), F.col("vec_id")]).select(
        "query_id", "rank", "vec_id", "score")
