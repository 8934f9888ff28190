"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one class with a list of its smallest ids, so copies can't push each other out of a
window.  Each of ``curves`` orderings projects the classes' unit vectors on ``dims`` random
orthonormal directions, maps each coordinate to (0, 1) by the logistic curve, shifts the grid, and
takes the cell's index on a Hilbert curve as key.  Spark range-partitions and sorts all (curve, key,
class) rows once, which gives every class its position on every curve.  The rows carry the vector as
one byte per component, not the vector.

A query looks at the classes whose position lies within ``window`` (a share of all) around its own:
positions are cut into blocks, queries go to the blocks their window touches, and each block keeps
the ``2 * k`` best by these bytes.  Lists are merged per (query, curve) and per query; the ``4 * k``
best classes of a query fetch their vectors and are reranked by exact cosine in double precision.
Ranks are then filled from the classes' ids; of the query's own class all rows but its own count.

The window is a share of the table because on vectors without structure recall at a fixed number of
rows falls as the table grows; ``curves * window`` below 1 keeps what a query reads below brute
force.  Blocks hold at most ``max_block`` rows, so tasks are bounded.  Recall is measured against
brute force in the tests.

Rows whose id or vector is null, whose vector is zero or holds a null or non-finite component take
no part; vectors of different lengths never meet.  Rows that repeat an id all take part.  Ties go to
the smaller id.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.topk import merge_top
from tessera.llm.vectors import matrices, top_rows, usable
from tessera.operators.position import with_ord


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer grid cells (n, m) with ``bits`` bits per axis.

    Walks the bits from the top; every axis whose bit is set inverts, every other one exchanges,
    the lower bits of the first axis, which turns the sub-cube into standard position; the
    Gray-coded bits are then read axis by axis."""
    one = np.uint64(1)
    ax = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(len(ax)):
            on = (ax[i] >> np.uint64(b)) & one == one
            swap = np.where(on, np.uint64(0), (ax[0] ^ ax[i]) & low)
            ax[0] = np.where(on, ax[0] ^ low, ax[0] ^ swap)
            if i:
                ax[i] = ax[i] ^ swap
    for i in range(1, len(ax)):
        ax[i] = ax[i] ^ ax[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((ax[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in ax:
            key = (key << one) | (((a ^ turn) >> np.uint64(b)) & one)
    return key


def curve_keys(unit: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Keys of unit vectors on one curve; projection and shift depend on (seed, curve) only."""
    d = unit.shape[1]
    rng = np.random.default_rng([seed, curve, d])
    m = min(dims, d)
    directions = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m]
    # a coordinate of a random unit vector has deviation 1 / sqrt(d); logistic of 1.702 x is near its distribution
    even = 1.0 / (1.0 + np.exp(-1.702 * np.sqrt(d) * np.clip(unit @ directions, -8, 8)))
    side = 1 << bits
    shifted = (even * side + rng.uniform(0, 1, m)) * side / (side + 1)
    return hilbert_keys(np.clip(shifted.astype(np.int64), 0, side - 1), bits)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _classes(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``cid, vec, ids, asked``: distinct vectors with their ``k + 1`` smallest ids."""
    smallest = F.row_number().over(Window.partitionBy("vec").orderBy("id"))     # limited before the shuffle
    ids = rows.withColumn("nth", smallest).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.groupBy("vec").agg(F.max(is_query).alias("asked"))
    return stored(ids.join(asked, "vec").withColumn("cid", F.monotonically_increasing_id()), "ann-classes")


def _exact(batches):
    """Cosine of pairs of vectors, pair by pair."""
    for b in batches:
        q, c = ([np.asarray(v, np.float64) for v in b.column(i).to_pylist()] for i in (2, 3))
        score = [float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))) for x, y in ((_scaled(x), _scaled(y)) for x, y in zip(q, c))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["qcid", "cid", "score"])


def _scaled(x: np.ndarray) -> np.ndarray:
    """By a power of two, which changes no cosine: squares neither overflow nor vanish."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, curves: int = 24, dims: int = 6, bits: int = 3,
            window: float = 0.04, min_block: int = 64, max_block: int = 32768, seed: int = 11,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` (cosine) for every row with ``is_query`` (a condition on
    the column ``id``)."""
    rows = usable(vectors, id_col, vec_col, nonzero=True)
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    classes = _classes(rows, F.coalesce(is_query, F.lit(False)), k)
    schema = pa.schema([("cid", pa.int64()), ("asked", pa.bool_()), ("dim", pa.int32()), ("curve", pa.int32()), ("key", pa.int64()),
                        ("sketch", pa.binary())])

    def on_curves(batches):
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                asked = part.column(2).to_numpy(zero_copy_only=False)
                cids = part.column(0).to_numpy(zero_copy_only=False)
                for at, m in matrices(pa.array(np.arange(part.num_rows)), part.column(1)):
                    unit = _unit(m)
                    sketch = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
                    sketch = pa.array([r.tobytes() for r in sketch], pa.binary())
                    for c in range(curves):
                        key = curve_keys(unit, c, dims, bits, seed).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(cids[at]), pa.array(asked[at], pa.bool_()), pa.array(np.full(len(at), m.shape[1], np.int32)),
                            pa.array(np.full(len(at), c, np.int32)), pa.array(key), sketch], schema=schema)

    keyed = classes.select("cid", "vec", "asked").mapInArrow(on_curves, "cid long, asked boolean, dim int, curve int, key long, sketch binary")
    placed = with_ord(keyed, ["dim", "curve", "key", "cid"])
    # one row per vector length: how many classes, where they begin, how far a window and a block reach
    per_dim = placed.where("curve = 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * curves)
    half = F.ceil(F.col("n") * (window / 2)).cast("long")
    per_dim = per_dim.withColumn("half", half).withColumn(
        "size", F.least(F.greatest(F.lit(min_block).cast("long"), half), F.lit(max_block).cast("long")))   # a window touches three blocks
    at = placed.join(per_dim, "dim").withColumn("pos", F.col("ord") - F.col("before") - F.col("curve") * F.col("n"))
    cand = at.select("dim", "curve", F.expr("pos div size").alias("block"), "cid", "sketch")
    first, last = F.expr("greatest(pos - half, 0L) div size"), F.expr("least(pos + half, n - 1) div size")
    asked = at.where("asked").select(F.col("dim").alias("q_dim"), F.col("curve").alias("q_curve"),
                                     F.explode(F.sequence(first, last)).alias("q_block"), F.col("cid").alias("q_cid"), F.col("sketch").alias("q_sketch"))
    found = (asked.groupBy("q_dim", "q_curve", "q_block").cogroup(cand.groupBy("dim", "curve", "block"))
             .applyInArrow(_rerank(2 * k), "query_row long, cid long, score float, curve int"))
    # the same neighbour found on several curves counts once
    once = found.groupBy("query_row", "cid").agg(F.max("score").alias("score"), F.min("curve").alias("curve"))
    short = stored(merge_top(once, 4 * k, "curve", [F.col("score").desc(), F.col("cid")]).select(F.col("query_row").alias("qcid"), "cid"), "ann-short")
    queries = classes.where("asked").select(F.col("cid").alias("qcid"), F.col("vec").alias("q"))
    pairs = short.unionByName(queries.select("qcid", F.col("qcid").alias("cid")))          # the own class first
    scored = (pairs.join(queries, "qcid").join(classes.select("cid", "vec"), "cid").select("qcid", "cid", "q", "vec")
              .mapInArrow(_exact, "qcid long, cid long, score double"))
    ranked = scored.join(classes.select("cid", "ids"), "cid").withColumn("own", F.col("cid") == F.col("qcid"))
    best = Window.partitionBy("qcid").orderBy(F.col("own").desc(), F.col("score").desc(), F.col("ids")[0])
    lists = stored(ranked.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).groupBy("qcid").agg(
        F.max(F.when(F.col("own"), F.struct("score", "ids"))).alias("own"),
        F.flatten(F.collect_list(F.when(~F.col("own"), F.transform("ids", lambda i: F.struct(
            (-F.col("score")).alias("down"), i.alias("vec_id")))))).alias("others")), "ann-lists")
    # every query row: the rows of its class but one of its own, and those of the nearest classes
    asked_rows = rows.where(is_query).join(classes.where("asked").select("vec", F.col("cid").alias("qcid")), "vec").select(
        F.col("id").alias("query_id"), "qcid")
    me = F.array_position("own.ids", F.col("query_id")) - 1
    mates = F.transform(F.filter("own.ids", lambda _, i: i != F.col("me")), lambda i: F.struct(
        (-F.col("own.score")).alias("down"), i.alias("vec_id")))
    out = asked_rows.join(lists, "qcid").withColumn("me", me).select(
        "query_id", F.posexplode(F.slice(F.array_sort(F.concat(mates, "others")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.down")).alias("score"))


def _rerank(k: int):
    """The ``k`` best classes of a block for each query, by one byte per component."""
    schema = pa.schema([("query_row", pa.int64()), ("cid", pa.int64()), ("score", pa.float32()), ("curve", pa.int32())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        m = np.stack([np.frombuffer(x, np.int8) for x in column.to_pylist()]).astype(np.float32)
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def run(asked: pa.Table, cand: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if asked.num_rows and cand.num_rows:
            qi, ci = asked.column("q_cid").to_numpy(), cand.column("cid").to_numpy()
            q, c = matrix(asked.column("q_sketch")), matrix(cand.column("sketch"))
            curve = cand.column("curve")[0].as_py()
            for a in range(0, len(qi), 256):
                s = q[a:a + 256] @ c.T
                s[qi[a:a + 256][:, None] == ci[None, :]] = -2            # the own class comes by itself
                x, y = top_rows(s, ci, k)
                keep = s[x, y] > -2
                x, y = x[keep], y[keep]
                out.append(pa.table([qi[a + x], ci[y], s[x, y], np.full(len(x), curve, np.int32)], schema=schema))
        return pa.concat_tables(out)

    return run
