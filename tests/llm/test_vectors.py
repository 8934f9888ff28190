"""Exact and approximate search against brute force."""

import math
import random

import numpy as np
import pytest

from tessera.llm import ann, topk

IS_QUERY = "id % 50 = 0"
SCHEMA = "vec_id long, embedding array<float>, id string, rank int, score int"


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, .3) for _ in range(16)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]                    # ties with a query
    rows += [(500, None), (501, [0.0] * 16), (502, [1.0] * 15 + [None]), (503, [1.0] * 15 + [math.nan]),
             (504, [1.0] * 15 + [math.inf]), (None, [1.0] * 16), (505, [1.0] * 7), (550, [.5] * 7), (506, []),
             (3, rows[3][1]), (507, [3e37] * 16)]
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(4)


def taking_part(df, nonzero):
    """``(id, vector)`` of every row that takes part."""
    out = []
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if not nonzero or any(v):
            out.append((r["vec_id"], v))
    return out


def test_exact_top_k(vectors):
    part = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in taking_part(vectors, False)]
    expected = []
    for own, (q, x) in enumerate(part):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, v)), i) for n, (i, v) in enumerate(part) if n != own and len(v) == len(x))[:5]
            expected += [(q, n, i, max(min(-s, 2 ** 63 - 1), 1 - 2 ** 63)) for n, (s, i) in enumerate(found, 1)]
    got = [tuple(r) for r in topk.exact_top_k(vectors, IS_QUERY, tile_rows=64, query_rows=3).collect()]
    assert sorted(got) == sorted(expected)


def recall(part, got, k=5, by_id=True):
    """Share of the true neighbours that were found; checks order, ranks and scores on the way.
    ``part``: (id, vector) with different ids for the queries."""
    hits = total = 0
    lists = {}
    for q, n, i, s in got:
        lists.setdefault(q, []).append((n, i, s))
    ids, unit = np.array([i for i, _ in part]), {}
    for d in {len(v) for _, v in part}:
        at = [n for n, (_, v) in enumerate(part) if len(v) == d]
        m = np.array([part[n][1] for n in at], float).reshape(len(at), d)
        unit[d] = (np.array(at), m / np.abs(m).max(axis=1, keepdims=True))
    asked = [n for n, (i, _) in enumerate(part) if i % 50 == 0]
    for own in asked:
        q, x = part[own]
        at, m = unit[len(x)]
        mine = m[np.flatnonzero(at == own)[0]]
        cos = (m @ mine) / np.sqrt((m * m).sum(axis=1)) / np.sqrt(mine @ mine)
        rest = at != own
        order = np.lexsort((ids[at[rest]], -np.round(cos[rest], 12)))
        best = ids[at[rest]][order][:k]
        found = sorted(lists.pop(q, []))
        assert [n for n, _, _ in found] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        true = {}
        for i, c in zip(ids[at[rest]], cos[rest]):
            true.setdefault(int(i), []).append(c)
        assert all(min(abs(c - s) for c in true[i]) < 1e-12 for _, i, s in found)
        left = list(best)
        for _, i, _ in found:
            if i in left:
                left.remove(i)
                hits += 1
        total += len(best)
    assert not lists
    return hits / total


def test_nearest_recall_and_order(vectors):
    part = [(i, v) for i, v in taking_part(vectors, True)]
    got = [tuple(r) for r in ann.nearest(vectors, IS_QUERY, min_block=16, max_block=64).collect()]
    assert recall(part, got) >= 0.9


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_recall_by_id(spark, kind):
    rnd = np.random.default_rng(8)
    m = rnd.normal(size=(3000, 32))
    if kind == "clustered":
        m = rnd.normal(size=(60, 32))[rnd.integers(0, 60, 3000)] + 0.15 * m
    if kind == "copies":
        m[rnd.permutation(3000)[:1200]] = m[7]
    part = [(int(i), v.tolist()) for i, v in zip(rnd.permutation(3000), m)]
    df = spark.createDataFrame(part, "vec_id long, embedding array<double>").repartition(5)
    assert recall(part, [tuple(r) for r in ann.nearest(df, IS_QUERY).collect()]) >= 0.9


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[1:3] for r in ann.nearest(df, IS_QUERY).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert [tuple(r)[2] for r in topk.exact_top_k(df, IS_QUERY).orderBy("rank").collect()] == [1, 1, 1, 2]


@pytest.mark.parametrize("bits,dims", [(1, 3), (3, 2), (2, 3), (2, 4)])
def test_hilbert_neighbours_differ_by_one_step(bits, dims):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = ann.hilbert_keys(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, IS_QUERY).collect() == [] and ann.nearest(none, IS_QUERY).collect() == []
