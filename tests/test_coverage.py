"""Coverage of index ranges (R8) against a count per position."""

import random

import pytest

from tessera.operators import coverage


def brute(ranges, total):
    """Depth of every position, then runs of equal depth; borders end a run."""
    good = [(s, e) for s, e in ranges if s is not None and e is not None and s < e]
    lo, hi = min([0, *[s for s, _ in good]]), max([total, *[e for _, e in good]])
    depth = {p: sum(s <= p < e for s, e in good) for p in range(lo, hi)}
    out, p = [], lo
    while p < hi:
        q = p + 1
        while q < hi and depth[q] == depth[p] and q not in (0, total):
            q += 1
        inside = 0 <= p < total
        kind = ("gap" if depth[p] == 0 else "overlap" if depth[p] > 1 else None) if inside else ("outside" if depth[p] else None)
        if kind:
            out.append((kind, p, q, depth[p]))
        p = q
    return sorted(out + [("invalid", s, e, None) for s, e in ranges if (s, e) not in good], key=repr)


def found(spark, ranges, total, n=5):
    df = spark.createDataFrame(ranges, "start long, end long")
    return sorted((tuple(r) for r in coverage.range_coverage(df, total, num_partitions=n).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_positions(spark, seed):
    rnd = random.Random(seed)
    ranges = [(s, s + rnd.randint(-1, 12)) for s in (rnd.randint(-10, 150) for _ in range(30))] + [(None, 3), (5, None)]
    ranges += ranges[:3]
    assert found(spark, ranges, 140) == brute(ranges, 140)


def test_exact_cover_and_edges(spark):
    exact = [(i, i + 10) for i in range(0, 100, 10)]
    assert found(spark, exact, 100) == []
    coverage.require_coverage(spark.createDataFrame(exact, "start long, end long"), 100)
    assert found(spark, [], 7) == [("gap", 0, 7, 0)]
    assert found(spark, [], 0) == []
    assert found(spark, [(0, 10)] * 4, 10) == [("overlap", 0, 10, 4)]
    with pytest.raises(coverage.CoverageError, match=r"gap \[30, 40\)"):
        coverage.require_coverage(spark.createDataFrame(exact[:3] + exact[4:], "start long, end long"), 100)
