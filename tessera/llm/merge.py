"""Merging front-coded sorted runs with a loser tree that knows common prefixes.

A run lists strings in order, each with the length of the prefix it shares with the one before.
Every candidate of the merge carries the prefix it shares with the last string that left; of two
candidates the one that shares more is smaller, without a look at the strings, and only if both
share equally much are they compared, from there on.  The prefixes found stay with the losers, so no
byte known to be equal is compared again.
"""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known:known + 16] == b[known:known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and remainders of sorted strings."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = common_prefix(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def decoded(shared, rest) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with the prefix shared with the one before."""
    last = b""
    for n, r in zip(shared, rest):
        last = last[:n] + r
        yield last, n


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs: yields ``(run, shared)`` in order of the strings, ``shared`` being the
    length of the prefix shared with the string before in the merged order."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k        # None: the run has ended, it loses to all
    shares = [0] * k                              # prefix shared with the last string that left
    for i, r in enumerate(runs):
        first = next(r, None)
        if first is not None:
            heads[i] = first[0]

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is then the one with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if shares[x] != shares[y]:
            return (x, y) if shares[x] > shares[y] else (y, x)
        n = common_prefix(a, b, shares[x])
        x, y = (x, y) if a[n:n + 1] <= b[n:n + 1] else (y, x)
        shares[y] = n
        return x, y

    tree = [0] * k                                # tree[1..k-1]: losers; tree[0]: the winner
    level = list(range(k))
    at = k // 2
    while len(level) > 1:
        up = []
        for j in range(0, len(level), 2):
            w, loser = play(level[j], level[j + 1])
            tree[at + j // 2] = loser
            up.append(w)
        level, at = up, at // 2
    winner = level[0] if level else 0
    while heads and heads[winner] is not None:
        yield winner, shares[winner]
        following = next(runs[winner], None)
        if following is None:
            heads[winner] = None
        else:
            heads[winner], shares[winner] = following
        at = (winner + k) // 2
        while at:
            winner, tree[at] = play(winner, tree[at])
            at //= 2
