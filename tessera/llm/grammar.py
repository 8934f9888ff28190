"""Re-Pair grammars over short alphabets, and min-plus transfer matrices with audit ropes.

A sequence is a string with one character per item.  A rule replaces a pair of neighbouring
characters by a new one; the rules of a round share no character, so their order does not matter.

A transfer matrix tells, for every state before and after, the cheapest way through a sequence: its
cost and its edits as a rope, ties to the ASCII-least edits.  The matrix of a rule is the product of
its two parts', so equal stretches are worked out once.  Of two ways of equal cost through the same
sequence, neither audit is a proper beginning of the other (that would need further, costly
inserts), so the lesser one stays the lesser whatever follows: products may keep only the best.
"""

from __future__ import annotations

STATES = 4                     # nothing yet, after system, after user, after assistant
#: Where a turn of each role leads from each state (-1: not allowed there).
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ACCEPTED = (0, 3)
GONE = "X"                     # a turn that must be deleted
FIRST_RULE = 0x100             # rules are the characters from here on


class Rope:
    """Edits as a text or as two ropes; the text is put together when asked for."""
    __slots__ = ("left", "right", "_text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self._text, self.left, self.right = text, left, right

    @property
    def text(self) -> str:
        if self._text is None:
            parts, todo = [], [self]
            while todo:
                r = todo.pop()
                if r._text is not None:
                    parts.append(r._text)
                else:
                    todo += [r.right, r.left]
            self._text, self.left, self.right = "".join(parts), None, None
        return self._text

    def __reduce__(self):
        return Rope, (self.text,)


Cell = tuple[int, Rope]        # cost and edits
Matrix = list[list["Cell | None"]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The cheapest ways through one sequence and then another."""
    out: Matrix = []
    for row in a:
        line: list[Cell | None] = []
        for j in range(STATES):
            best, ways = None, []
            for k, x in enumerate(row):
                y = b[k][j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best):
                    if best is None or x[0] + y[0] < best:
                        best, ways = x[0] + y[0], []
                    ways.append((x[1], y[1]))
            if not ways:
                line.append(None)
                continue
            way = ways[0] if len(ways) == 1 else min(ways, key=lambda w: w[0].text + w[1].text)
            line.append((best, Rope(None, *way)))
        out.append(line)
    return out


def _edges(moves: list[tuple[int, int, int, str]]) -> Matrix:
    m: Matrix = [[None] * STATES for _ in range(STATES)]
    for i, j, cost, edits in moves:
        if m[i][j] is None or (cost, edits) < (m[i][j][0], m[i][j][1].text):
            m[i][j] = (cost, Rope(edits))
    return m


def inserts(cost: int = 2) -> Matrix:
    """Any number of inserted user and assistant turns."""
    moves = [(i, i, 0, "") for i in range(STATES)]
    for i in range(STATES):
        at, n = i, 0
        while n < 2:           # from the third on a state comes back
            at, n = NEXT["a" if at == 2 else "u"][at], n + 1
            moves.append((i, at, n * cost, "I" * n))
    return _edges(moves)


def turn(symbol: str, rerole: int = 2, delete: int = 3, truncated: int = 1) -> Matrix:
    """One turn: kept, given another role, or deleted.  An upper-case role is truncated."""
    moves = [(i, i, delete, "D") for i in range(STATES)]
    if symbol != GONE:
        extra, role = (truncated, symbol.lower()) if symbol.isupper() else (0, symbol)
        for to, cost, edit in [(role, 0, "K"), ("u", rerole, "R"), ("a", rerole, "R")]:
            moves += [(i, j, cost + extra, edit) for i, j in enumerate(NEXT.get(to, ())) if j >= 0]
    return _edges(moves)


def terminals() -> dict[str, Matrix]:
    """A matrix per symbol, with what may be inserted after it."""
    after = inserts()
    return {s: product(turn(s), after) for s in "suaoSUAO" + GONE}


def with_rules(rules: list[str]) -> dict[str, Matrix]:
    """Matrices of all symbols, the rules' from the bottom up."""
    out = terminals()
    for n, pair in enumerate(rules):
        out[chr(FIRST_RULE + n)] = product(out[pair[0]], out[pair[1]])
    return out


def compressed(sequence: str, rules: list[str]) -> str:
    for n, pair in enumerate(rules):
        if pair[0] in sequence:
            sequence = sequence.replace(pair, chr(FIRST_RULE + n))
    return sequence


def chosen(counts: list[tuple[str, int]]) -> list[str]:
    """Of pairs in order of their counts, the frequent ones that share no character."""
    used, out = set(), []
    for pair, n in counts:
        if n > 1 and not used & set(pair):
            used |= set(pair)
            out.append(pair)
    return out


def through(sequence: str, matrices: dict[str, Matrix]) -> Matrix:
    """The matrix of a compressed sequence, by halves."""
    level = [matrices[c] for c in sequence]
    while len(level) > 1:
        level = [product(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and edits of a whole sequence, from its matrix."""
    start = product(inserts()[:1], m)[0]
    return min((c, r.text) for c, r in (start[j] for j in ACCEPTED if start[j] is not None))


def packed(m: Matrix) -> tuple[list[int], list[str | None]]:
    cells = [c for row in m for c in row]
    return [-1 if c is None else c[0] for c in cells], [None if c is None else c[1].text for c in cells]


def unpacked(costs: list[int], audits: list[str | None]) -> Matrix:
    cells = [None if a is None else (c, Rope(a)) for c, a in zip(costs, audits)]
    return [cells[i:i + STATES] for i in range(0, len(cells), STATES)]
