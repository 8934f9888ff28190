"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, node int, kind int, depth string, n_convs int"


def plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    for v in own.values():
        v.sort(key=lambda z: z[:3])
    paths = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20))
        turns = [z[3] for z in v]
        paths[c] = turns if base == c else [z[3] for z in own.get(base, [])][:h] + turns[h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    words = lambda x: len(x.replace("\x0b", " ").encode().split())
    out = []
    for node, m in members.items():
        below = [n for n in members if n[:len(node)] == node]
        has = lambda n: any(len(k) == len(n) + 1 and k[:len(n)] == n for k in members)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m),
                    sum(len(n) == len(node) + 1 for n in below), sum(not has(n) for n in below),
                    sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, n):
    rnd = random.Random(seed)
    texts = ["a b c", "one", "", None, "  ", "x\x0by", "é ü", "two words"]
    rows = []
    for c in [*range(n), *range(-45, -20)]:
        if c % 20 or rnd.random() < .8:
            for t in range(rnd.choice([1, 2, 3, 5, 9, 12])):
                rows.append((c, rnd.choice([t, t, t, None, 1]), rnd.choice(["user", "assistant", None]) if t > 2 else "user",
                             rnd.choice(texts) if t > 1 else rnd.choice(texts[:2])))
    rows += [(n + 1, t, "user", "same") for t in range(30)] + [(n + 2, t, "user", "same") for t in range(30)]
    rows += [(None, 0, "user", "lost"), (5, 3, "user", "twice"), (5, 3, "user", "twice")]
    return rows


@pytest.mark.parametrize("width", [2, 8])
def test_against_plain_tries(spark, width):
    rows = random_rows(width, 90)
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(4)
    got = trie.prefix_trie(df, width=width).drop("node", "parent").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
