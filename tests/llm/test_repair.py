"""Conversation repair against a plain search, on small and long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import grammar, repair

SCHEMA = "conv_id long, turn long, role string, text string, c string, h int, kind int, copies string, cost int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    """Conversations after damage, in order; every id is there."""
    out = {}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        conv = out.setdefault(c, [])
        if draw == 0:
            continue
        if draw == 1:
            x = ""
        if draw == 2:
            x = re.sub("[.!?]", "", x)
        if draw == 4:
            r = "user"
        conv += [(t, r, x)] * (1 + (draw == 3))
    for conv in out.values():
        conv.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).hexdigest()))
    return out


def plain_repair(conv):
    counts, seen, ways = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), {"": (0, "", ())}
    # a way is known by the roles it gives so far, of which only the last and whether there is one matter

    def better(d, last, way):
        if last not in d or way[:2] < d[last][:2]:
            d[last] = way

    def insert(d):
        d = dict(d)
        for _ in range(2):
            for last, (cost, audit, out) in list(d.items()):
                role = "assistant" if last == "u" else "user"
                better(d, role[0], (cost + 2, audit + "I", (*out, f"{role}:")))
        return d

    ways = insert(ways)
    for t, r, x in conv:
        fault = None
        if not BLANK.search(x):
            fault = "blank"
        elif (r, x) in seen:
            fault = "duplicate"
        elif BLANK.findall(x)[-1] not in ".!?":
            fault = "truncated"
        seen.add((r, x))
        if fault:
            counts[fault] += 1
        new = {}
        for last, (cost, audit, out) in ways.items():
            better(new, last, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            for role, price, edit in ((r, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                if re.fullmatch("s|u|su|ua|au", last + role[:1]) and len(role) and (last or role[0] in "su"):
                    better(new, role[0], (cost + price + (fault == "truncated"), audit + edit, (*out, f"{role}:{x}")))
        ways = insert(new)
    cost, audit, out = min(ways[k] for k in ("", "a") if k in ways)
    turns = [t for t, _, _ in conv if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[:1] for _, r, _ in conv]
    illegal = sum(not (a and b) or a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "  ", "", None, "\x0b\n", "Ok. ", "é", "a.b", "Yes."]
    roles = ["user", "assistant", "system", "tool", None, "", "sys", "ass", "User"]
    weights = [9, 9, 3, 1, 1, 1, 1, 1, 1]
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([t, t, t, t + 2, None]), rnd.choices(roles, weights)[0], rnd.choice(texts)))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, 1, "assistant", "Ho."), (7, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(5)


def check(spark, rows, **options):
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items()}
    got = repair.repair(repair.damaged(frame(spark, rows)), copies_col="copies", **options).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_against_plain_search(spark):
    check(spark, random_rows(1))


def test_blocks_and_trees_change_nothing(spark):
    rows = random_rows(2, 60)
    rnd = random.Random(3)
    rows += [(1000, t // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "cut", "", f"t{t}.", f"u{t}"])) for t in range(700)]
    rows += [(1001, 5, "user", "Same.")] * 90
    check(spark, rows, block=7, fan=3, rounds=3)


def test_repaired_turns(spark):
    rows = random_rows(4, 80)
    turns = {}
    for r in repair.repair(repair.damaged(frame(spark, rows)), keep_turns=True, copies_col="copies").collect():
        turns.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}", r["edit"]))
    for c, conv in plain_damage(rows).items():
        mine = sorted(turns.get(c, []))
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(x for _, x, _ in mine).encode()).hexdigest() == plain_repair(conv)[-1]
        assert [e for _, _, e in mine] == [e for e in plain_repair(conv)[-2] if e != "D"]


def test_grammar_gives_what_single_steps_give():
    rnd = random.Random(5)
    rules = ["ua", "Us", chr(grammar.FIRST_RULE) * 2, "X" + chr(grammar.FIRST_RULE + 2)]
    with_rules, alone = grammar.with_rules(rules), grammar.with_rules([])
    for _ in range(300):
        s = "".join(rnd.choice("uauauasoXUA") for _ in range(rnd.randint(1, 40)))
        short = grammar.compressed(s, rules)
        step = alone[s[0]]
        for c in s[1:]:
            step = grammar.product(step, alone[c])
        assert grammar.packed(grammar.through(short, with_rules)) == grammar.packed(step)


@pytest.mark.parametrize("keep_turns", [False, True])
def test_empty_table(spark, keep_turns):
    assert repair.repair(frame(spark, random_rows(1)).limit(0), keep_turns).collect() == []
