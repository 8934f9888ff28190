"""Structure repair of conversations by a grammar-compressed dynamic program.

Every turn has at most one fault: *blank* (no character but ASCII blanks), else *duplicate* (role and
text seen earlier in the conversation), else *truncated* (its last other character ends no
sentence).  A repaired conversation is empty or a system turn, if any, and then user and assistant in
turn.  Keeping a turn is free, a new role costs 2, deleting 3 (a must for blank and duplicate turns),
inserting an empty turn 2, and a truncated turn that stays 1.  Of the cheapest edits, the ASCII-least
string of initials (Delete, Insert, Keep, Rerole) counts.

1. Turns without their texts (a digest stands for the text) are range-sorted by conversation and
   turn; each task writes its stretch as blocks of at most ``block`` symbols, one per role and
   fault, with the counts.  A conversation of any size is thus cut into bounded blocks.  Equal turns
   are counted before the sort, first occurrences by an aggregate, so no hot key meets in a task.
2. Distinct blocks share a Re-Pair grammar: each round counts neighbouring pairs over all of them
   in Spark and makes rules of the most frequent ones (at most ``rules_per_round``: all that the
   driver sees).  A rule has a transfer matrix (``grammar``), worked out once, bottom-up.
3. A task compresses a distinct block and multiplies its matrices.  Conversations in several blocks
   multiply theirs in a tree, ``fan`` at a time.
4. Turns and edits meet by conversation, in order, and run through as a stream that holds one batch:
   the repaired turns, or their SHA-256 (whose nature is one stream per conversation).

Turns of one number are ordered by role and digest of the text.  A null turn number comes first; a
null role or text is one blank; a null id names a conversation like any other.  ``copies`` (if the
column is given) says how often a row counts; a conversation of rows that count zero times has no
turns: zeros and the digest of nothing.  Repeated rows are duplicates.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import grammar
from tessera.llm.common import stored

#: Fixed value: the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = frozenset(["su", "ua", "au"])


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows as a test of repair damages them, by ``crc32("id:turn") % 20``: 0 drops the row, 1
    empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls in the key, the
    role and the text are one blank.  Returns ``conv_id, turn, role, text, copies`` (0, 1 or 2)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text_of(id_col), F.lit(":"), text_of(turn_col))
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     text_of(role_col).alias("role"), text_of(text_col).alias("text"),
                     (F.crc32(key.cast("binary")) % 20).alias("draw"))
    draw = F.col("draw")
    return rows.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


def _keyed(df: DataFrame) -> DataFrame:
    """Distinct turns of each conversation: how many, their symbol, and whether the first of them is
    a duplicate already."""
    inner = F.expr(f"trim(BOTH '{BLANKS}' FROM text)".replace("\t", "\\t").replace("\n", "\\n").replace("\x0b", "\\u000b")
                   .replace("\x0c", "\\u000c").replace("\r", "\\r"))
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    turns = (df.where("copies > 0").withColumn("inner", inner)
             .select("c", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), "copies",
                     F.when(F.col("inner") == "", F.lit(grammar.GONE))
                     .when(F.substring("inner", -1, 1).isin(".", "!", "?"), symbol).otherwise(F.upper(symbol)).alias("symbol")))
    equal = turns.groupBy("c", "turn", "role", "h", "symbol").agg(F.sum("copies").alias("n"))
    first = equal.groupBy(F.col("c").alias("c2"), F.col("role").alias("role2"), F.col("h").alias("h2")).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.count(F.lit(1)).alias("turns"))
    again = first.where("turns > 1")
    met = equal.join(again, F.col("c").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("role2")) & (F.col("h") == F.col("h2")), "left")
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("least"))), F.lit(False))
    return met.select("c", "turn", "role", "h", "n", "symbol", seen.alias("seen"))


BLOCK = ("c long, part int, nth int, whole boolean, symbols string, blank long, duplicate long, truncated long, illegal long, "
         "first string, last string, low long, high long, turns long")


def _blocks(block: int):
    """Sorted distinct turns -> blocks of symbols with their counts."""
    names = [f.split()[0] for f in BLOCK.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in BLOCK.split(", ")])

    def new(c, nth, whole):
        return dict.fromkeys(names, 0) | {"c": c, "part": TaskContext.get().partitionId(), "nth": nth, "whole": whole,
                                          "symbols": [], "size": 0, "first": None, "last": None, "low": None, "high": None}

    def run(batches):
        done, now, nth = [], None, 0

        def close():
            now["symbols"] = "".join(now["symbols"])
            done.append({k: now[k] for k in names})

        for b in batches:
            for c, turn, role, n, symbol, seen in zip(*[b.column(b.schema.get_field_index(x)).to_pylist()
                                                        for x in ("c", "turn", "role", "n", "symbol", "seen")]):
                if now is None or now["c"] != c:
                    if now is not None:
                        close()
                    nth += 1
                    # the first and the last conversation of a task may reach into others
                    now = new(c, nth, nth > 1)
                initial, fresh = role[:1], not seen
                while n:
                    if now["size"] == block:
                        now["whole"] = False
                        close()
                        nth += 1
                        now = new(c, nth, False)
                    k = 1 if fresh else min(n, block - now["size"])
                    gone = symbol == grammar.GONE
                    if now["first"] is None:
                        now["first"] = initial
                    else:
                        now["illegal"] += now["last"] + initial not in LEGAL or not (now["last"] and initial)
                    now["illegal"] += k - 1                 # one initial twice
                    now["last"] = initial
                    if gone:
                        now["blank"] += k
                    elif not fresh:
                        now["duplicate"] += k
                    elif symbol.isupper():
                        now["truncated"] += 1
                    now["symbols"].append(symbol if fresh else grammar.GONE * k)
                    now["size"] += k
                    if turn is not None and turn != now["high"]:
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["high"], now["turns"] = turn, now["turns"] + 1
                    n, fresh = n - k, False
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            now["whole"] = False
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def _rules(sequences: DataFrame, rounds: int, rules_per_round: int) -> list[str]:
    """Re-Pair rules, the most frequent pairs of all sequences first."""
    rules: list[str] = []
    for _ in range(rounds):
        def pairs(batches, known=tuple(rules)):
            for b in batches:
                count: dict[str, int] = {}
                for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = grammar.compressed(s, known)
                    for x, y in zip(s, s[1:]):
                        count[x + y] = count.get(x + y, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                                 names=["pair", "n"])

        # characters beyond the rules' are no symbols, so distinct pairs are few
        top = (sequences.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
               .where("n > 1").orderBy(F.desc("n"), "pair").limit(rules_per_round).collect())
        new = grammar.chosen([(r["pair"], r["n"]) for r in top])
        if not new:
            break
        rules += new
    return rules


def _solve(rules: list[str]):
    """Distinct blocks -> cost and edits, and all cells of their matrices."""
    def run(batches):
        matrices = grammar.with_rules(rules)
        for b in batches:
            cols = [[] for _ in range(4)]
            for s in b.column(0).to_pylist():
                m = grammar.through(grammar.compressed(s, rules), matrices)
                for c, v in zip(cols, (*grammar.cheapest(m), *grammar.packed(m))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.string()))],
                names=["symbols", "cost", "audit", "costs", "audits"])

    return run


PART = ("c long, at long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, "
        "turns long, cost long, audit string, costs array<long>, audits array<string>")


def _joined(table: pa.Table) -> pa.Table:
    """Neighbouring blocks of one conversation as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    out = rows[0]
    level = [grammar.unpacked(r["costs"], r["audits"]) for r in rows]
    while len(level) > 1:
        level = [grammar.product(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    for r in rows[1:]:
        out["illegal"] += out["last"] + r["first"] not in LEGAL or not (out["last"] and r["first"])
        out["turns"] -= out["high"] is not None and out["high"] == r["low"]
        for c in (*COUNTS, "turns"):
            out[c] += r[c]
        out["last"] = r["last"]
        out["low"] = r["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if r["high"] is None else r["high"]
    out["cost"], out["audit"] = grammar.cheapest(level[0])
    out["costs"], out["audits"] = grammar.packed(level[0])
    return pa.Table.from_pylist([out], table.schema)


def _edits(turns: DataFrame, block: int, fan: int, rounds: int, rules_per_round: int) -> DataFrame:
    """``c, gaps``, the counts, ``cost, audit`` of every conversation that has turns."""
    order = ["c", "turn", "role", "h"]
    blocks = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block), BLOCK), "repair-blocks")
    distinct = stored(blocks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "repair-sequences")
    solved = stored(distinct.mapInArrow(_solve(_rules(distinct, rounds, rules_per_round)),
                                        "symbols string, cost long, audit string, costs array<long>, audits array<string>"), "repair-solved")
    wanted = ["c", *COUNTS, "low", "high", "turns", "cost", "audit"]
    # the block border splits a conversation, so its other blocks are not whole either
    inside = blocks.where("whole").join(solved.drop("costs", "audits"), "symbols").select(*wanted)
    number = F.row_number().over(Window.partitionBy("c").orderBy("part", "nth")).cast("long") - 1
    parts = stored(blocks.where("not whole").withColumn("at", number).join(solved, "symbols")
                   .select(*[f.split()[0] for f in PART.split(", ")]), "repair-parts")
    most = parts.agg(F.max("at")).first()[0] or 0
    while most:
        parts = stored(parts.withColumn("at2", F.expr(f"at div {fan}")).groupBy("c", "at2").applyInArrow(
            lambda t: _joined(t.drop(["at2"])), PART).withColumn("at", F.expr(f"at div {fan}")), "repair-parts")
        most //= fan
    every = inside.unionByName(parts.select(*wanted))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return every.select("c", gaps.alias("gaps"), *COUNTS, "cost", "audit")


class _Repair:
    """Applies the edits of one conversation to its turns, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _new_role(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _put(self, edit: str, role: str, text: str):
        self.state = grammar.NEXT[role[0]][self.state]
        return edit, role, text

    def inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._put("I", self._new_role(), "")

    def turn(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(edit, role if edit == "K" else self._new_role(), text)


def _stream(schema: pa.Schema, keep_turns: bool):
    """Conversations in order, each with its edits first -> their results."""
    def run(batches):
        out, held, missing = [], 0, object()
        now, fix, sha, n = missing, None, None, 0
        nothing = hashlib.sha256(b"").hexdigest()

        def put(turns):
            nonlocal n, held
            for edit, role, text in turns:
                if keep_turns:
                    out.append({"c": now, "position": n, "edit": edit, "role": role, "text": text})
                    held += len(text)
                else:
                    sha.update((("\n" if n else "") + f"{role}:{text}").encode("utf-8", "replace"))
                n += 1

        def close():
            if fix is not None:
                put(fix.inserted())
            if not keep_turns:
                out.append(facts | {"c": now, "repaired_sha256": sha.hexdigest() if n else nothing})

        for b in batches:
            cols = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            for i, c in enumerate(cols["c"]):
                if now is missing or c != now:
                    if now is not missing:
                        close()
                    now, fix, sha, n = c, None, hashlib.sha256(), 0
                    facts = {k: 0 for k in ("gaps", *COUNTS, "cost")} | {"audit": ""}
                if cols["kind"][i] == 0:
                    facts = {k: cols[k][i] for k in facts}
                    fix = _Repair(facts["audit"])
                else:
                    for _ in range(cols["copies"][i]):
                        put(fix.turn(cols["role"][i], cols["text"][i]))
                if len(out) >= 1000 or held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if now is not missing:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair(df: DataFrame, keep_turns: bool = False, block: int = 4096, fan: int = 64, rounds: int = 8,
           rules_per_round: int = 64, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """``id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every
    conversation, or with ``keep_turns`` its repaired turns ``id_col, position, edit, role, text``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"),
                     blank(text_col).alias("text"), (F.col(copies_col) if copies_col else F.lit(1)).cast("int").alias("copies"))
    edits = stored(_edits(_keyed(rows), block, fan, rounds, rules_per_round), "repair-edits")
    counts = F.col("copies") > 0               # of other rows only the id is needed
    turns = rows.select("c", "turn", "role", F.when(counts, F.md5(F.col("text").cast("binary"))).alias("h"),
                        F.when(counts, F.col("text")).alias("text"), "copies", F.lit(1).alias("kind"))
    both = edits.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    order = ["c", "kind", "turn", "role", "h"]
    ready = both.repartition("c").sortWithinPartitions(*order)
    longs = [(x, pa.int64()) for x in ("gaps", *COUNTS, "cost")]
    if keep_turns:
        schema = pa.schema([("c", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        spark_schema = "c long, position long, edit string, role string, text string"
    else:
        schema = pa.schema([("c", pa.int64()), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string())])
        spark_schema = "c long, " + ", ".join(f"{x} long" for x, _ in longs) + ", audit string, repaired_sha256 string"
    return ready.mapInArrow(_stream(schema, keep_turns), spark_schema).withColumnRenamed("c", id_col)
