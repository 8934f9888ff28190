"""The trie of all conversation prefixes, by ROLLUP over positional turn columns.

1. Turns are replaced by digests and word counts; texts are not moved.  Conversations are written as
   blocks of ``WIDTH`` columns, one per position; a block is keyed by the node that the block before
   it ends in (a digest chained over all turns so far), so conversations of any length are one table
   and need no rounds.  Conversations stream through this step one batch at a time.
2. ``GROUP BY key, ROLLUP (t1, ..., t8)`` aggregates all prefixes at once; ``grouping_id()`` tells the
   depth.  Hot prefixes are aggregated before the shuffle.
3. What belongs to subtrees is counted by members, so it needs no walk from the leaves up.  Each node
   is charged to its smallest member; such nodes are the last part of that member's path.  ``shared``
   is the words of the path before that part: what the member saves.  Over the members of a node
   other than its smallest, the words saved below its top are the sum of ``shared`` less the words
   above the top, and its leaves are the members that are the smallest of a childless node.  A second
   ROLLUP sums these.
4. The ids that end in a node are joined to digits in sorted stretches first, then hashed as a stream.

Null role or text is empty; a null turn number comes first; turns of one number are ordered by digest.
Rows without a conversation id belong to no conversation.  Repeated rows are turns of their own.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored

WIDTH = 8
ROOT = ""                      # key of the textless root
SALTS = 32


def _step(key: str, turn: str) -> str:
    return hashlib.md5((key + turn).encode()).hexdigest()


def _turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``c, turn, t, w``: digest and words of each turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = part(role_col), part(text_col)
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return df.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"),
                     F.md5(named.cast("binary")).alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w")
                     ).where("c is not null")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Rows ``c, kind, n, turn, t, w``: the first ``h`` turns of conversation ``c - c % family`` (kind
    0), then the turns of ``c`` itself (kind 1), of which the first ``h`` (column ``skip``) are to be left
    out; ``h = crc32(c) % most``."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    first = Window.partitionBy("c").orderBy("turn", "t")
    heads = (turns.where(F.col("c") % family == 0).withColumn("n", F.row_number().over(first)).where(F.col("n") < most)
             .select(F.col("c").alias("base"), "n", "t", "w"))
    # at most 2 * family - 1 conversations per base
    others = turns.where(F.col("c") % family != 0).select("c").distinct().withColumn("h", h).withColumn(
        "base", F.col("c") - F.col("c") % family)
    taken = others.join(heads, "base").where("n <= h").select(
        "c", F.lit(0).alias("kind"), "n", F.lit(None).cast("long").alias("turn"), "t", "w", F.lit(0).alias("skip"))
    own = turns.select("c", F.lit(1).alias("kind"), F.lit(0).alias("n"), "turn", "t", "w",
                       F.when(F.col("c") % family == 0, 0).otherwise(h).alias("skip"))
    return taken.unionByName(own)


def _blocks(width: int):
    """Turns in order of conversations -> blocks of ``width`` positions and, for the last, the end."""
    item = pa.struct([("t", pa.string()), ("w", pa.int64())])
    schema = pa.schema([("c", pa.int64()), ("block", pa.int64()), ("key", pa.string()), ("above", pa.int64()), ("words", pa.int64()),
                        ("end", pa.string()), *[(f"t{i}", item) for i in range(1, width + 1)]])

    def run(batches):
        out, now = [], None

        def block(last: bool):
            row = {"c": now, "block": nth, "key": key, "above": above, "words": words, "end": chain if last else None}
            out.append(row | {f"t{i}": x for i, x in enumerate(held, 1)})

        for b in batches:
            for c, kind, t, w, skip in zip(*[b.column(b.schema.get_field_index(x)).to_pylist() for x in ("c", "kind", "t", "w", "skip")]):
                if c != now:
                    if now is not None:
                        block(True)
                    now, nth, key, chain, above, words, held, own = c, 0, ROOT, ROOT, 0, 0, [], 0
                own += kind
                if kind and own <= skip:
                    continue
                if len(held) == width:
                    block(False)
                    nth, key, above, held = nth + 1, chain, words, []
                held.append({"t": t, "w": w})
                chain, words = _step(chain, t), words + w
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            block(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run, ("c long, block long, key string, above long, words long, end string, "
                 + ", ".join(f"t{i} struct<t: string, w: long>" for i in range(1, width + 1)))


def _rollup(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """One row per prefix of the blocks under each key: ``block, key, level, above``, its turns and ``sums``."""
    columns = ", ".join(f"t{i}" for i in range(1, width + 1))
    blocks.createOrReplaceTempView("conversation_blocks")
    try:
        # a grouping id has one bit for each column that is rolled up
        out = blocks.sparkSession.sql(
            f"SELECT block, key, {columns}, {width} - bit_count(grouping_id()) AS level, max(above) AS above, {sums} "
            f"FROM conversation_blocks GROUP BY block, key, ROLLUP ({columns})")
    finally:
        blocks.sparkSession.catalog.dropTempView("conversation_blocks")
    # prefixes longer than the conversation, and the start of a later block (the node it is keyed by), go
    turns = F.array(*[f"t{i}" for i in range(1, width + 1)])
    out = out.withColumn("top", F.get(turns, F.col("level") - 1))
    return out.where("(level = 0 and block = 0) or (level > 0 and top is not null)")


def _named(rows: DataFrame, width: int) -> DataFrame:
    """Add ``node, parent`` (keys), ``depth, w`` and ``above`` (words before the node's own turn)."""
    # one column at a time, so no expression holds another a second time
    out = rows.withColumn("key0", F.col("key"))
    for i in range(1, width + 1):
        out = out.withColumn(f"key{i}", F.when(F.col("level") >= i, F.md5(F.concat(f"key{i - 1}", f"t{i}.t").cast("binary"))))
    chain = F.array(*[f"key{i}" for i in range(width + 1)])
    words = F.aggregate(F.slice(F.array(*[F.col(f"t{i}.w") for i in range(1, width + 1)]), 1, F.greatest(F.col("level") - 1, F.lit(0))),
                        F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0)))
    return (out.withColumn("node", F.get(chain, F.col("level"))).withColumn("parent", F.get(chain, F.col("level") - 1))
            .withColumn("depth", F.col("block") * width + F.col("level")).withColumn("over", F.col("above") + words)
            .drop("key", "above", "level", "block", "top", *[f"key{i}" for i in range(width + 1)], *[f"t{i}" for i in range(1, width + 1)]))


def _joined_ids(limit: int = 1 << 16):
    """Sorted ``node, c`` -> stretches of a node's ids as text, at most ``limit`` characters."""
    def run(batches):
        out, now, ids, size = [], None, [], 0

        def close():
            out.append({"node": now, "c": ids[0], "ids": ",".join(map(str, ids))})

        schema = pa.schema([("node", pa.string()), ("c", pa.int64()), ("ids", pa.string())])
        for b in batches:
            for node, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node != now or size > limit:
                    if ids:
                        close()
                    now, ids, size = node, [], 0
                ids.append(c)
                size += 20
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if ids:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _hashed(batches):
    """Sorted stretches of each node -> the SHA-256 of all its ids."""
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    now, sha, out = None, None, []
    for b in batches:
        for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if node != now:
                if now is not None:
                    out.append({"node": now, "ends_sha256": sha.hexdigest()})
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        out.append({"node": now, "ends_sha256": sha.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def prefix_trie(df: DataFrame, family: int = 20, most: int = 4, width: int = WIDTH, id_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and
    ``node, parent`` (keys) of every node of the trie of rebuilt conversations."""
    rows = rebuilt(_turns(df, id_col, turn_col, role_col, text_col), family, most)
    to_blocks, block_schema = _blocks(width)
    blocks = stored(rows.repartition("c").sortWithinPartitions("c", "kind", "n", "turn", "t").mapInArrow(to_blocks, block_schema),
                    "trie-blocks")
    nodes = stored(_named(_rollup(blocks, width, "count(*) AS n_convs, min(c) AS conv_id"), width), "trie-nodes")
    children = stored(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.max("conv_id").alias("last_child")), "trie-children")
    # per conversation: the words it shares with smaller ones, and whether it is the smallest of a childless node
    childless = nodes.join(children, "node", "left_anti").select(F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("leaf"))
    starts = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("over").alias("shared"))
    facts = stored(starts.join(childless, "c", "left"), "trie-members")
    total = blocks.where("end is not null").select("c", "words")
    member = stored(total.join(facts, "c", "left").select(
        "c", F.coalesce("shared", "words").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-members")
    again = blocks.drop("words", "end").join(member, "c")
    sums = _named(_rollup(again, width, "count(*) AS n_convs, min(c) AS conv_id, sum(shared) AS shared, "
                                        "min(shared) AS least, sum(leaf) AS n_leaves"), width)

    order = ["node", "c"]
    ends = blocks.where("end is not null").select(F.col("end").alias("node"), "c")
    stretches = stored(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _joined_ids(), "node string, c long, ids string"), "trie-ends")
    ends = stretches.repartition("node").sortWithinPartitions(*order).mapInArrow(_hashed, "node string, ends_sha256 string")

    # most parents have the smallest member of their only child; the others' children are salted, as they may be many
    others = stored(children.join(nodes.select("node", "conv_id"), "node").where("last_child <> conv_id"), "trie-parents").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    saved = F.col("shared") - F.col("least") - (F.col("n_convs") - 1) * F.col("over")
    out = (sums.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
           .join(others, ["parent", "salt"], "left").join(children.drop("last_child"), "node", "left").join(ends, "node", "left"))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("parent").isNotNull(), F.coalesce("parent_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "node", "parent")
