"""Hierarchical weighted hash tree: region, rack, shard.

At each level a key draws one child by weighted rendezvous: child ``c`` of weight ``w`` gets the
draw ``-ln(u(key, c)) / w`` with ``u`` a hash of key and child, and the smallest draw wins, so a
child is taken with probability ``w / sum(w)``.  A node's weight is the sum of its shards' weights.
If the weight of one subtree grows, its draws shrink and all others stay: keys move only into that
subtree (and, if it shrinks, only out of it).  ``grow`` adds a shard as a region of its own, so
the only subtree that changes is the new shard: it alone receives keys, 1/(n+1) of them.

The place of a key depends on the key and the tree only.  A null key has one fixed place.  Slots
are dense within each shard; they are numbered in hash buckets (see ``running_sum``) so a shard is
never one task.  Repeated rows each get a slot of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, running_sum, unit_draw


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` set) or an inner node with children."""
    name: str
    weight: float
    shard: int | None = None
    children: tuple["Node", ...] = ()


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), None, tuple(children))


def even_tree(n: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> Node:
    """``n`` shards of weight 1 dealt in order to racks and the racks to regions."""
    racks = [inner(f"rack{i}", [Node(f"shard{s}", 1.0, s) for s in range(a, min(a + shards_per_rack, n))])
             for i, a in enumerate(range(0, n, shards_per_rack))]
    return inner("root", [inner(f"region{i}", racks[a:a + racks_per_region])
                          for i, a in enumerate(range(0, len(racks), racks_per_region))])


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and region of its own."""
    new = inner(f"region+{shard}", [inner(f"rack+{shard}", [Node(f"shard{shard}", weight, shard)])])
    return inner(tree.name, [*tree.children, new])


def place(key: Column, node: Node) -> Column:
    """The shard of ``key``: one weighted draw per level on the way down."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return place(key, live[0])
    draws = F.array(*[F.struct((-F.log(unit_draw(key, F.lit(c.name))) / F.lit(float(c.weight))).alias("d"),
                               F.lit(i).alias("i")) for i, c in enumerate(live)])
    pick = F.array_min(draws)["i"]
    out = F.when(pick == 0, place(key, live[0]))
    for i, c in enumerate(live[1:], start=1):
        out = out.when(pick == i, place(key, c))
    return out


def shard_rows(df: DataFrame, tree: Node, grown: Node | None = None, key_col: str = "doc_id",
               text_col: str = "text", buckets: int = 512) -> DataFrame:
    """``key_col, size, text_crc32, shard, slot, grown_shard`` for every row.

    ``size``: UTF-8 bytes of the text (null: none) plus 1.  ``slot``: gapless from 0 within the
    shard.  ``grown_shard``: the place under ``grown`` (null without it)."""
    key, text = F.col(key_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        key, (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    rows = rows.withColumn("_b", bucket_of(buckets, key_col, "text_crc32", "size"))
    order = [F.xxhash64(key_col, "text_crc32"), key_col, "size", "text_crc32"]
    return running_sum(rows, ["shard"], "_b", order, None, "slot").select(
        key_col, "size", "text_crc32", "shard", "slot", "grown_shard")
