"""Mixing sources to target weights by a splitting tree over blocks.

Targets: sources in code-point order (null last) get the weights cyclically and share all words by
weight; a target stops at ``max_repeats`` times its source's size and the excess is shared again by
weight.  With sources sorted by size / weight this has a closed form (one window over one row per
source, nothing iterates).

Drawing: a source's documents lie on a tape in hash order, epoch after epoch, and the tape is cut
into blocks of ``block_words`` words.  The mix takes the tape up to the target (a document at the
cut is in if its middle is), so a source's words differ from its target by at most half a
document.  The blocks are then dealt to the output shards by a binary splitting tree: each node
sends an exact number of its blocks, drawn without replacement in hash order, to its left
child and the rest to the right, so the composition of each child is a multivariate hypergeometric
draw and the shards take disjoint blocks.  Within a shard, documents lie in hash order.

Everything is decided by hashes of ids, texts and block numbers: reruns agree, partitioning does
not matter.  Hot sources are split into hash buckets (``running_sum``).  Null text has size 0;
null sources form one source; documents of size 0 take 0 words; repeated rows are documents of
their own; a source whose size is 0 has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, bucket_of, running_sum, stored, unit_draw


def row_keys(id_: Column, text: Column, seed: int) -> list[Column]:
    """128 bits that name a row's id and text."""
    return [F.xxhash64(F.lit(seed), id_, text).alias("key1"), F.xxhash64(text, id_, F.lit(seed)).alias("key2")]


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """``source_key, source_size, target`` from ``source_key, source, size`` rows (one row per
    source after a pre-aggregated sum; the windows run over those rows only)."""
    per = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("limit", F.lit(max_repeats) * F.col("source_size"))
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything).cast("double")
    full = F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    # the level of words per weight if all sources before this one (in fill order) are full
    per = per.withColumn("level", (total - full) / left)
    per = per.withColumn("is_full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("is_full"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    return per.select("source_key", "source_size", F.when(F.col("is_full"), F.col("limit").cast("double"))
                      .otherwise(level * F.col("weight")).alias("target"))


def split_blocks(blocks: DataFrame, shards: int, seed: int = 7, buckets: int = 256) -> DataFrame:
    """Deal ``source_key, block`` rows to shards ``0..shards-1``: adds ``shard``.

    One round per tree level.  A node with ``k`` shards and ``n`` blocks keeps the
    ``n * (k // 2) div k`` blocks of smallest hash on its left; a node of one shard is a leaf.
    Rows are ranked in hash-range buckets, never in one task."""
    level, depth = blocks.select("source_key", "block", F.lit(0).alias("lo"), F.lit(shards).alias("k")), 0
    while (1 << depth) < shards:
        draw = unit_draw(F.lit(seed), F.lit(depth), "source_key", "block")
        rows = (level.withColumn("_u", draw).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int")))
        ranked = running_sum(rows, ["lo", "k"], "_b", ["_u", "source_key", "block"], None, "_rank")
        n = rows.groupBy(F.col("lo").alias("_lo")).agg(F.count(F.lit(1)).alias("_n"))
        left = F.floor(F.col("k") / 2).cast("int")
        goes_left = F.col("_rank") < F.expr("(_n * cast(floor(k / 2) as bigint)) div k")
        level = stored(ranked.join(n, F.col("lo") == F.col("_lo")).select(
            "source_key", "block",
            F.when((F.col("k") == 1) | goes_left, F.col("lo")).otherwise(F.col("lo") + left).alias("lo"),
            F.when(F.col("k") == 1, 1).when(goes_left, left).otherwise(F.col("k") - left).cast("int").alias("k")),
            "mix-level")
        depth += 1
    return level.select("source_key", "block", F.col("lo").alias("shard"))


def mix(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, shards: int = 8, block_words: int = 65536,
        seed: int = 7, buckets: int = 512, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, copies, taken, placements`` and
    ``key1, key2`` (128 bits that name id and text).

    ``placements``: per copy taken (at most ``max_repeats``) its ``epoch``, ``block``, ``shard``
    and ``position`` key; rows of one shard sorted by ``position`` are the shuffled output."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stored(docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        *row_keys(F.col(id_col), text, seed)), "mix-rows")
    narrow = narrow.withColumn("_b", bucket_of(buckets, "key1"))
    tape = running_sum(narrow, ["source_key"], "_b", ["key1", "key2", "row"], "size", "start")
    # targets travel through the (source, bucket) rows, so no document is shuffled by its source
    targets = source_targets(narrow, weights, max_repeats)
    per_bucket = narrow.select("source_key", "_b").distinct().join(targets, "source_key")
    tape = tape.join(per_bucket, ["source_key", "_b"])
    copies = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.struct(
            e.alias("epoch"), (e * F.col("source_size") + F.col("start")).alias("at"))),
        lambda c: c["at"] + F.col("size") / 2 < F.col("target"))
    drawn = stored(tape.select("row", "id", "source_key", "size", "source_size", "target", "key1", "key2",
                               F.explode_outer(copies).alias("c"))
                   .withColumn("epoch", F.col("c.epoch"))
                   .withColumn("block", F.expr(f"c.at div {int(block_words)}L")).drop("c"), "mix-drawn")
    blocks = drawn.where(F.col("block").isNotNull()).select("source_key", "block").distinct()
    dealt = drawn.join(split_blocks(blocks, shards, seed), ["source_key", "block"], "left")
    placement = F.when(F.col("block").isNotNull(), F.struct(
        "epoch", "block", "shard", F.xxhash64(F.lit(seed), F.lit("position"), "key1", "key2", "epoch").alias("position")))
    return (dealt.groupBy("row", "id", "size", "source_size", "target", "key1", "key2")
            .agg(F.array_sort(F.collect_list(placement)).alias("placements"))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", F.size("placements").alias("copies"),
                    (F.size("placements") * F.col("size")).cast("bigint").alias("taken"), "placements", "key1", "key2"))


def mixed_documents(docs: DataFrame, mixed: DataFrame, seed: int = 7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``epoch, block, shard, position``: a row per copy taken.  Texts
    are shuffled once; rows of equal id and text are looked up once and emitted for all of them."""
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), seed)
    one = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    rows = (docs.withColumn("_k1", k1).withColumn("_k2", k2).withColumn("_nth", F.row_number().over(one))
            .where("_nth = 1").drop("_nth"))
    copies = mixed.where("copies > 0").groupBy(F.col("key1").alias("_k1"), F.col("key2").alias("_k2")).agg(
        F.flatten(F.collect_list("placements")).alias("_copies"))
    return rows.join(copies, ["_k1", "_k2"]).select(*docs.columns, F.inline("_copies"))


def shuffled_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of ``mixed_documents`` in their output order: shard by shard, shuffled within the shard."""
    return rows.repartitionByRange(shards, "shard", "position").sortWithinPartitions("shard", "position")
