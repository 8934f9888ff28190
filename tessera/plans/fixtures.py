"""Inputs derived by Spark from the driver tables.

The reference's own data (CAD text/JSON pairs, model answers) is not shipped,
so its shapes are rebuilt from the given tables: ``documents`` become tagged
answers and stage-1 rows, ``lineitem`` becomes one CAD document per order with
one part per line, and a deterministic stand-in model turns batched requests
into answers.  Every row of every table is used; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.jsonx import OPERATIONS
from tessera.functions.text import let
from tessera.operators.position import input_partitions, with_batches, with_ord



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged_answer() -> F.Column:
    """Model-style answer with tags for a ``documents`` row, five shapes by id."""
    m = F.col("doc_id") % 5
    n = F.col("n_chars").cast("string")
    answer = (F.when(m == 0, F.concat(F.lit("<description>\n"), "text", F.lit("\n</description>")))
              .when(m == 1, F.concat(F.lit("<valid> Yes </valid><description>"), "text",
                                     F.lit("</description><think> "), "lang",
                                     F.lit(' </think><json>{"n":'), n, F.lit("}</json>")))
              .when(m == 2, F.concat(F.lit('<valid>No</valid><think></think><json>{"n":'), n,
                                     F.lit(" x</json>")))
              .when(m == 3, F.lit("<think>a</think><think>b</think>"))
              .otherwise(F.col("text")))
    return answer


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, answer``."""
    return table(spark, sf_dir, "documents").select("doc_id", tagged_answer().alias("answer"))


def stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, prompt, completion``: prompts from ``tagged``, CAD-like JSON
    completions (valid, broken, non-object, multi-part) by id."""
    t = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 4
    depth = (F.col("n_chars") % 7).cast("string")
    completion = (
        F.when(m == 0, F.concat(
            F.lit('{"final_shape":"s","parts":{"part_1":{"extrusion":{"extrude_depth_towards_normal":'),
            depth, F.lit('.5,"operation":"NewBodyFeatureOperation"},"description":{"shape":"x"}}}}')))
        .when(m == 1, F.lit('{"parts":'))
        .when(m == 2, F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")))
        .otherwise(F.lit('{"parts":{"part_1":{"extrusion":{"operation":"JoinFeatureOperation"}},'
                         '"part_2":{"extrusion":{"sketch_scale":0.25,"operation":"CutFeatureOperation"}}}}')))
    return t.select("doc_id", tagged_answer().alias("prompt"), completion.alias("completion"))


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, description, reasoning, completion, split`` (reasoning output)."""
    from tessera.functions.text import description_block, first_tag, first_tag_or_null
    t = tagged(spark, sf_dir)
    a = F.col("answer")
    return t.select(
        "doc_id", description_block(a).alias("description"),
        F.concat(F.lit("<think>"), F.coalesce(first_tag_or_null(a, "think"), F.lit("")),
                 F.lit("</think>")).alias("reasoning"),
        F.concat(F.lit("<json>\n"), first_tag(a, "json"), F.lit("\n</json>")).alias("completion"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("test")).otherwise(F.lit("en_vi")).alias("split"))


def _op(linenumber) -> F.Column:
    m = linenumber % 4
    return (F.when(m == 1, F.lit(OPERATIONS[0])).when(m == 2, F.lit(OPERATIONS[1]))
            .when(m == 3, F.lit(OPERATIONS[2])).otherwise(F.lit(OPERATIONS[3])))


def cad_items(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """``id, items``: per order, its lines as parts in a total order
    (``array<struct<k, q, op, s>>``, ``s`` = the part's JSON member text).
    One shuffle by order key; a group is one order's lines.  The rows are
    hash-partitioned by the key first: ``collect_list`` keeps every row, so a
    map-side partial aggregate would only add a sort, and the grouping below
    reuses this partitioning (no second exchange).  ``ranged``: partitioned by
    ranges of the key instead, for ``with_ord(..., ranged=True)``."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id").select(
        "id", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    li = li.repartitionByRange(input_partitions(li), "id") if ranged else li.repartition("id")
    g = li.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        F.col("l_quantity").cast("bigint").alias("q"), _op(F.col("l_linenumber")).alias("op")))
    ).alias("lines"))
    items = F.transform("lines", lambda x, i: F.struct(
        (i + 1).alias("k"), x["q"].alias("q"), x["op"].alias("op"),
        F.concat(F.lit('"part_'), (i + 1).cast("string"),
                 F.lit('":{"extrusion":{"extrude_depth_towards_normal":'), x["q"].cast("string"),
                 F.lit(',"operation":"'), x["op"], F.lit('"},"description":{"shape":""}}')).alias("s")))
    return g.select("id", items.alias("items"))


def cad_items_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cad_items`` numbered in id order: the lines are exchanged once, by ranges of the order key."""
    return with_ord(cad_items(spark, sf_dir, ranged=True), "id", ranged=True)


def with_completion(items: DataFrame) -> DataFrame:
    """Add the document text ``completion`` and part count ``n`` to ``items``."""
    completion = F.concat(F.lit('<json>\n{"final_shape":"","parts":{'),
                          F.array_join(F.col("items.s"), ","), F.lit("}}\n</json>"))
    return items.withColumn("completion", completion).withColumn(
        "n", F.size("items").cast("bigint"))


def cad_from_items(items: DataFrame) -> DataFrame:
    return with_completion(items).select("id", "completion", "n")


def cad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, completion, n``: one CAD document per order."""
    return cad_from_items(cad_items(spark, sf_dir))


def damage(df: DataFrame) -> DataFrame:
    """Truncated, untagged and trailing-text documents by id."""
    c, i = F.col("completion"), F.col("id")
    out = (F.when(i % 11 == 0, F.concat(F.expr("substr(completion, 1, length(completion) - 20)"),
                                        F.lit("</json>")))
           .when(i % 13 == 0, F.expr("substr(completion, 8, length(completion) - 15)"))
           .when(i % 17 == 0, F.replace(c, F.lit("</json>"), F.lit("x</json>")))
           .otherwise(c))
    return df.withColumn("completion", out)


def cad_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage(cad(spark, sf_dir)).select("id", "completion")


def stand_in_model(batched_items: DataFrame) -> DataFrame:
    """A deterministic stand-in for the model: answers ``(batch_id, response)``
    for batched rows ``batch_id, pos, id, items``.  Answers follow the
    progressive rule (turn k carries parts 1..k); by id some rows get a blank
    think, a blank prompt or no sample at all, and every ninth batch gets no
    response."""
    i, n = F.col("id"), F.size("items")
    docs = let(F.col("items.s"), lambda parts: F.transform("items", lambda x, j: F.concat(
        F.lit('{"parts":{'), F.array_join(F.slice(parts, 1, j + 1), ","), F.lit("}}"))))
    # zipped, not looked up: inside the lambda all of ``docs`` would be built anew for every turn
    turns = F.zip_with("items", docs, lambda x, doc: F.concat(
        F.lit("<json_"), x["k"].cast("string"), F.lit(">"), doc, F.lit("</json_"),
        x["k"].cast("string"), F.lit(">\n<prompt_"), x["k"].cast("string"), F.lit(">"),
        F.when((i % 7 == 1) & (x["k"] == n), F.lit(" ")).otherwise(F.concat(F.lit("add "), x["op"])),
        F.lit("</prompt_"), x["k"].cast("string"), F.lit(">"),
        F.when((i % 7 == 0) & (x["k"] == 1), F.lit("")).otherwise(F.concat(
            F.lit("<think_"), x["k"].cast("string"), F.lit("> depth "), x["q"].cast("string"),
            F.lit(" </think_"), x["k"].cast("string"), F.lit(">")))))
    pos = F.col("pos").cast("string")
    block = F.when(i % 7 != 2, F.concat(F.lit("<sample_"), pos, F.lit(">\n"),
                                        F.array_join(turns, "\n"), F.lit("\n</sample_"), pos,
                                        F.lit(">")))
    # the items travel, not the blocks, which are several times as long
    g = (batched_items.select("batch_id", "pos", "id", "items").repartition("batch_id")
         .select("batch_id", "pos", block.alias("block"))
         .groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b")))
    resp = F.when(F.col("batch_id") % 9 == 8, F.lit(None).cast("string")).otherwise(
        F.array_join(F.transform("b", lambda x: x["block"]), "\n"))
    return g.select("batch_id", resp.alias("response"))


def batched_cad(spark: SparkSession, sf_dir: str, batch_size: int = 4) -> DataFrame:
    """``id, completion, n, items, ord, batch_id, pos`` — cad in id order."""
    return with_batches(with_completion(cad_items_ord(spark, sf_dir)), batch_size)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, system, prompt, completion``: every user turn with the assistant turn after it
    (null if unanswered) and the system text of its conversation (null if there is none); an
    assistant turn that answers no user turn is a pair without prompt.  Every row of the table is
    in a pair.  The rows of a conversation are grouped once (a conversation is one example)."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    role = lambda r: F.filter("t", lambda x: x["role"] == r)
    pair = lambda turn, u, a: F.struct(turn.alias("turn"), u.alias("prompt"), a.alias("completion"))
    asked = F.transform("u", lambda u: pair(u["turn"], u["text"], F.get(F.filter(
        "a", lambda a: a["turn"] == u["turn"] + 1), 0)["text"]))
    unasked = F.transform(F.filter("a", lambda a: ~F.exists("u", lambda u: u["turn"] + 1 == a["turn"])),
                          lambda a: pair(a["turn"], F.lit(None).cast("string"), a["text"]))
    system = F.when(F.size(role("system")) > 0, F.array_join(F.transform(role("system"), lambda x: x["text"]), "\n"))
    g = g.select("conv_id", system.alias("system"), role("user").alias("u"), role("assistant").alias("a"))
    return g.select("conv_id", "system", F.inline_outer(F.concat(asked, unasked)))


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, completion``: one sketch loop per order, one line per order line
    from point ``[k, q_k]`` to the next point, the last line back to the first
    (left open by one unit when ``id % 3 = 0``); every fifth order has a second
    loop holding one circle.  Keys are written last-first so that ordering by
    the key number matters (``line_10`` after ``line_9``)."""
    it = cad_items(spark, sf_dir)
    n = F.size("items")

    def pt(x, y):
        return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))

    first = F.get(F.col("items"), 0)
    lines = F.transform("items", lambda x, j: F.concat(
        F.lit('"line_'), x["k"].cast("string"), F.lit('":{"Start Point":'), pt(x["k"], x["q"]),
        F.lit(',"End Point":'),
        F.when(j + 1 < n, pt(F.get(F.col("items"), j + 1)["k"], F.get(F.col("items"), j + 1)["q"]))
         .when(F.col("id") % 3 == 0, pt(F.lit(1), first["q"] + 1))
         .otherwise(pt(F.lit(1), first["q"])),
        F.lit("}")))
    circle = F.when(F.col("id") % 5 == 0,
                    F.lit(',"loop_2":{"circle_1":{"Center":[0.5,0.5],"Radius":0.25}}')).otherwise(F.lit(""))
    doc = F.concat(F.lit('<json>\n{"parts":{"part_1":{"sketch":{"face_1":{"loop_1":{'),
                   F.array_join(F.reverse(lines), ","), F.lit("}"), circle, F.lit("}}}}}\n</json>"))
    return it.select("id", doc.alias("completion"))


def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, a, b``: two flat JSON texts per document, equal in value or not: repeated keys, other
    key orders, blanks, number spellings, NaN, escapes and big numbers, by id."""
    n, m = F.col("n_chars").cast("string"), F.col("doc_id") % 10
    lang, key = F.concat(F.lit('"'), "lang", F.lit('"')), F.col("doc_id").cast("string")
    text = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    a = (F.when(m == 0, text('{"k1":1,"k2":', lang, ',"k1":', n, "}")).when(m == 1, text('{"k1":NaN,"k2":', n, "}"))
         .when(m == 2, text('{"k1":', n, 'e2,"k2":', lang, "}")).when(m == 3, text('{"k2":', lang, ',"k1":', n, "}"))
         .when(m == 4, text('{"k1":', n, ".0}")).when(m == 5, text('{"k1":"', n, '"}'))
         .when(m == 6, text('{"k1":', n, ',"k2":-0.0}')).when(m == 7, text('{"k1":', key, ',"k1":', n, "}"))
         .when(m == 8, text('{"k1":"\\u0041', n, '"}')).otherwise(text('{"k1":', n, "")))
    b = (F.when(m == 0, text('{"k1":', n, ',"k2":', lang, "}")).when(m == 1, text('{ "k2":', n, ', "k1":NaN}'))
         .when(m == 2, text('{"k1":', n, '00,"k2":', lang, "}")).when(m == 3, text('{"k1":', n, ',"k2":', lang, "}"))
         .when(m == 4, text('{"k1":', n, "}")).when(m == 5, text('{"k1":', n, "}"))
         .when(m == 6, text('{"k1":', n, ',"k2":0}')).when(m == 7, text('{"k1":', n, ',"k1":', key, "}"))
         .when(m == 8, text('{"k1":"A', n, '"}')).otherwise(text('{"k1":', n, "")))
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"))
