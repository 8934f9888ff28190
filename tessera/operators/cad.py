"""Checks on the CAD document: progressive documents, loop closure, operation
values, number coverage, routing by part count.  All row-local: a document is
one row, so none of these shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import same_value
from tessera.functions.jsonx import OPERATIONS, POINT, dedup_map, json_block, part_count
from tessera.functions.text import _c, let


def part_entries(doc) -> Column:
    """``array<struct<key, value>>`` of ``doc.parts`` in document order; each
    value is the part's compact JSON text."""
    return F.map_entries(dedup_map(F.from_json(_c(doc), "struct<parts: map<string,string>>")["parts"]))


def _json_key(k) -> Column:
    j = F.to_json(F.array(k))          # ["key"] with JSON escaping
    return F.substring(j, F.lit(2), F.length(j) - F.lit(2))


def progressive_docs(df: DataFrame, completion_col: str = "completion",
                     keep=("id",)) -> DataFrame:
    """Document i = parts 1..i (R1): ``id, k, doc`` rows.  Built inside each row
    with ``transform(sequence(1, n), …)`` over the parsed part list."""
    e = part_entries(json_block(F.col(completion_col)))
    items = F.transform(e, lambda x: F.concat(_json_key(x["key"]), F.lit(":"), x["value"]))
    docs = let(items, lambda it: F.when(F.size(it) > 0, F.transform(
        F.sequence(F.lit(1), F.size(it)), lambda k: F.struct(
            k.cast("int").alias("k"),
            F.concat(F.lit('{"parts":{'), F.array_join(F.slice(it, 1, k), ","), F.lit("}}")).alias("doc")))))
    return df.select(*keep, F.explode(docs).alias("d")).select(*keep, "d.k", "d.doc")


def progressive_check(judged: DataFrame, completion_col: str = "completion",
                      keep=("id",)) -> DataFrame:
    """Does each generated ``json_i`` hold the value of progressive document i (R2; see
    ``functions.canonical``)?  The
    turns and the original completion live in the same row, so no join: the
    expected documents are built as an array next to the turn array."""
    e = part_entries(json_block(F.col(completion_col)))
    items = F.transform(e, lambda x: F.concat(_json_key(x["key"]), F.lit(":"), x["value"]))
    step = judged.select(*keep, "turns", items.alias("_items"))
    step = step.select(*keep, "turns", F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_items"), F.lit(1))),
        lambda k: F.concat(F.lit('{"parts":{'), F.array_join(F.slice("_items", 1, k), ","),
                           F.lit("}}"))).alias("_docs"), F.size("_items").alias("_n"))
    checks = F.transform(F.filter("turns", lambda t: t["turn"] <= F.col("_n")), lambda t: F.struct(
        t["turn"].cast("int").alias("turn"), t["json"].alias("json"), F.get(F.col("_docs"), t["turn"] - 1).alias("doc")))
    return step.select(*keep, F.explode(checks).alias("c")).select(*keep, "c.turn", same_value("c.json", "c.doc").alias("matches"))


def operation_check(df: DataFrame, completion_col: str = "completion", keep=("id",),
                    allowed=OPERATIONS) -> DataFrame:
    """Every part's ``extrusion.operation`` is one of the allowed values."""
    parsed = F.from_json(json_block(F.col(completion_col)),
                         "struct<parts: map<string, struct<extrusion: struct<operation: string>>>>")
    ops = F.transform(F.map_values(dedup_map(parsed["parts"])), lambda p: p["extrusion"]["operation"])
    ok = F.filter(ops, lambda o: F.coalesce(o.isin(*allowed), F.lit(False)))
    return df.select(*keep, F.coalesce(F.size(ops), F.lit(0)).cast("bigint").alias("n_parts"),
                     F.coalesce(F.size(ok), F.lit(0)).cast("bigint").alias("n_valid_ops"),
                     F.coalesce(F.size(ops) == F.size(ok), F.lit(True)).alias("all_valid"))


NUMBER_PATTERN = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
STRING_PATTERN = r'"(?:[^"\\]|\\.)*"'


def numbers(col) -> Column:
    """Distinct numbers in a text, as doubles."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(col), F.lit(NUMBER_PATTERN), 0),
                                        lambda s: s.try_cast("double")))


def json_numbers(col) -> Column:
    """Distinct number values of a JSON text: keys and string values do not count."""
    return numbers(F.regexp_replace(_c(col), F.lit(STRING_PATTERN), F.lit('""')))


def number_coverage(df: DataFrame, json_col, text_col, keep=("id",)) -> DataFrame:
    """How many distinct number values of the JSON also appear in the text."""
    return (df.select(*keep, json_numbers(json_col).alias("_jn"), numbers(text_col).alias("_tn"))
              .select(*keep, F.size("_jn").cast("bigint").alias("n_json_numbers"),
                      F.size(F.array_intersect("_jn", "_tn")).cast("bigint").alias("n_covered")))


def loop_closure(df: DataFrame, completion_col: str = "completion", keep=("id",)) -> DataFrame:
    """Per ``(part, face, loop)``: the end of each segment is the start of the
    next, the last end is the first start; a loop that is one circle is closed
    (R3).  Primitives are ordered by the number in their key (``line_10``
    after ``line_9``).  Row-local higher-order functions, no window."""
    prim = f"struct<`Start Point`: {POINT}, `End Point`: {POINT}, Center: {POINT}, Radius: double>"
    schema = f"struct<parts: map<string, struct<sketch: map<string, map<string, map<string, {prim}>>>>>>"
    parsed = F.from_json(json_block(F.col(completion_col)), schema)
    rows = (df.select(*keep, F.explode(dedup_map(parsed["parts"])).alias("part", "p"))
              .select(*keep, "part", F.explode("p.sketch").alias("face", "f"))
              .select(*keep, "part", "face", F.explode("f").alias("loop", "l")))
    prims = F.array_sort(
        F.transform(F.map_entries("l"), lambda e: F.struct(
            F.regexp_extract(e["key"], r"([0-9]+)$", 1).try_cast("bigint").alias("n"),
            e["key"].alias("key"), e["value"].alias("v"))),
        lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
    segs = F.filter(prims, lambda p: ~F.startswith(p["key"], F.lit("circle")))
    ends = F.transform(segs, lambda p: F.struct(p["v"]["Start Point"].alias("start"), p["v"]["End Point"].alias("end")))

    def is_closed(s):
        # each end against the start of the next segment: the list beside its rotation
        turned = F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.slice(s, 1, 1))
        same = F.zip_with(s, turned, lambda a, b: F.coalesce(a["end"] == b["start"], F.lit(False)))
        return F.coalesce(F.forall(same, lambda x: x), F.lit(False))

    return rows.select(*keep, "part", "face", "loop", F.size("l").cast("bigint").alias("n_prims"),
                       let(ends, is_closed).alias("closed"))


def route_by_parts(df: DataFrame, lang_col: str = "lang", completion_col: str = "completion"
                   ) -> DataFrame:
    """Split name ``{lang}_part_{k}`` from the part count."""
    k = part_count(json_block(F.col(completion_col)))
    return df.withColumn("part_count", k).withColumn(
        "split", F.concat(F.col(lang_col), F.lit("_part_"), k.cast("string")))


__all__ = ["part_entries", "progressive_docs", "progressive_check", "operation_check",
           "number_coverage", "loop_closure", "route_by_parts", "numbers",
           "json_numbers"]
