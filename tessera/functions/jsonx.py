"""JSON-in-a-string-column functions: strict validity, blocks, part counts, cleaning."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import PY_WHITESPACE, _c, let, strip_long, wrap

# The field names of the CAD document (one JSON object per row) without the fields that cleaning
# removes (top-level ``final_shape`` and each part's ``description``): parsing
# with this schema prunes them for free.
POINT = "array<double>"
PRIMITIVE = (f"struct<`Start Point`: {POINT}, `Mid Point`: {POINT}, `End Point`: {POINT}, "
             f"Center: {POINT}, Radius: double>")
PART = ("struct<coordinate_system: struct<`Euler Angles`: array<double>, "
        "`Translation Vector`: array<double>>, "
        f"sketch: map<string, map<string, map<string, {PRIMITIVE}>>>, "
        "extrusion: struct<extrude_depth_towards_normal: double, "
        "extrude_depth_opposite_normal: double, sketch_scale: double, operation: string>>")
CAD_SCHEMA = f"struct<parts: map<string, {PART}>>"

# The four extrusion operations a part may use.
OPERATIONS = ["NewBodyFeatureOperation", "JoinFeatureOperation",
              "CutFeatureOperation", "IntersectFeatureOperation"]


def dedup_map(m) -> Column:
    """``from_json`` keeps repeated object keys as repeated map entries; rebuild
    the map so each key appears once, at its first place with its last value
    (as a Python dict).  Works under any map-key policy of the session."""
    def rebuilt(x):
        back = F.reverse(F.map_entries(x))
        keys = F.transform(back, lambda e: e["key"])
        return F.map_from_entries(F.transform(F.array_distinct(F.map_keys(x)), lambda k: F.struct(
            k.alias("key"), F.get(back, (F.array_position(keys, k) - 1).cast("int"))["value"].alias("value"))))
    return let(m, lambda x: F.when(F.size(F.array_distinct(F.map_keys(x))) == F.size(F.map_keys(x)), x)
               .otherwise(rebuilt(x)))


_STRICT_OPTS = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
                "allowNumericLeadingZeros": "false", "allowUnquotedControlChars": "false",
                "allowBackslashEscapingAnyCharacter": "false", "allowComments": "false"}


def is_strict_json(col) -> Column:
    """True when the text is exactly one JSON value that Python's ``json.loads``
    accepts: no trailing text, no single quotes, no leading zeros.  NaN and
    Infinity are accepted (as Python does).  Never null.

    The text is parsed inside an array and inside an object that ends with a
    marker; one text cannot close both brackets and open them again."""
    in_array = F.from_json(F.concat(F.lit("["), _c(col), F.lit("]")), "array<string>", _STRICT_OPTS)
    in_object = F.from_json(F.concat(F.lit('{"_v":'), _c(col), F.lit(',"_e":7}')),
                            "struct<_v: string, _e: int>", _STRICT_OPTS)
    return F.coalesce((F.size(in_array) == 1) & (in_object["_e"] == 7), F.lit(False))


def _one_object(text) -> Column:
    """``is_strict_json`` for a text that begins with ``{``: the same two parses, which then need not
    copy what lies between the brackets."""
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<_v: string>>", _STRICT_OPTS)
    in_object = F.from_json(F.concat(F.lit('{"_v":'), text, F.lit(',"_e":7}')), "struct<_e: int>", _STRICT_OPTS)
    return F.coalesce((F.size(in_array) == 1) & (in_object["_e"] == 7), F.lit(False))


def is_json_object(col) -> Column:
    """Strictly valid JSON whose top level is an object."""
    return F.startswith(F.ltrim(_c(col), F.lit(PY_WHITESPACE)), F.lit("{")) & _one_object(_c(col))


def json_block(col) -> Column:
    """The ``<json>…</json>`` block of a completion, whitespace-stripped; null if
    the block is absent or not a valid JSON object (X4).  ``first_tag_or_null`` by two literal splits,
    which find the tags without a step per character."""
    rest = F.get(F.split(_c(col), "<json>", 2), 1)
    block = strip_long(let(F.split(rest, "</json>", 2), lambda p: F.when(F.size(p) == 2, F.get(p, 0))))
    return let(block, lambda t: F.when(F.startswith(t, F.lit("{")) & _one_object(t), t))


def part_count(doc) -> Column:
    """Number of keys of ``doc.parts`` that start with ``part_<digits>``; 0 when
    the document is null, empty, has no ``parts`` or ``parts`` is not an object."""
    keys = F.map_keys(F.from_json(_c(doc), "struct<parts: map<string, string>>")["parts"])
    # size(null) is null (ANSI) or -1 (legacy): both become 0
    n = F.size(F.filter(F.array_distinct(keys), lambda k: k.rlike("^part_[0-9]+")))
    return F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("bigint")


def completion_part_count(completion) -> Column:
    """``count_parts(extract_json(completion))`` in one expression."""
    return part_count(json_block(completion))


def _parts_all_objects(doc) -> Column:
    parts = F.from_json(doc, "struct<parts: string>")["parts"]
    vals = F.map_values(F.from_json(parts, "map<string,string>"))
    return (parts.isNull()
            | (F.startswith(parts, F.lit("{"))
               & F.coalesce(F.forall(vals, lambda v: F.startswith(v, F.lit("{"))), F.lit(False))))


def clean_cad_json(col, schema: str = CAD_SCHEMA) -> Column:
    """Typed, lossy cleaning (X5, JVM-side): parse with the CAD schema (which leaves out
    ``final_shape`` and per-part ``description``), re-serialise compactly and
    wrap as ``<json>\\n…\\n</json>``.  Null when the text is not one JSON object
    or a part is not an object.  Numbers come back as doubles and fields outside
    the schema are dropped (semantic, not byte, equality; see ``clean_cad_json_exact``)."""
    return let(_c(col), lambda txt: F.when(
        is_json_object(txt) & _parts_all_objects(txt),
        wrap("json", F.to_json(F.from_json(txt, schema)), newline=True)))


def _clean_one(text):
    if text is None:
        return None
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(data, dict):
        return None
    data.pop("final_shape", None)
    parts = data.get("parts")
    if parts is not None:
        if not isinstance(parts, dict):
            return None
        for p in parts.values():
            if not isinstance(p, dict):
                return None
            p.pop("description", None)
    return "<json>\n" + json.dumps(data, separators=(",", ":")) + "\n</json>"


@F.pandas_udf(T.StringType())
def clean_cad_json_exact(texts: pd.Series) -> pd.Series:
    """Byte-exact cleaning with Python's json (unknown fields, key order, number
    spelling and ``\\uXXXX`` escapes kept).  Arrow-batched; use when the output
    must equal a Python re-dump."""
    return texts.map(_clean_one)
