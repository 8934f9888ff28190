"""Canonical JSON against Python's reading."""

import json

import pytest

from tessera.functions import canonical

SAME = [('{"a":1,"a":2}', '{"a":2}'), ("NaN", " NaN "), ("1e2", "100"), ("100.0", "1E+2"), ('{"b":1,"a":[1.50]}', '{"a": [1.5], "b": 1}'),
        ('"\\u0041\\u00e9"', '"Aé"'), ("-0.0", "0"), ("1e22", "10000000000000000000000"), ('{"x":{"k":1,"k":{"z":1}}}', '{"x":{"k":{"z":1.0}}}'),
        ("Infinity", "Infinity"), ('""', '""'), ("[]", "[ ]"), ("0.1", "1e-1")]
DIFFERENT = [("1", "true"), ("1", '"1"'), ("NaN", "null"), ("9007199254740993", "9007199254740992"), ("[1,2]", "[2,1]"), ("{}", "[]"),
             ("{'a':1}", "{'a':1}"), ("01", "01"), ("", ""), (None, None), (None, "1"), ("1 2", "1 2"), ("-Infinity", "Infinity"),
             ("[" * 5000 + "]" * 5000, "[" * 5000 + " " + "]" * 5000)]


def test_same_value(spark):
    rows = [(a, b, True) for a, b in SAME] + [(b, a, True) for a, b in SAME] + [(a, b, False) for a, b in DIFFERENT]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("a", "b", "want", canonical.same_value("a", "b").alias("got"), canonical.json_digest("a").alias("d"),
                    canonical.json_digest("b").alias("e")).collect()
    for r in got:
        assert r["got"] == r["want"], (r["a"], r["b"])
        assert (r["d"] is not None and r["d"] == r["e"]) == r["want"], (r["a"], r["b"])


@pytest.mark.parametrize("a,_", SAME)
def test_canonical_text_is_json_and_stays_itself(a, _):
    c = canonical.canonical_text(a)
    assert canonical.canonical_text(c) == c
    x, y = json.loads(a), json.loads(c)
    assert x == y or x != x
