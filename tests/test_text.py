"""Tag extraction and strip against Python's re/str semantics."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as tx

NBSP = "\u00a0"
CASES = ["a", "<think></think>", "<think> x </think>", "<think>a\nb</think>",
         "<think>1</think><think>2</think>", "<think>open", f"<think>{NBSP}x</think>",
         "</think><think>z</think>", "<think><think>q</think>", "", "<think>\u3000y\u2028</think>"]


def py_x2(t):
    m = re.findall(r"<think>(.*?)</think>", t, re.DOTALL)
    return m[0] if m else None


def py_x1(t):
    m = re.findall(r"<think>(.*?)</think>", t, re.DOTALL)
    return m[0].strip() if m else ""


def test_first_tag_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    rows = df.select("i", tx.first_tag_or_null("t", "think").alias("x2"),
                     tx.first_tag("t", "think").alias("x1")).orderBy("i").collect()
    for r in rows:
        assert r.x2 == py_x2(CASES[r.i]), CASES[r.i]
        assert r.x1 == py_x1(CASES[r.i]), CASES[r.i]


def test_fixture_table_x1_x2(spark):
    # FIXTURES §2 edge rows
    df = spark.createDataFrame([("a",), ("<think></think>",), ("<think> x </think>",)], "t string")
    got = [(r.a, r.b) for r in df.select(tx.first_tag("t", "think").alias("a"),
                                         tx.first_tag_or_null("t", "think").alias("b")).collect()]
    assert got == [("", None), ("", ""), ("x", " x ")]


def test_strip_is_python_strip(spark):
    ws = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    vals = [ws + "a b" + ws, " \t\n", "x", "\x1c\x1fy\x85"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(tx.strip("v")).collect()] == [v.strip() for v in vals]


def test_description_block(spark):
    vals = ["p<description> x \n</description>q", "no tags", "<description></description>"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tx.description_block(F.col("v"))).collect()]
    assert got == ["<description>x</description>", "no tags", "<description></description>"]


def test_numbered_tag_with_column_tag(spark):
    resp = "<sample_1>\n a \n</sample_1>\n<sample_2>b</sample_2>"
    df = spark.createDataFrame([(resp, 1), (resp, 2), (resp, 3)], "r string, pos int")
    got = [r[0] for r in df.select(tx.numbered_tag(F.col("r"), "sample", F.col("pos"))).collect()]
    assert got == ["a", "b", None]


def _random_text(rng):
    atoms = ["<json_1>", "</json_1>", "<think_1>", "</think_1>", "<json_2>", "</json_2>",
             "<json_12>", "x", " ", "\n", "é", "<", ">", "json_1"]
    return "".join(rng.choice(atoms) for _ in range(rng.randint(0, 14)))


def test_tag_tokens_equal_search(spark):
    rng = random.Random(7)
    texts = [_random_text(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tags, pieces = tx.tag_tokens(F.col("t"), ["json", "think"])
    df = df.withColumn("_t", tags).withColumn("_p", pieces)
    out = df.select("i", *[tx.tag_from_tokens("_t", "_p", n).alias(n) for n in
                           ("json_1", "think_1", "json_2", "json_12")]).collect()
    for r in out:
        for n in ("json_1", "think_1", "json_2", "json_12"):
            m = re.search(rf"<{n}>(.*?)</{n}>", texts[r.i], re.DOTALL)
            assert r[n] == (m.group(1) if m else None), (texts[r.i], n)


def test_basename_no_ext(spark):
    vals = ["x/failed_ids_d_s_0_t.json", "mine.json", "a/b.c.d", "plain"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tx.basename_no_ext(F.col("v"))).collect()]
    assert got == ["failed_ids_d_s_0_t", "mine", "b.c", "plain"]


def test_strip_long_and_blank_as_python(spark):
    texts = [None, "", " ", "a", " a", "a ", "\u3000\u2028a b\x85\n", "\x1c\x1f", "a\u200b", "\u200b", "é ", " 語"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, r.b) for r in df.select("i", tx.strip_long("t").alias("s"), tx.is_blank("t").alias("b")).collect()}
    assert got == {i: (None if t is None else t.strip(), not (t or "").strip()) for i, t in enumerate(texts)}


def test_strip_long_cuts_the_last_byte_as_python(spark):
    ends = [c + "x" + c + d for c in tx.PY_WHITESPACE for d in ("", "\n", " ", "\n ")]
    texts = [None, "", "\n", " \n", "a\n", "é\n", "\U0001F600 ", "a\x7f\n", "\u200b\n", *ends]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert all(r.s == (None if r.x is None else r.x.strip()) for r in df.select("x", tx.strip_long("x").alias("s")).collect())
    # one line feed after visible text is the common end of a block: it no longer goes to btrim
    plan = df.select(tx.strip_long("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan


def test_first_blocks_equal_a_search_in_each_text():
    """Tags are found in the bytes of all texts at once (F1, F2 of round 4): none reaches over the end of a text."""
    import re
    import pyarrow as pa
    texts = ["x<json_1>a</json_", "1><json_1>", "</json_1> b", None, "", "<json_2> <json_1>\xa0\U0001f600</json_2></json_1></json_1>",
             "<json_01>z</json_01><json_12>\n</json_12><json_13>y</json_13><json_99999999999>q</json_99999999999>", "<think_1>t<json_1></think_1>"]
    names = ["think", "json"]
    want = [(r, f, i, m[1].strip()) for r, t in enumerate(texts) for f, n in enumerate(names) for i in range(1, 13)
            if (m := re.search(f"<{n}_{i}>(.*?)</{n}_{i}>", t or "", re.S))]
    for kind in (pa.string(), pa.large_string()):
        row, field, number, content = tx.first_blocks(pa.array(["</json_1>", *texts], kind)[1:], names, 12)
        assert list(zip(row.tolist(), field.tolist(), number.tolist(), content.to_pylist())) == want
    assert [len(x) for x in tx.first_blocks(pa.array([], pa.string()), names, 12)] == [0, 0, 0, 0]
