"""Strict JSON, blocks, part counts and cleaning."""

import json

from pyspark.sql import functions as F

from tessera.functions import jsonx


def py_strict(s):
    try:
        json.loads(s)
        return True
    except (ValueError, TypeError):
        return False


STRICT = ['{"a":1}] [{"b":2}', '1,"_e":7},{"_v":2', '1,"_e":7', '{"a":"}],["}', '[1],[2]', "1e-05", "-0", "+1", "1.", ".5",
          "nul", "Infinity", "tru", "  ", '{"a":1} x', "{'a':1}", '{"a":1,"a":2}', '{"a":NaN}', '{"a":1},{"b":2}', "",
          '{"a":"\t"}', "01", '{"a":', '[1, 2]', '"s"', "null", " {\"a\": 1} ", "1e5"]


def test_strict_json_agrees_with_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STRICT)], "i int, s string")
    got = {r.i: r.ok for r in df.select("i", jsonx.is_strict_json(F.col("s")).alias("ok")).collect()}
    assert got == {i: py_strict(s) for i, s in enumerate(STRICT)}


def test_part_count_edge_rows(spark):
    docs = ['<json>{"parts":{"part_1":{},"part_2":{}}}</json>',
            '<json>{"parts":{"part_1":{},"part_1_x":{},"Part_2":{},"p":{}}}</json>',
            "no tag", "<json>{broken</json>", "<json>{}</json>", '<json>{"x":1}</json>',
            '<json>{"parts":[1,2]}</json>', None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(jsonx.completion_part_count(F.col("c"))).collect()]
    assert got == [2, 2, 0, 0, 0, 0, 0, 0]
    last = spark.createDataFrame([('<json>{"parts":{"part_1":{}},"parts":{"part_1":{},"part_2":{},"part_2":{}}}</json>',)], "c string")
    assert last.select(jsonx.completion_part_count(F.col("c"))).first()[0] == 2


def test_clean_typed_and_exact(spark):
    src = ['{"final_shape":"s","parts":{"part_1":{"a":1,"description":{}}}}', '{"x": 1}',
           '{"x":1} tail', "{'x':1}", "", '{"k":"é"}', '[1]', '{"parts":{"part_1":"s"}}',
           '{"final_shape":"","parts":{"part_1":{"extrusion":{"extrude_depth_towards_normal":5,'
           '"operation":"CutFeatureOperation"},"description":{"shape":""}}}}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(src)], "i int, s string")
    rows = df.orderBy("i").select(jsonx.clean_cad_json(F.col("s")).alias("t"),
                                  jsonx.clean_cad_json_exact(F.col("s")).alias("e")).collect()
    exact = [r.e for r in rows]
    assert exact[0] == '<json>\n{"parts":{"part_1":{"a":1}}}\n</json>'
    assert exact[1] == '<json>\n{"x":1}\n</json>'
    assert exact[2:5] == [None, None, None]
    assert exact[5] == '<json>\n{"k":"\\u00e9"}\n</json>'
    assert exact[6] is None and exact[7] is None
    typed = [r.t for r in rows]
    assert typed[0] == '<json>\n{"parts":{"part_1":{}}}\n</json>'
    assert typed[2:5] == [None, None, None] and typed[6] is None and typed[7] is None
    assert typed[8] == ('<json>\n{"parts":{"part_1":{"extrusion":{"extrude_depth_towards_normal":5.0,'
                        '"operation":"CutFeatureOperation"}}}}\n</json>')
    # clean(unwrap(clean(x))) == clean(x)
    again = spark.createDataFrame([(r.t,) for r in rows if r.t], "c string").select(
        jsonx.clean_cad_json(jsonx.json_block(F.col("c"))).alias("a"), F.col("c")).collect()
    assert all(r.a == r.c for r in again)


def test_repeated_keys_keep_last_value(spark):
    from tessera.operators import cad
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    df = spark.createDataFrame(
        [(1, '<json>{"parts":{"part_1":{"extrusion":{"operation":"Cut"}},'
             '"part_1":{"extrusion":{"operation":"CutFeatureOperation"}}}}</json>')],
        "id int, completion string")
    r = cad.operation_check(df).first()
    assert (r.n_parts, r.n_valid_ops) == (1, 1)


def test_exact_cleaning_keeps_fields_and_spelling(spark):
    from tessera.plans import jobs
    doc = ('{"final_shape":"s","units":"mm","parts":{"part_1":{"extrusion":{"sketch_scale":"0.5","n":5,"x":1e-05},'
           '"color":"r\u00e9d","description":{}},"part_1":{"k":5}}}')
    df = spark.createDataFrame([(0, "p", doc), (1, "p", '{"a":1}] [{"b":2}')], "ord long, prompt string, completion string")
    got = jobs.clean_and_bucket(df).select("completion").collect()
    assert [r[0] for r in got] == ['<json>\n{"units":"mm","parts":{"part_1":{"k":5}}}\n</json>']


def test_building_columns_leaves_the_session_alone(spark):
    for policy in ("EXCEPTION", "LAST_WIN", None):
        if policy:
            spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        else:
            spark.conf.unset("spark.sql.mapKeyDedupPolicy")
        before = spark.conf.get("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
        df = spark.createDataFrame([('{"parts":{"part_1":{},"part_1":{}}}',)], "s string")
        assert df.select(jsonx.clean_cad_json(F.col("s"))).first()[0] is not None
        assert spark.conf.get("spark.sql.mapKeyDedupPolicy", "EXCEPTION") == before
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_json_block_and_object_agree_with_python(spark):
    import json
    docs = ["{}", '{"a":1} ', "{},{}", "{}],[{}", '{},"_e":7}', '{},"_v":{}', '{"_v":[1]}', '{"_e":5}', '{"a":NaN}', '{"a":01}',
            "{'a':1}", '{"a":1,}', '{"a":1}x', '{"a":1}]', "{},5", '{"a":"x\ny"}', "5", "[1]", "", "{", '{"a":"' + "y" * 5000 + '"}']

    def ok(t):
        try:
            return isinstance(json.loads(t), dict)
        except ValueError:
            return False
    cases = [(f"a<json>\n{x}\n \u3000</json><json>{{}}</json>", x.strip() if ok(x) else None) for x in docs]
    cases += [("</json><json>{}</json>", "{}"), ("<json>{}", None), ("<json><json>{}</json>", None), (None, None), ("{}", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", jsonx.json_block(F.col("t")).alias("b")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
    # nothing is located or cut character by character
    plan = df.select(jsonx.json_block(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "locate(" not in plan
