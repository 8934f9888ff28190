"""End-to-end jobs with a Python model callable."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import position, survey
from tessera.plans import jobs
from tessera.session import scratch_dir
from tessera.sources import logs


def doc(n):
    return "<json>{\"parts\":{" + ",".join(f'"part_{k}":{{}}' for k in range(1, n + 1)) + "}}</json>"


def test_multi_turn_job_with_model_hook(spark):
    import re

    def echo_model(request: str) -> str:
        """Answers every <input_i> with one complete turn per part of its JSON."""
        out = []
        for i, body in re.findall(r"<input_(\d+)>\n(.*?)\n</input_\1>", request, re.S):
            n = len(re.findall(r'"part_\d+"', body))
            turns = "".join(f"<json_{k}>{{}}</json_{k}><prompt_{k}>p</prompt_{k}><think_{k}>t</think_{k}>"
                            for k in range(1, n + 1))
            if i == "2":
                continue
            out.append(f"<sample_{i}>{turns}</sample_{i}>")
        if "boom" in request:
            raise RuntimeError("model failure")
        return "\n".join(out)

    rows = [(f"r{i}", doc(1 + i % 2) + (" boom" if i == 8 else "")) for i in range(10)]
    data = position.with_ord(spark.createDataFrame(rows, "id string, completion string"), "id")
    hook = jobs.model_hook(echo_model)
    res = jobs.multi_turn_job(data, lambda b, reqs: hook(reqs), batch_size=3, split="s")
    j = {r.id: r for r in res["judged"].collect()}
    assert len(j) == 10                                   # every row ends ok or failed
    assert res["split"] == "s_0_10" and res["max_parts"] == 2
    # pos 2 of every batch has no sample; the batch holding r8 raised -> null response
    failed = sorted(r.id for r in res["failed_ids"].collect())
    assert failed == ["r1", "r4", "r6", "r7", "r8"]
    assert j["r0"].generated == 1 and not j["r0"].is_failed
    folder, n = logs.write_failed_log(res["failed_ids"], scratch_dir(spark, "mt"), "d/x", "s", 0)
    assert n == 5


def test_multi_turn_gate_stops(spark):
    data = position.with_ord(spark.createDataFrame([("a", doc(1)), ("b", doc(2))],
                                                   "id string, completion string"), "id")
    with pytest.raises(survey.SurveyGateError):
        jobs.multi_turn_job(data, lambda b, r: None, expected_parts=1)


def test_reasoning_job_and_invalid_positions(spark):
    rows = [(i, "<valid>Yes</valid><description>d</description><think>t</think>" if i % 3 else "no")
            for i in range(10)]
    bucket = position.with_ord(spark.createDataFrame(rows, "k int, response string"), "k")
    judged, name = jobs.reasoning_job(bucket.select("ord", "k"), bucket.select("ord", "response"),
                                      "range_0_500_en", 2, 50)
    assert name == "range_0_500_en_2_50"
    assert judged.count() == 8
    bad = judged.where(~F.col("accepted"))
    path = scratch_dir(spark, "invalid")
    logs.write_invalid_positions(bad, path)
    assert [r.invalid_index for r in spark.read.parquet(path).orderBy("invalid_index").collect()] == [3, 6, 9]
    _, clamped = jobs.reasoning_job(bucket.select("ord", "k"), bucket.select("ord", "response"),
                                    "x", 2, 50, clamp_name=True)
    assert clamped == "x_2_10"


def test_each_request_is_sent_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(request):
        calls.add(1)
        return "<sample_1><json_1>{}</json_1><prompt_1>p</prompt_1><think_1>t</think_1></sample_1>"

    rows = [(f"r{i}", doc(1)) for i in range(12)]
    data = position.with_ord(spark.createDataFrame(rows, "id string, completion string"), "id")
    hook = jobs.model_hook(model)
    job = jobs.multi_turn_job(data, lambda b, reqs: hook(reqs), batch_size=3, expected_parts=1, split="s")
    done = jobs.publish_multi_turn(job, str(tmp_path / "out"), str(tmp_path / "logs"), "d/x", "s")
    failed = {r.id for r in job["failed_ids"].collect()}
    assert job["judged"].count() == 12 and calls.value == 4
    assert done["split"] == "s_0_12_1parts" and done["n_failed"] == 8 == len(failed)
    ids, _ = logs.read_failed_log(spark, done["log"])
    assert {r.id for r in ids.collect()} == failed
    wide = spark.read.parquet(str(tmp_path / "out"))
    assert wide.count() == 12 and {r.id for r in wide.where("json_1 = ''").collect()} == failed


def test_retry_of_nothing_and_mismatch_warning(spark):
    data = position.with_ord(spark.createDataFrame([("a", doc(1)), ("b", "x")], "id string, completion string"), "id")
    assert jobs.retry_job(data, data.select("id").limit(0), None) is None
    one = spark.createDataFrame([("a",), ("b",)], "id string")
    hook = jobs.model_hook(lambda r: None)
    job = jobs.retry_job(data, one, lambda b, reqs: hook(reqs), expected_parts=5)
    assert job["warnings"] == ["no failed row has 5 parts"]
    # the distribution counts parsed documents only
    assert [(r.part_count, r.n) for r in job["distribution"].collect()] == [(1, 1)]


def test_one_parse_per_document(spark):
    from tessera.operators import cad
    df = spark.createDataFrame([(1, doc(3))], "id int, completion string")
    plan = cad.progressive_docs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(parts,MapType(StringType,StringType,true),true)") <= 1


def test_number_coverage_counts_values(spark):
    from tessera.operators import cad
    df = spark.createDataFrame([(1, '{"part_1":{"line_7":[1e-05, 2],"s":"9"}}', "0.00001 and 7")], "id int, j string, t string")
    r = cad.number_coverage(df, F.col("j"), F.col("t")).first()
    assert (r.n_json_numbers, r.n_covered) == (2, 1)


def test_stand_in_and_documents_pick_part_texts_once(spark):
    """No lambda per part where a field of the array does (F15, F16 of round 3); the job stores what it reads."""
    from tessera.plans import fixtures as fx
    items = spark.createDataFrame([(3, 0, [(k, 5, "op", f'"part_{k}":{{}}') for k in (1, 2, 3)])],
                                  "id long, ord long, items array<struct<k: int, q: long, op: string, s: string>>")
    data = fx.with_completion(items)
    assert "lambdafunction" not in data.select("completion")._jdf.queryExecution().optimizedPlan().toString()
    assert data.first().completion == '<json>\n{"final_shape":"","parts":{"part_1":{},"part_2":{},"part_3":{}}}\n</json>'
    job = jobs.multi_turn_job(data, lambda b, reqs: fx.stand_in_model(b), batch_size=2, split="s")
    assert "parsed" not in job["judged"].columns
    row = job["judged"].first()
    assert [t.json for t in row.turns] == ['{"parts":{' + ",".join(f'"part_{i}":{{}}' for i in range(1, k + 1)) + "}}" for k in (1, 2, 3)]
    assert (row.generated, row.is_failed) == (3, False)


def test_retry_parses_a_found_document_once(spark, monkeypatch):
    """The rows that range bounds are drawn from are not parsed for it (F1, F2 of round 4)."""
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        parsed.add(1)
        return text

    count = survey.with_part_count
    monkeypatch.setattr(survey, "with_part_count", lambda df: count(df.withColumn("completion", seen("completion"))))
    data = position.with_ord(spark.createDataFrame([(f"r{i}", doc(1 + i % 2)) for i in range(10)], "id string, completion string"), "id")
    ids = data.where("ord % 3 = 0").select("id")
    hook = jobs.model_hook(lambda r: "<sample_1><json_1>{}</json_1><prompt_1>p</prompt_1><think_1>t</think_1></sample_1>")
    job = jobs.retry_job(data, ids, lambda b, reqs: hook(reqs), batch_size=2)
    assert parsed.value == 4
    assert sorted((r.id, r.retry_ord, r.part_count, r.parsed) for r in job["found"].collect()) == [
        ("r0", 0, 1, True), ("r3", 1, 2, True), ("r6", 2, 1, True), ("r9", 3, 2, True)]
    assert [(r.id, r.is_failed) for r in job["judged"].orderBy("id").collect()] == [("r0", False), ("r3", True), ("r6", False), ("r9", True)]
