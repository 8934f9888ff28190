"""The response ledger: one call per request, whatever fails."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.sources import ledger


def counting(folder, fail_at=None, dies=False):
    """A stand-in model that leaves a file per call."""
    def call(request):
        n = len(os.listdir(folder))
        if dies and n >= fail_at:
            raise SystemExit("the worker dies")
        open(f"{folder}/{uuid.uuid4().hex}-{request}", "w").close()
        if fail_at is not None and not dies and request == f"r{fail_at}":
            raise ValueError("refused")
        return f"answer to {request}"
    return call


def calls(folder):
    return sorted(f.split("-", 1)[1] for f in os.listdir(folder))


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), str(tmp_path / "ledger")


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([(i, f"r{i % 30}") for i in range(40)] + [(99, None)], "batch_id long, request string")


def test_rerun_and_appended_requests(spark, folders, requests):
    seen, path = folders
    hook = ledger.ledger_hook(counting(seen), path, parts=3)
    first = {r["batch_id"]: r["response"] for r in hook(requests).collect()}
    assert first == {i: f"answer to r{i % 30}" for i in range(40)} | {99: None}
    assert calls(seen) == sorted(f"r{i}" for i in range(30))             # equal requests are one call
    assert {r["batch_id"]: r["response"] for r in hook(requests).collect()} == first
    assert ledger.send_new(requests, counting(seen), path) == 0 and len(calls(seen)) == 30
    more = requests.unionByName(spark.createDataFrame([(100, "new")], requests.schema))
    assert ledger.send_new(more, counting(seen), path) == 1
    assert ledger.send_new(more, counting(seen), path, model="another") == 31


def test_task_that_dies_half_way(spark, folders):
    """The next attempt of the same part goes on where the first one ended."""
    seen, path = folders
    pdf = pd.DataFrame({"digest": [f"d{i}" for i in range(20)], "request": [f"r{i}" for i in range(20)]})
    part = lambda: 4
    with pytest.raises(SystemExit):
        list(ledger.sender(counting(seen, 7, dies=True), path, "run-a", part=part)(iter([pdf])))
    assert len(calls(seen)) == 7
    again = list(ledger.sender(counting(seen), path, "run-a", part=part)(iter([pdf])))
    assert again[0]["sent"].tolist() == [13] and len(calls(seen)) == len(set(calls(seen))) == 20


def test_job_that_dies_half_way(spark, folders, requests):
    seen, path = folders
    with pytest.raises(Exception):
        ledger.send_new(requests, counting(seen, 11, dies=True), path, parts=1)
    made = len(calls(seen))
    assert made == 11
    assert ledger.send_new(requests, counting(seen), path, parts=5) == 30 - made
    assert len(calls(seen)) == len(set(calls(seen))) == 30


def test_failed_calls_and_cut_off_lines(spark, folders, requests):
    seen, path = folders
    assert ledger.send_new(requests, counting(seen, 3), path) == 30
    assert ledger.read_ledger(spark, path).where("not ok").count() == 1
    assert ledger.send_new(requests, counting(seen), path) == 0
    assert ledger.send_new(requests, counting(seen), path, retry_failed=True) == 1
    assert ledger.read_ledger(spark, path).where("not ok").count() == 0
    os.makedirs(f"{path}/run-x/part-000000")
    with open(f"{path}/run-x/part-000000/cut.jsonl", "w") as f:
        f.write('{"digest": "abc", "ok": true, "resp')
    assert ledger.read_ledger(spark, path).count() == 30


def test_compact(spark, folders, requests):
    seen, path = folders
    ledger.send_new(requests, counting(seen, 3), path)
    before = sorted(map(tuple, ledger.read_ledger(spark, path).collect()), key=repr)
    ledger.compact(spark, path)
    assert sorted(map(tuple, ledger.read_ledger(spark, path).collect()), key=repr) == before
    assert sum(len([f for f in fs if f.endswith(".jsonl")]) for _, _, fs in os.walk(path)) == 1
    assert ledger.send_new(requests, counting(seen), path) == 0


def test_speculation_is_refused(spark, folders, requests):
    class Refusing:
        sparkSession = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: "true")})})
    with pytest.raises(ValueError, match="speculat"):
        ledger.send_new(Refusing(), counting(folders[0]), folders[1])


def test_model_name_is_part_of_the_digest(spark):
    row = spark.range(1).select(ledger.digest(F.lit("x")).alias("a"), ledger.digest(F.lit("x"), "m").alias("b")).first()
    assert row["a"] != row["b"] and len(row["a"]) == 64
