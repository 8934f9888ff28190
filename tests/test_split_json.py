"""A single-file log read in byte ranges (S2) against Python's own parser."""

import json
import random

import pytest

from tessera.session import scratch_dir
from tessera.sources import logs, split_json


def written(tmp_path, value, **options):
    p = tmp_path / "log.json"
    p.write_text(json.dumps(value, **options), encoding="utf-8")
    return str(p)


def got(spark, path, n):
    ids, rest = split_json.read_id_array(spark, path, range_bytes=n)
    rows = sorted(ids.collect(), key=lambda r: r.list_pos)
    assert [r.list_pos for r in rows] == list(range(len(rows)))
    return [r.id for r in rows], rest


@pytest.mark.parametrize("options", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_any_range_size(spark, tmp_path, options):
    rnd = random.Random(5)
    odd = ['a"b', "\\", '\\"', "x, y", "]", "[{", '"failed_sample_ids": [', "", " ", "é漢🙂", "\n\t", "null", '\\\\"', "q" * 90]
    ids = [rnd.choice(odd) + str(rnd.randint(0, 99)) if rnd.random() < 0.7 else rnd.choice(odd) for _ in range(60)]
    value = {"dataset": 'd"]', "other": ["1", "2"], "failed_sample_ids": ids, "after": [3], "failed_count": 60}
    path = written(tmp_path, value, **options)
    size = len(json.dumps(value, **options).encode())
    for n in (17, 64, 301, size, size + 9):
        found, rest = got(spark, path, n)
        assert found == ids
        assert rest == {k: v for k, v in value.items() if k != "failed_sample_ids"}


def test_scalars_empty_and_absent(spark, tmp_path):
    path = written(tmp_path, {"failed_sample_ids": [None, 12, "12", True, -1.5, "null"], "split": "s"})
    for n in (3, 1000):
        assert got(spark, path, n) == ([None, "12", "12", "true", "-1.5", "null"], {"split": "s"})
    assert got(spark, written(tmp_path, {"failed_sample_ids": [], "n": 0}), 5) == ([], {"n": 0})
    assert got(spark, written(tmp_path, {"n": 0}), 5) == ([], {"n": 0})
    assert got(spark, written(tmp_path, {"failed_sample_ids": None, "n": 0}), 5) == ([], {"n": 0})


def test_refuses_other_files(spark, tmp_path):
    with pytest.raises(ValueError, match="not an id log"):
        split_json.read_id_array(spark, written(tmp_path, {"failed_sample_ids": [["a"]]}), range_bytes=8)
    p = tmp_path / "cut.json"
    p.write_text('{"failed_sample_ids": ["a", "b"')
    with pytest.raises(ValueError, match="cut off"):
        split_json.read_id_array(spark, str(p), range_bytes=8)


def test_the_log_reader_uses_it_for_long_files(spark, tmp_path, monkeypatch):
    ids = [f"id {i}" for i in range(500)]
    value = {"dataset": "d", "split": "s", "start_index": 0, "failed_count": 500, "failed_sample_ids": ids, "timestamp": "t"}
    path = written(tmp_path, value)
    whole, summary = logs.read_failed_log(spark, path)
    monkeypatch.setattr(split_json, "RANGE_BYTES", 1000)
    cut, again = logs.read_failed_log(spark, path)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and summary == again
    assert cut.select("id").distinct().count() == 500
    spread, _ = split_json.read_id_array(spark, path, range_bytes=1000)
    assert spread.count() == 500
