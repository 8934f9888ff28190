"""Registered queries against the DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans import queries as _queries

SF = "/root/testdata/sf0.001"
LIBRARY = sorted(_queries.REGISTRY)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "documents", "conversations", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_registry_has_oracles():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_whole_inputs(spark, con):
    """Every conversation row is in a pair, every language is interleaved."""
    pairs = E.queries()["chat_messages"](spark, SF)
    total = con.execute("SELECT count(*) FROM conversations WHERE role = 'user'").fetchone()[0]
    assert pairs.where("instr(text, 'start|>user') > 0").count() == total
    with_system = con.execute("SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'system'").fetchone()[0]
    assert pairs.where("instr(text, 'start|>system') > 0").select("conv_id").distinct().count() == with_system
    langs = {r.lang for r in E.queries()["interleave"](spark, SF).collect()}
    assert langs == {"en", "fr", "de", "es"}


def test_entry(spark):
    out = E.entry(spark)
    assert out.columns == ["split", "n_rows"] and out.count() > 0


@pytest.mark.parametrize("name", LIBRARY)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = norm([[r[c] for c in cols] for r in df.collect()])
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    assert got == norm([[r[i] for i in idx] for r in res.fetchall()])


@pytest.mark.parametrize("name", ["verdict", "clean_and_bucket"])
def test_same_result_with_1_and_8_partitions(spark, name):
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = E.queries()[name](spark, SF)
            results.append(sorted(map(tuple, df.collect()), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
