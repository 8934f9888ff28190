"""Toxicity: held-out accuracy on the driver tables, and defined results for awkward rows."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.queries import is_held_out, op10_toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy(spark):
    got = op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) <= 0.02 * n[(0, 0)] and n[(1, 1)] >= 0.9 * (n[(1, 1)] + n.get((1, 0), 0))


@pytest.fixture(scope="module")
def small(spark, corpus):
    plain = [(1000 + i, f"{a} alpha {b} beta {a}", "x") for i, (a, b) in enumerate(
        (f"w{i % 7}", f"v{i % 5}") for i in range(40))]
    bad = [(2000 + i, f"w{i % 7} alpha v{i % 5} horrid{i % 3} beta", "x") for i in range(40)]
    docs = spark.createDataFrame(plain + bad + [(1, None, "x"), (2, "", "x"), (None, "HORRID0!", "x"), (2000, bad[0][1], "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _, _ in plain + bad] + [(1, None), (None, 1), (2000, 1)],
                                   "doc_id long, toxic int")
    return docs, labels


def test_awkward_rows(small):
    docs, labels = small
    model = toxicity.fit(docs, labels, ~is_held_out(F.col("id")))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert got[1] == got[2] < 0.5 <= got[None]
    assert all((s >= 0.5) == (i >= 2000) for i, s in got.items() if i is not None)


def test_nothing_to_learn_and_empty_table(small):
    docs, labels = small
    model = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] < 0.5 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_long_training_documents_count(spark):
    words = lambda i, n: " ".join(f"w{(i * 7 + k * k) % 501}" for k in range(n))
    rows = [(i, words(i, 3000)) for i in range(40)] + [(100 + i, words(i, 60).replace(" ", f" horrid{i % 3} ", 40) + " " + words(i, 2900)) for i in range(40)]
    assert all(len(t) > 8000 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert all((s >= 0.5) == (i >= 100) for i, s in got.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_length_alone_is_no_evidence(spark):
    """Clean held-out texts joined to very long ones stay clean, toxic ones stay toxic."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, ~is_held_out(F.col("id")))
    marked = toxicity.score(docs, model, keep=["lang"]).join(labels, "doc_id").where(is_held_out(F.col("doc_id"))).join(
        docs.select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    clean = [r["text"] for r in marked if r["toxic"] == 0 and r["score"] < 0.5]
    toxic = [r["text"] for r in marked if r["toxic"] == 1 and r["score"] >= 0.5]
    judge = toxicity.Judge(model)
    score = lambda texts: judge.score(" ".join(texts))
    for n in (50, 200, len(clean)):
        assert all(score(clean[a:a + n]) < 0.5 for a in range(0, len(clean) - n + 1, n))
    assert score(toxic) >= 0.5 and score(clean[:50] + toxic[:1]) >= 0.5


def test_spans_hold_every_run_of_five_words():
    for n in range(60):
        words = [f"w{i}".encode() for i in range(n)]
        held = [s.split() for s in toxicity.spans(words)]
        assert all(any(words[i:i + 5] == h[j:j + 5] for h in held for j in range(len(h) - len(words[i:i + 5]) + 1))
                   for i in range(max(n - 4, min(n, 1))))
