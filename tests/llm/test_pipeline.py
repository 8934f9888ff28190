"""The pipeline: each stage against a plain version on a small corpus, and the registry."""

import math
import os

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from test_dedup import plain_near
from tessera.llm import mixing, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.REGISTRY[name](spark, SF)
    res = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(res.fetchall(), key=repr)


def test_stages(spark, corpus):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        seen[name] = docs
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert seen["toxicity"].exceptAll(corpus.select(*corpus_pipeline.COLUMNS)).count() == 0
    near = {r["doc_id"] for r in seen["near_duplicates"].collect()}
    assert near & set(range(30, 46)) == {30} and {62, 63, 64, 65, 66, 67} - {66} <= near | {66}
    cut = {r["doc_id"]: r["text"] for r in seen["repeated_passages"].collect()}
    kept = {r["doc_id"]: r["text"] for r in seen["near_duplicates"].collect()}
    assert cut[50] == kept[50] and all(len(cut[i].split()) < len(kept[i].split()) for i in range(51, 55))
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in seen["repeated_passages"].collect())
    mixed = {r["doc_id"]: r["n"] for r in seen["mixing"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(mixed) <= set(cut) and max(mixed.values()) <= 6          # a repeated row counts for itself
    packed = {r["doc_id"] for r in seen["packing"].collect()}
    assert packed == set(mixed)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, queries.toxicity_model(spark, SF, docs))
    left = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert left.count() == scored.where("score < 0.5").count()


def plain_score(model, text):
    """From the definition: compressed lengths by zstandard itself, passage by passage."""
    def distance(dictionaries, x):
        level, *dictionaries = dictionaries
        size = [len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False,
                                             write_dict_id=False).compress(x)) for d in dictionaries]
        return size[0] - size[1]

    def prepared(level, *contents):
        out = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in contents]
        for d in out:
            d.precompute_compress(level=level)
        return [level, *out]

    def evidence(distances, table, low):
        return min(max(sum(table[min(max(d - low, 0), len(table) - 1)] for d in distances), -10), 20)

    words = [w.strip(b".,;:!?\"'()[]{}<>*_-") for w in (text or "").lower().encode().split()]
    words = [w[i:i + 64] for w in words for i in range(0, max(len(w), 1), 64)]
    n = max(-(-len(words) // 256), 1)
    single, several = prepared(6, model.ordinary, model.toxic), prepared(5, model.span_ordinary, model.span_toxic)
    odds, (a, b, c) = [], model.weights
    for i in range(n):
        p = words[len(words) * i // n:len(words) * (i + 1) // n]
        spans, at = [], 0
        while p and (not at or at + 4 < len(p)):
            spans.append(b" " + b" ".join(p[at:at + 12]) + b" ")
            at += 8
        odds.append(math.exp(min(max(a + b * evidence([distance(single, toxicity.stretched(w)) if w[:3] in model.starts else 0 for w in set(p)], model.evidence, -12)
                                     + c * evidence([distance(several, s) for s in spans], model.span_evidence, -3), -30), 30)))
    return sum(odds) / n / (1 + sum(odds) / n)


def plain_toxic(rows, model):
    return [r for r in rows if plain_score(model, r[1]) < 0.5]


def test_scores_follow_from_the_model(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").limit(60)
    model = queries.toxicity_model(spark, SF, spark.read.parquet(f"{SF}/documents.parquet"))
    for r in toxicity.score(docs, model, keep=["text"]).collect():
        assert abs(r["score"] - plain_score(model, r["text"])) < 1e-9


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, no_docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, no_docs, SF).collect() == []


def plain_kept(rows):
    """A row stays if its document is the smallest id of its group; rows without an id stay."""
    kept = {i for i, _, _, k in plain_near([(r[0], r[1] or "") for r in rows], 5, 80) if k}
    return [r for r in rows if r[0] in kept]


def plain_passages(rows, span=50):
    order = lambda i: float("inf") if i is None else i
    words = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for a in range(len(w) - span + 1):
            g = tuple(w[a:a + span])
            first[g] = min(first.get(g, order(r[0])), order(r[0]))
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            if first[tuple(w[a:a + span])] < order(r[0]):
                gone[a:a + span] = [True] * span
        rest = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        if not any(gone):
            yield r
        elif not all(gone):
            yield (r[0], rest, *r[2:4], len(rest))


def test_stages_row_by_row(spark, corpus):
    """With several rows without an id, and with one id, of different texts."""
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    old = order(corpus.select(*corpus_pipeline.COLUMNS).collect())
    base, passage = (next(r[1] for r in old if r[0] == i) for i in (30, 50))
    passage = " ".join(passage.split()[20:90])
    new = [(None, "fresh words " + passage), (None, base), (None, "  ".join(base.split())), (None, "one  two three"),
           (None, ""), (71, passage), (71, "own text of this row"), (30, " ".join(map(str, range(200, 240))) + " " + passage), (72, " ".join(map(str, range(99))))]
    rows = order(old + [(i, t, "de", f"n{k}", len(t)) for k, (i, t) in enumerate(new)])
    frame = lambda rows: spark.createDataFrame(rows, corpus.select(*corpus_pipeline.COLUMNS).schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: order(stage[name](spark, frame(rows), SF).collect())

    assert run("toxicity", rows) == order(plain_toxic(rows, queries.toxicity_model(spark, SF, frame(rows))))
    assert run("near_duplicates", rows) == order(plain_kept(rows))
    rows = plain_kept(rows)
    assert run("repeated_passages", rows) == order(plain_passages(rows))
    rows = list(plain_passages(rows))
    copies = mixing.mix(frame(rows)).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    mixed = run("mixing", rows)
    assert set(mixed) <= set(rows)
    assert {r["doc_id"]: r["n"] for r in copies if r["n"]} == {i: sum(r[0] == i for r in mixed) for i in {r[0] for r in mixed}}
    assert run("packing", mixed) == order(packing.pack(frame(mixed), queries.tokenizer_path(), seq_len=2048).collect())


def test_stages_leave_no_tables_of_their_operators(spark):
    """Outside of ``run`` too, a stage keeps only the table that its result is read from."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages, corpus_pipeline.mix_sources):
        assert stage(spark, docs, SF).count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"pipeline-kept", "pipeline-cut", "pipeline-mixed"}
