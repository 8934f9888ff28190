"""Label spans: rendered text, characters and tokens."""

from pyspark.sql import functions as F

from tessera.functions import chat, template, tokens
from tessera.operators import labels

ROWS = [(1, [("user", "Hi there."), ("assistant", "Yes, 12 times."), ("user", "More?"), ("assistant", "No")]),
        (2, [("user", "Only asked")]), (3, []), (4, None), (5, [("assistant", "é日本 x")])]


def frame(spark):
    return spark.createDataFrame(ROWS, "id int, messages array<struct<role: string, content: string>>")


def test_spans_give_back_the_answers(spark):
    df = labels.with_label_spans(frame(spark), template.compiled(chat.CHATML_TEMPLATE))
    found = {}
    for r in labels.span_rows(df, keep=("id",)).orderBy("id", "span").collect():
        found.setdefault(r["id"], []).append(r["learnt"])
    assert found == {1: ["Yes, 12 times.", "No"], 5: ["é日本 x"]}
    got = {r["id"]: r["spans"] for r in df.collect()}
    assert got[2] == [] and got[3] == [] and got[4] is None


def test_tokens_of_spans(spark):
    df = labels.with_label_spans(frame(spark), template.compiled(chat.CHATML_TEMPLATE)).where("id = 1")
    r = df.first()
    offsets = labels.approx_offsets(r["text"])
    assert len(offsets) == df.select(tokens.approx_token_count("text")).first()[0]
    for s in r["spans"]:
        inside = [i for i, (a, b) in enumerate(offsets) if b > s["begin"] and a < s["end"]]
        assert s["first_token"] == inside[0] and s["n_tokens"] == len(inside)


def test_offsets_of_a_user_tokenizer(spark):
    offsets = labels.make_token_offsets(lambda s: [(i, min(i + 3, len(s))) for i in range(0, len(s), 3)])
    df = labels.with_label_spans(frame(spark), template.compiled(chat.CHATML_TEMPLATE), offsets=offsets)
    for r in df.where(F.size("spans") > 0).collect():
        for s in r["spans"]:
            assert s["first_token"] == s["begin"] // 3 and s["first_token"] + s["n_tokens"] == -(-s["end"] // 3)


def test_offsets_of_a_batch_are_flat(spark):
    """A batch of offsets takes a few bytes a token, not an object each (F7 of round 3)."""
    import tracemalloc

    import pyarrow as pa
    texts = pa.array(["word, " * 500] * 200 + [None, ""])
    tracemalloc.start()
    out = labels.offset_arrays(texts, labels.approx_offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 202 and out.null_count == 1 and len(out.flatten()) == 200 * 1000
    assert out[0].as_py() == [{"begin": a, "end": b} for a, b in labels.approx_offsets("word, " * 500)] and out[201].as_py() == []
    assert peak < 200 * 1000 * 25
