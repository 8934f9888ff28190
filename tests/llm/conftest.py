"""A small corpus with every awkward case, and plain versions of the operators."""

import random

import pytest

CORPUS_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
                 "size string, id string, rank int, shard int, `key` int, m int, t int, kept int")


def corpus_rows():
    """(doc_id, text, source) with nulls, empty and long texts, exact and near copies, ties and
    repeated rows, shared passages."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(70), text(55)
    rows = [(i, text(rnd.randint(1, 180)), f"s{i % 3}") for i in range(30)]
    base = text(120)
    rows += [(30 + i, base, "s0") for i in range(6)]                                  # exact copies
    for i in range(6):                                                                # near copies
        w = base.split()
        w[rnd.randrange(len(w))] = word()
        rows.append((40 + i, " ".join(w), "s1"))
    rows += [(50 + i, f"{text(20)} {passage} {text(15)}", "s2") for i in range(5)]
    rows += [(60, f"{other}\n\n{other}", "s0"), (61, other, None), (62, None, "s1"), (63, "", "s1"),
             (64, "  \t\n ", None), (65, "one two three", "s2"), (66, "One  two three", "s2"),
             (67, text(4000) + " " + passage, "s0"), (68, "é ß 日本 " * 40, "s0"), (69, "x" * 3000, "s0")]
    rows += [(None, base, "s0"), (None, text(60), None), (70, other, "s1"), (70, other, "s1"), (71, text(90), "s2")]
    return rows


@pytest.fixture(scope="session")
def corpus(spark):
    rows = [(i, t, "en", s, None if t is None else len(t), "x", "y", 1, 2, 3, 4, 5, 6) for i, t, s in corpus_rows()]
    return spark.createDataFrame(rows, CORPUS_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CORPUS_SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture
def same():
    return rows_of
