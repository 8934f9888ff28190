"""Substring, near-duplicate and suffix deduplication against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import merge, near_dup, substring, suffix
from tessera.llm.anchors import window_minima
from tessera.llm.components import components
from tessera.llm.shingles import rolling


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_window_minima_and_rolling():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 5, 8, 39):
        assert window_minima(h, w).tolist() == [i + int(np.argmin(h[i:i + w])) for i in range(len(h) - w + 1)]
    for k in (1, 2, 3, 7, 12, 32):
        got = rolling(h, k)
        keys = {}
        for i in range(len(h) - k + 1):
            assert keys.setdefault(tuple(h[i:i + k].tolist()), got[i]) == got[i]
        assert len(set(got.tolist())) == len(keys)


def test_merge_of_front_coded_runs():
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    for k in (0, 1, 2, 5, 16):
        dealt = [sorted(strings[i::k]) for i in range(k)]
        out, last = [], b""
        heads = [iter(d) for d in dealt]
        for run, shared in merge.merge_runs([merge.decoded(*merge.front_coded(d)) for d in dealt]):
            s = next(heads[run])
            assert shared == merge.common_prefix(last, s, 0)
            out.append(s)
            last = s
        assert out == (sorted(strings) if k else [])


def plain_substring(docs, span):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        w = t.encode().split()
        for a in range(len(w) - span + 1):
            g = tuple(w[a:a + span])
            first[g] = min(first.get(g, order(i)), order(i))
    for i, t in docs:
        w = t.encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            if first[tuple(w[a:a + span])] < order(i):
                gone[a:a + span] = [True] * span
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("span", [20, 50])
def test_substring(corpus, same, span):
    got = substring.drop_repeated_windows(corpus, span=span, shard_words=500)
    assert same(got, *got.columns) == sorted(plain_substring(rows(corpus), span), key=repr)


def plain_suffix(docs, span):
    n = Counter(x[a:a + span] for x in (t.encode() for _, t in docs) for a in range(len(x) - span + 1))
    for i, t in docs:
        x = t.encode()
        gone = np.zeros(len(x) + 1, int)
        for a in range(len(x) - span + 1):
            if n[x[a:a + span]] > 1:
                gone[a:a + span] = 1
        rest = bytes(c for c, g in zip(x, gone) if not g)
        yield i, len(x), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("bucket_rows", [1, 4, 1000])
def test_suffix(corpus, same, bucket_rows):
    got = suffix.drop_repeated_strings(corpus, span=200, bucket_rows=bucket_rows, run_rows=7)
    assert same(got, *got.columns) == sorted(plain_suffix(rows(corpus), 200), key=repr)


def plain_near(docs, k, percent):
    sets, ids = [], []
    for i, t in docs:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[a:a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset())
        ids.append(i)
    group = {i: i for i in ids if i is not None}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and None not in (ids[a], ids[b]) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                group[q] = p
    for i, s in zip(ids, sets):
        c = None if i is None else find(i)
        yield i, len(s), c, i == c


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(corpus, same, k):
    got = near_dup.near_duplicates(corpus, k=k)
    assert same(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_near(rows(corpus), k, 80), key=repr)


@pytest.mark.parametrize("block", [2])
def test_near_duplicates_of_cut_clusters(corpus, same, block):
    """Every cluster is cut by the rarest shingles and compared in several blocks."""
    got = near_dup.near_duplicates(corpus, block=block)
    assert same(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_near(rows(corpus), 5, 80), key=repr)


def test_shared_boilerplate_is_not_compared(spark, same, monkeypatch):
    """Documents that share 150 of 210 words (similarity 0.55) fall into one cluster, of which only the
    similar pairs planted in it are compared."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10 ** 9)}"
    shared = " ".join(word() for _ in range(150))
    own = [" ".join(word() for _ in range(60)) for _ in range(60)]
    docs = [(i, f"{shared} {x}") for i, x in enumerate(own)]
    docs += [(100 + i, f"{shared} {x} more {i}") for i, x in enumerate(own[:6])]
    tables, write = {}, near_dup.stored
    monkeypatch.setattr(near_dup, "stored", lambda df, name: tables.setdefault(name, write(df, name)))
    monkeypatch.setattr(near_dup, "_confirmed", lambda pairs, *rest: pairs.where("false"))     # all links by blocks
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=8)
    assert same(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_near(docs, 5, 80), key=repr)
    assert tables["near-sized"].agg({"n": "max"}).first()[0] > 50
    assert tables["near-open-sets"].count() == 12


def test_components_of_chains_and_stars(spark, same):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(205, 203), (203, 205), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    expected = [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)] + [(203, 203), (205, 203)]
    assert same(got, "id", "component") == sorted(expected, key=repr)


def test_empty_tables(no_docs):
    assert substring.drop_repeated_windows(no_docs).collect() == []
    assert near_dup.near_duplicates(no_docs).collect() == []
    assert suffix.drop_repeated_strings(no_docs).collect() == []


@pytest.fixture(scope="module")
def null_ids():
    """Texts without an id: two whose digests agree in 31 bits, one of them with a passage of text 1."""
    rnd = random.Random(9)
    passage, other = (" ".join(f"{c}{rnd.randrange(10 ** 6)}" for _ in range(25)) for c in "pq")
    low = lambda t: substring._digest(t.encode())[0] & 0x7FFFFFFF
    seen = {low(f"{passage} {i}"): i for i in range(200_000)}
    i, j = next((seen[low(f"{other} {j}")], j) for j in range(400_000) if low(f"{other} {j}") in seen)
    return [(1, f"start {passage} end"), (None, f"{passage} {i}"), (None, f"{other} {j}"),
            *[(None, f"{k} {passage} {k} {k}") for k in range(6)]]


def test_null_ids_of_equal_tags(spark, null_ids, same, monkeypatch):
    docs = spark.createDataFrame(null_ids, "doc_id long, text string")
    got = substring.drop_repeated_windows(docs, span=20)
    assert same(got, *got.columns) == sorted(plain_substring(null_ids, 20), key=repr)
    tables, write = {}, suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda df, name: tables.setdefault(name, write(df, name)))
    got = suffix.drop_repeated_strings(docs, span=100)
    assert same(got, *got.columns) == sorted(plain_suffix(null_ids, 100), key=repr)
    assert tables["suf-texts"].count() <= len(null_ids)          # each text meets its own class only


def test_windows_that_collide_in_a_polynomial(spark, same):
    """The Thue-Morse sequence and its complement have equal polynomials modulo 2**64 for any words."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    docs = [(i, " ".join("ab"[b ^ i] for b in bits)) for i in (0, 1)]
    assert len({int(rolling(substring.word_hashes(t.encode().split()), 1024)[0]) for _, t in docs}) == 1
    got = substring.drop_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string"), span=1024)
    assert same(got, *got.columns) == sorted(plain_substring(docs, 1024), key=repr)


def test_near_duplicates_of_repeated_ids(spark, same):
    rnd = random.Random(4)
    text = lambda: " ".join(str(rnd.randrange(10 ** 6)) for _ in range(80))
    a, b, c = text(), text(), text()
    docs = [(1, a), (5, a), (5, b), (5, c), (7, b + " end"), (3, c + " end"), (9, text()), (9, text()), (9, text()), (2, None), (2, b)]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert same(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_near([(i, t or "") for i, t in docs], 5, 80), key=repr)


def test_suffix_of_a_very_common_passage(spark, same, monkeypatch):
    """A passage in all documents, and one in half of them beside it: buckets are split by cores, and
    no table has a row per byte."""
    rnd = random.Random(12)
    letters = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    common, next_to = letters(230), letters(40)
    rows = [(i, letters(rnd.randint(0, 90)) + common + (next_to if i % 2 else "") + letters(rnd.randint(0, 90))) for i in range(150)]
    rows += [(150, common[:120]), (151, common + common), (152, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables, write = [], suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    got = suffix.drop_repeated_strings(docs, span=100, bucket_rows=8)
    assert same(got, *got.columns) == sorted(plain_suffix(rows, 100), key=repr)
    assert sum(name == "suf-runs" for name, _ in tables) > 2
    assert all(t.count() < 40 * len(rows) for _, t in tables)


def test_components_write_few_files(spark, monkeypatch):
    """A small link table is written by no more tasks than twice the cores, and only until its stars are flat."""
    from tessera.llm import components as module
    tables, write = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: tables.append(write(df, name)) or tables[-1])
    most, before = 2 * spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(most + 40))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = [(1, x) for x in range(2, 60)] + [(x + 1000, x + 1001) for x in range(40)]
        got = module.components(spark.createDataFrame(links, "a long, b long"), rows=len(links)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dict(got) == {x: 1 for x in range(1, 60)} | {x: 1000 for x in range(1000, 1041)} and len(got) == 100
    assert max(len(t.inputFiles()) for t in tables) <= most


def test_no_links_no_rounds(spark, monkeypatch):
    from tessera.llm import components as module
    names, write = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or write(df, name))
    assert module.components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []
    assert "least" not in names
