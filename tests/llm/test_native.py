"""URL filters, mixing and sharding against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import mixing, sharding, url_filter
from tessera.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string"
URLS = [None, "", "no scheme", "http://", "http://a.NET", "http://a.net/", "HTTP://X.Example.NET/en/1", "x://example.net/en",
        "http://example.com/de/9?q=/fr/", "http://b.example.com/de", "http://example.org/fr/#/en/", "http://org?/fr/",
        "http://a..net/x", "http://net:80/", "http://u@org/fr/", "http://notnet/", "http://x.net./", "a://b://c.net/",
        "http://deep.sub.org/fr/x/y", "http://example.net/en/", "http://EXAMPLE.net/EN/", "http://é.net/ü", "http://org/fr/a\nb"]


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("rules", [URL_RULES, [], [("net", "", "block"), ("net", "/x", "allow"), ("org", "/fr/x/y", "allow"),
                                                   ("ORG", "/fr/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")]])
def test_judge_urls(spark, same, rules):
    pages = spark.createDataFrame([(i % 20, u, "", "h", "p", "r", "v") for i, u in enumerate(URLS * 2)] + [
        (None, "http://a.net/", "", "h", "p", "r", "v")], PAGES)
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    plain = [(h.lower(), p, v) for h, p, v in rules if h is not None]
    expected = [(i % 20, *plain_judge(u, plain)) for i, u in enumerate(URLS * 2)] + [(None, *plain_judge("http://a.net/", plain))]
    got = url_filter.judge_urls(pages, r)
    assert same(got, "page_id", "host", "path", "rule", "verdict") == sorted(expected, key=repr)
    assert url_filter.judge_urls(pages.limit(0), r).collect() == []


def fill(sizes, weights, repeats=3):
    """Targets by sharing the excess again until no source is above its limit."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(repeats * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [repeats * s if i in full else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and t[i] > repeats * sizes[i]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 500, 900, 3], [0, 0, 50], [1, 1, 1, 1, 1, 1, 1000], [5], [0, 0]])
def test_targets(spark, sizes):
    rows = [(f"=s{i}", f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(
        rows, "source_key string, source string, size long")).collect()}
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert [got[f"=s{i}"] for i in range(len(sizes))] == pytest.approx(fill(sizes, weights))


def test_mix(corpus, same):
    got = mixing.mix(corpus, block_words=64, shards=5)
    rows = got.collect()
    docs = corpus.select("doc_id", "text", "source").collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(((d["doc_id"], size(d["text"])) for d in docs), key=repr)
    per = Counter()
    for d in docs:
        per[d["source"]] += size(d["text"])
    names = sorted(per, key=lambda s: (s is None, s))
    targets = dict(zip(names, fill([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken, most = defaultdict(int), defaultdict(int)
    by_target = {round(t, 6): s for s, t in targets.items()}
    for r in rows:
        s = by_target[round(r["target"], 6)]
        assert r["source_size"] == per[s] and r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] == len(r["placements"]) * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - targets[s]) <= most[s] / 2 + 1 for s in targets)
    # every block lies in one shard, and shards hold equally many blocks
    blocks = {(r["source_size"], p["block"]): p["shard"] for r in rows for p in r["placements"]}
    assert all(blocks[(r["source_size"], p["block"])] == p["shard"] for r in rows for p in r["placements"])
    n = Counter(blocks.values())
    assert set(n) <= set(range(5)) and max(n.values()) - min(n.values()) <= 1
    cols = ("doc_id", "size", "taken", "target")
    assert same(mixing.mix(corpus.repartition(3), block_words=64, shards=5), *cols) == same(got, *cols)
    copies = mixing.mixed_documents(corpus.select("doc_id", "text", "source"), got)
    assert copies.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(corpus.limit(0)).collect() == []


def test_sharding(corpus, no_docs):
    tree = sharding.even_tree(8)
    rows = sharding.shard_rows(corpus, tree, sharding.grow(tree, 8)).collect()
    docs = corpus.select("doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(
        ((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs), key=repr)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.shard_rows(no_docs, tree).collect() == []


def test_sharding_is_even_and_moves_only_into_changed_subtrees(spark):
    ids = spark.range(40000).selectExpr("id as doc_id", "'' as text")
    tree = sharding.even_tree(8)
    a = {r["doc_id"]: r for r in sharding.shard_rows(ids, tree, sharding.grow(tree, 8)).collect()}
    n, moved = Counter(r["shard"] for r in a.values()), sum(r["grown_shard"] == 8 for r in a.values())
    assert all(abs(x - 5000) < 400 for x in n.values()) and abs(moved - 40000 / 9) < 400
    # a heavier shard takes keys, from other regions only through its own
    big = sharding.inner("root", [tree.children[0], sharding.inner("region1", [tree.children[1].children[0], sharding.inner(
        "rack3", [sharding.Node("shard6", 3.0, 6), sharding.Node("shard7", 1.0, 7)])])])
    for r in sharding.shard_rows(ids, big).collect():
        old = a[r["doc_id"]]["shard"]
        assert (old < 4) >= (r["shard"] < 4) and (r["shard"] in (4, 5)) <= (old < 6)
