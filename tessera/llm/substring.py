"""Substring deduplication with repeated-phrase automata.

A window is ``span`` consecutive words.  A word goes if a window that covers it also starts in a
document with a smaller id.  Three passes:

1. Documents with equal word sequences are one class; only the smallest id of a class is looked at
   further (in the others every window starts in a smaller document, so all goes).  Each class
   reports its anchor phrases (see ``anchors``); phrases of at least two documents recur.
2. Every document that holds recurring phrases meets them by a join.  A task compiles the phrases
   of its shard of documents into an Aho-Corasick automaton over word numbers (``pyahocorasick``)
   and streams the documents through it: every place where a phrase occurs marks the windows around
   it.  Shards hold at most ``shard_words`` words, so automata are bounded however many phrases
   recur in the corpus.
3. Marked windows are confirmed by 96 bits of the digest of their words (xxh3, not the polynomial
   that finds phrases): the smallest document of each digest owns the
   window, and all other documents lose it.  Aggregation starts before the shuffle, and the join
   back to the windows is an inner join that the skew join can split.

Null text has no words.  Null ids come after all others; rows that share an id, or have none, are
not smaller than each other.  Repeated rows are judged alike.  A document with fewer than ``span``
words loses nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import owners, per_text, recurring
from tessera.llm.common import stored, worker_cache
from tessera.llm.shingles import rolling, word_hashes

PHRASE = 12                  # words of an anchor phrase
LAST = (1 << 63) - 1         # order of a null id


def _words(text) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _digest(joined: bytes) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(joined), "<i8").tolist()


def _scan(span: int):
    """Per row: id, MD5 of the text, number of words, digest of the words, SHA-256 of all words, anchors and places."""
    def run(batches):
        worker_cache("substring")            # empties what other operators keep
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                cols = [[] for _ in range(6)]
                for t in part.column(1):
                    w = _words(t.as_py())
                    joined = b" ".join(w)
                    anchor = at = np.empty(0, np.int64)
                    if len(w) >= span:
                        h = rolling(word_hashes(w), PHRASE)
                        at = np.unique(owners(h, PHRASE, span))
                        anchor, first = np.unique(h[at].view(np.int64), return_index=True)
                        at = at[first]
                    x, y = _digest(joined)
                    for c, v in zip(cols, (len(w), x, y, hashlib.sha256(joined).hexdigest(), anchor, at.astype(np.int32))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
                    pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int32()))],
                    names=["id", "md5", "n_words", "d1", "d2", "sha", "anchors", "places"])

    return run


def _phrase_hits(docs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Starts of recurring phrases in each document of a shard.  ``docs``: word numbers and the
    places of the document's own recurring phrases."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    seqs = [tuple(x.tolist()) for x, _ in docs]
    for s, (_, places) in zip(seqs, docs):
        for p in places:
            auto.add_word(s[p:p + PHRASE])
    auto.make_automaton()
    return [np.fromiter((end - PHRASE + 1 for end, _ in auto.iter(s)), np.int64) for s in seqs]


def _window_digests(words: list[bytes], start: np.ndarray, span: int) -> np.ndarray:
    """A row of 12 bytes for each window: xxh3 of its words, joined by one blank."""
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    digest = xxhash.xxh3_128_digest
    got = b"".join([digest(joined[a:z])[:12] for a, z in
                    zip((end[start] - [len(words[s]) for s in start.tolist()]).tolist(), end[start + span - 1].tolist())])
    return np.frombuffer(got, np.uint8).reshape(-1, 12)


def _locate(span: int, shard_words: int):
    """Documents with their recurring phrases -> marked windows with digests (and the text)."""
    def shard(rows):
        h = [word_hashes(w) for w in (x[2] for x in rows)]
        # the automaton's letters are 32-bit word numbers; what it finds is confirmed by digest
        hits = _phrase_hits([((x & np.uint64(0x7FFFFFFF)).astype(np.int64), np.asarray(p)) for x, (*_, p) in zip(h, rows)])
        cols = [[] for _ in range(6)]
        for x, found, (m, t, w, text, _) in zip(h, hits, rows):
            n = len(x) - span + 1
            edge = np.zeros(len(x) + 2, np.int64)      # windows p-span+PHRASE .. p hold the phrase at p
            np.add.at(edge, np.maximum(found - span + PHRASE, 0), 1)
            np.add.at(edge, np.minimum(found, n - 1) + 1, -1)
            start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            g = _window_digests(w, start, span)
            for c, v in zip(cols, (m, t, text, start.astype(np.int32), g[:, :8].copy().view("<i8").ravel(),
                                   g[:, 8:].copy().view("<i4").ravel())):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)],
                                          names=["m", "t", "text", "start", "g1", "g2"])

    def run(batches):
        rows, words = [], 0
        for b in batches:
            for m, t, text, places in zip(*[b.column(i) for i in range(4)]):
                w = _words(text.as_py())
                rows.append((m.as_py(), t.as_py(), w, text.as_py(), places.as_py()))
                words += len(w)
                if words >= shard_words:
                    yield shard(rows)
                    rows, words = [], 0
        if rows:
            yield shard(rows)

    return run


def _cut(span: int, keep_texts: bool):
    """Texts with the starts of the windows to remove -> number of words removed, digest of the rest."""
    def run(batches):
        for b in batches:
            n, sha, kept = [], [], []
            for text, starts in zip(b.column(2), b.column(3)):
                w = _words(text.as_py())
                edge = np.zeros(len(w) + span + 1, np.int64)
                s = np.asarray(starts.as_py(), np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + span, -1)
                gone = np.cumsum(edge)[:len(w)] > 0
                n.append(int(gone.sum()))
                rest = b" ".join([x for x, g in zip(w, gone) if not g])
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode())
            out = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            names = ["m", "t", "gone", "rest", "kept"]
            yield pa.RecordBatch.from_arrays(out[:4 + keep_texts], names=names[:4 + keep_texts])

    return run


def drop_repeated_windows(docs: DataFrame, span: int = 50, shard_words: int = 200_000, id_col: str = "doc_id",
                          text_col: str = "text", keep_texts: bool = False) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` for every row; ``keep_texts`` adds ``kept``: the
    kept words joined by one blank, or null where no word goes (the text stays as it is), and
    ``md5`` of the text: id and text together name a row, as ids may be null or repeat."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        F.md5(F.col(text_col).cast("binary")).alias("md5"))
    signed = stored(texts.mapInArrow(_scan(span), "id long, md5 string, n_words long, d1 long, d2 long, sha string, "
                                                  "anchors array<bigint>, places array<int>"), "sub-signed")
    order = F.coalesce("id", F.lit(LAST))
    # a class: equal word sequences; m: its smallest id; t: its number, as ids may be null or repeat;
    # own_md5: a text that stands for the class
    classes = stored(signed.where(F.col("n_words") >= span).groupBy("d1", "d2")
                     .agg(F.min(F.struct(order.alias("m"), "md5")).alias("f"))
                     .select("d1", "d2", "f.m", F.col("f.md5").alias("own_md5"),
                             F.monotonically_increasing_id().alias("t")), "sub-classes")
    spread = F.coalesce("t", "d1").alias("t")         # short texts have no class; m is null and joins with nothing
    is_first = F.coalesce(order == F.col("m"), F.lit(False))
    member = stored(signed.join(classes, ["d1", "d2"], "left")
                    .select("id", "md5", "n_words", "sha", "m", spread, is_first.alias("first"),
                            F.when(is_first, F.arrays_zip("anchors", "places")).alias("a")), "sub-members")
    rows = (member.where("first").select("m", "t", F.explode("a").alias("x"))
            .select("m", "t", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place")))
    found = recurring(rows, "lo < hi", lo=F.min("m"), hi=F.max("m"))
    lists = per_text(rows, found, ["m", "t"], "place", "places")

    # the texts that hold recurring phrases, one document of each class
    wanted = lists.join(classes.select("t", "own_md5"), "t").select(
        "m", "t", "places", "own_md5", F.when(F.col("m") != LAST, F.col("m")).alias("own"))
    is_own = F.col("id").eqNullSafe(F.col("own")) & (F.col("md5") == F.col("own_md5"))
    marked = stored(texts.join(wanted, is_own).select("m", "t", "text", "places")
                    .mapInArrow(_locate(span, shard_words), "m long, t long, text string, start array<int>, "
                                                            "g1 array<bigint>, g2 array<int>"), "sub-windows")
    windows = (marked.select("m", "t", F.explode(F.arrays_zip("start", "g1", "g2")).alias("w"))
               .select("m", "t", "w.start", "w.g1", "w.g2"))
    owner = stored(windows.groupBy("g1", "g2").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
                   .where("lo < hi").select("g1", "g2", "lo"), "sub-owners")
    lost = stored(windows.join(owner, ["g1", "g2"]).where("m > lo").groupBy("m", "t")
                  .agg(F.collect_set("start").alias("starts")), "sub-lost")
    cut = stored(marked.select("m", "t", "text").join(lost, ["m", "t"]).mapInArrow(
        _cut(span, keep_texts), "m long, t long, gone long, rest string" + ", kept string" * keep_texts), "sub-cut")
    per_class = cut.groupBy("m", "t").agg(*[F.first(c).alias(c) for c in cut.columns[2:]])   # repeated rows

    nothing = hashlib.sha256(b"").hexdigest()
    firsts = member.where("first").drop("a").join(per_class, ["m", "t"], "left").select(
        "id", "n_words", F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce("rest", "sha").alias("kept_sha256"),
        "m", "t", *["kept", "md5"] * keep_texts)
    all_gone = F.col("n_words") >= span
    others = member.where("not first").select(
        "id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(nothing)).otherwise(F.col("sha")).alias("kept_sha256"), "m", "t",
        *[F.when(all_gone, F.lit("")).alias("kept"), F.col("md5")] * keep_texts)
    out = firsts.unionByName(others).withColumnRenamed("id", id_col)
    return out.select(id_col, "n_words", "n_removed", "kept_sha256", *["kept", "md5"] * keep_texts)
