"""Toxicity by compression distance.

Two pairs of zstandard dictionaries, one of toxic and one of ordinary text each, tell how much
shorter a window compresses with the toxic one:

* *Windows of several words* (``SPAN`` words, every ``STEP``) are compressed as they are.  The
  dictionaries are trained by zstandard's COVER trainer: a large common part from ordinary passages,
  and in front of it small parts trained on what is left to tell apart.  These parts come in stages,
  from passages that no earlier stage has found; in each, windows that stand out when scored by
  dictionaries of other folds are cut to their most telling words and trained on again.  How often
  each distance occurs in toxic and in ordinary passages (of other folds) is its evidence, so the
  threshold follows the number of windows.
* *Single words* (each different one of a passage once) are stretched before: each byte is written as ``STRETCH`` bytes that depend on it
  and all bytes before it, so that whole-byte lengths resolve single characters and only equal
  beginnings match.  Windows of plain text alone miss words that differ from ordinary ones in a few
  characters (figures in the README).  Their dictionaries hold common words, and the toxic one
  those typical of toxic passages (many times as frequent, counted by contexts), the ordinary one
  as many bytes of further words.  A word that begins like none of these has the distance 0: both
  dictionaries offer it the same common words.

A document is cut into even passages of at most ``PASSAGE`` words.  A passage's features are the
evidence of its different words and of its windows; a logistic curve gives its odds.  The odds of a document are the mean of its passages' odds: what a
passage must show grows with the number of passages, so length alone is no evidence, while one clear
passage, or weak signs in many, are.  The threshold of the score is 0.5.

Fitting reads a bounded sample: ``per_class`` passages of each class from the labelled documents with
text, drawn by hash so that every document counts alike whatever its length, collected to the driver.
Scoring reads every word of every document.

Null and empty texts have no windows and get the score of no evidence.  Repeated rows are scored
alike.  If a class has no labelled document the score is the same low value everywhere (there is
nothing to learn).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import worker_cache

STRETCH = 4
LONGEST = 64                # bytes of a window; longer words are several windows
PASSAGE = 256               # words that are judged together
LEVEL, SPAN_LEVEL = 6, 5
BASE_WORDS = 5_000          # words of ordinary text in either dictionary of words
CACHED_WORDS = 150_000      # distances in either half of a worker's cache
SPAN, STEP = 12, 8          # words of a window, and from one to the next: any five words in a row share one
COMMON, PART = 200_000, 2_000     # bytes of the common and of each telling part of the dictionaries
PARTS = 3                   # folds that measure each other
CLIP, WORD_CLIP = (-3, 12), (-12, 40)     # distances of spans and of words; those beyond count as these
START = 3                   # bytes that a word must share with a telling one to be compressed
_EDGE = b".,;:!?\"'()[]{}<>*_-"


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the evidence of each distance, for single words and for spans of
    several, and the weights of the logistic curve."""
    ordinary: bytes
    toxic: bytes
    starts: frozenset[bytes]
    weights: tuple[float, ...]
    evidence: tuple[float, ...] = (0.0,) * (WORD_CLIP[1] - WORD_CLIP[0] + 1)
    span_ordinary: bytes = b""
    span_toxic: bytes = b""
    span_evidence: tuple[float, ...] = (0.0,) * (CLIP[1] - CLIP[0] + 1)


def stretched(word: bytes, whole: bool = True) -> bytes:
    """``STRETCH`` bytes for each byte of a word, twice as many for the end of a whole one."""
    h, out = xxhash.xxh64(), []
    for i in range(len(word)):
        h.update(word[i:i + 1])
        out.append(h.digest()[:STRETCH])
    if whole:
        h.update(b" ")
        out.append(h.digest()[:2 * STRETCH])
    return b"".join(out)


def _compressors(ordinary: bytes, toxic: bytes, level: int = LEVEL):
    out = []
    for content in (ordinary, toxic):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                            write_checksum=False, write_dict_id=False))
    return out


class Distances:
    """Distance of a word: its compressed length with the ordinary dictionary minus with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes, starts: frozenset[bytes]):
        (self.c0, self.c1), self.starts, self.cache, self.old = _compressors(ordinary, toxic), starts, {}, {}

    def of(self, word: bytes) -> int:
        if word[:START] not in self.starts:
            return 0
        v = self.cache.get(word)
        if v is None:
            v = self.old.get(word)
            if v is None:
                x = stretched(word)
                v = len(self.c0.compress(x)) - len(self.c1.compress(x))
            if len(self.cache) >= CACHED_WORDS:        # the full half becomes the old one
                self.old, self.cache = self.cache, {}
            self.cache[word] = v
        return v

    def passage(self, words: list[bytes]) -> np.ndarray:
        """Distances of the different words of a passage."""
        different, starts = set(words), self.starts
        found = [self.of(w) for w in different if w[:START] in starts]
        return np.array(found + [0] * (len(different) - len(found)), np.int64)


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case without punctuation at their ends."""
    words = [w.strip(_EDGE) for w in text.lower().encode("utf-8", "replace").split()] if text else []
    if words and max(map(len, words)) > LONGEST:
        words = [w[i:i + LONGEST] for w in words for i in range(0, max(len(w), 1), LONGEST)]
    return words


def _table(toxic: list[np.ndarray], ordinary: list[np.ndarray], clip: tuple[int, int]) -> np.ndarray:
    """The evidence of each distance: the log of how much more frequent it is in toxic passages.
    Neighbouring distances are smoothed together.  A window that looks ordinary says little, as most
    windows of toxic texts do: evidence against is bounded."""
    n, shares = clip[1] - clip[0] + 1, []
    for lists in (toxic, ordinary):
        count = np.bincount(_clipped(np.concatenate([*lists, np.zeros(0, np.int64)]), clip), minlength=n).astype(float)
        count = np.convolve(np.pad(count, 1, "edge"), [0.25, 0.5, 0.25], "valid") + 0.5
        shares.append(np.log(count / count.sum()))
    return np.maximum(shares[0] - shares[1], -0.3)


def _clipped(distances: np.ndarray, clip: tuple[int, int]) -> np.ndarray:
    return np.clip(distances, *clip) - clip[0]


def _seen(distances: np.ndarray, table: np.ndarray, clip: tuple[int, int]) -> float:
    """The evidence of a passage's distances, bounded so that one passage can't outweigh all doubt."""
    return float(np.clip(table[_clipped(distances, clip)].sum(), -10, 20))


def passages(items: list) -> list[list]:
    """Even cuts of at most ``PASSAGE`` words; one, if there are none."""
    n = max(-(-len(items) // PASSAGE), 1)
    at = [len(items) * i // n for i in range(n + 1)]
    return [items[a:b] for a, b in zip(at, at[1:])]


def spans(words: list[bytes]) -> list[bytes]:
    """The windows of several words of a passage; each word is in one at least."""
    return [b" " + b" ".join(words[i:i + SPAN]) + b" " for i in range(0, max(len(words) - (SPAN - STEP), min(len(words), 1)), STEP)]


class Spans:
    """Distances of windows of several words."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.c0, self.c1 = _compressors(ordinary, toxic, SPAN_LEVEL)

    def of(self, windows: list[bytes]) -> np.ndarray:
        c0, c1 = self.c0.compress, self.c1.compress
        return np.array([len(c0(w)) - len(c1(w)) for w in windows], np.int64)

    def telling(self, window: bytes, most: int = 4) -> bytes:
        """The fewest words in a row, up to ``most``, that keep the largest distance."""
        words = window.split()
        parts = [b" " + b" ".join(words[i:i + n]) + b" " for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        return parts[int(self.of(parts).argmax())] if parts else window


class Judge:
    """Scores texts by a model."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Distances(model.ordinary, model.toxic, model.starts)
        self.spans = Spans(model.span_ordinary, model.span_toxic)
        self.evidence, self.span_evidence = np.array(model.evidence), np.array(model.span_evidence)

    def odds(self, words: list[bytes]) -> float:
        a, b, c = self.model.weights
        if not (b or c):
            return a
        return (a + b * _seen(self.words.passage(words), self.evidence, WORD_CLIP)
                + c * _seen(self.spans.of(spans(words)), self.span_evidence, CLIP))

    def score(self, text: str | None) -> float:
        odds = np.exp(np.clip([self.odds(p) for p in passages(windows(text))], -30, 30)).mean()
        return float(odds / (1 + odds))


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """A dictionary trained on the samples; the samples themselves, if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6, level=SPAN_LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _span_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], folds: list[list[int]], parts: int,
                       stages: int = 2, rounds: int = 2) -> tuple[bytes, bytes, list[np.ndarray], list[np.ndarray]]:
    """``(ordinary, toxic)`` dictionaries trained on the windows of toxic and of ordinary passages, and
    the distances of either's windows by dictionaries that their fold (of ``parts``) had no part in."""
    windows_of, fold = (toxic, ordinary), [np.array(f) % parts for f in folds]
    flat = lambda lists, keep: [w for x, k in zip(lists, keep) if k for w in x]
    everyone = parts                                       # the last set of dictionaries learns from all folds
    common = [_trained(COMMON, flat(ordinary, fold[1] != f), 64) for f in range(parts + 1)]
    found = [[(b"", b"")] * (parts + 1)]
    hidden = np.ones(len(toxic), bool)
    for _ in range(stages):
        samples = [[w if h else [] for w, h in zip(toxic, hidden)], ordinary]
        for _ in range(rounds):
            new = [tuple(_trained(PART, flat(samples[y], fold[1 - y] != f), 16) for y in (1, 0)) for f in range(parts)]
            pairs = [Spans(o + b0 + c, t + b1 + c) for (o, t), (b0, b1), c in
                     zip([(n[0], n[1]) for n in new], found[-1], common)]
            got = [[pairs[f].of(w) for w, f in zip(windows_of[y], fold[y])] for y in (0, 1)]
            plain = np.concatenate([*got[1], np.zeros(1, np.int64)])
            high, low = max(np.quantile(plain, 0.998), 1), min(np.quantile(plain, 0.002), -1)
            backward = [Spans.__new__(Spans) for _ in pairs]
            for x, p in zip(backward, pairs):
                x.c0, x.c1 = p.c1, p.c0
            samples = [[[pairs[f].telling(w) for w, d in zip(ws, ds) if d >= high] if h else []
                        for ws, ds, f, h in zip(toxic, got[0], fold[0], hidden)],
                       [[backward[f].telling(w) for w, d in zip(ws, ds) if d <= low] for ws, ds, f in zip(ordinary, got[1], fold[1])]]
        whole = tuple(_trained(PART, flat(samples[y], fold[1 - y] != everyone), 16) for y in (1, 0))
        found.append([(o + b0, t + b1) for (o, t), (b0, b1) in zip([*new, whole], found[-1])])
        mean = [np.array([d.mean() if len(d) else 0.0 for d in g]) for g in got]
        hidden = mean[0] <= np.quantile(mean[1], 0.99)
    o, t = found[-1][everyone]
    return o + common[everyone], t + common[everyone], got[0], got[1]


def _contexts(docs: list[list[bytes]]) -> Counter:
    """How many different neighbours each word, and each beginning of a word, occurs between."""
    seen = set()
    for d in docs:
        seen.update(zip(d, [b"", *d], [*d[1:], b""]))
    out: Counter = Counter()
    for w, n in Counter(w for w, _, _ in seen).items():
        out[w + b" "] += n
        for k in range(4, min(len(w), 12) + 1):
            out[w[:k]] += n
    return out


def _typical(toxic: list[list[bytes]], ordinary: list[list[bytes]], ratio: float) -> list[bytes]:
    """Words (with a blank) and beginnings of words that are at least ``ratio`` times as frequent in
    toxic text as in ordinary text, the most frequent last.  A fifth of that is enough for what
    begins with something typical: rare words of a family then count with the family."""
    n1, n0 = _contexts(toxic), _contexts(ordinary)
    per1, per0 = max(len(toxic), 1), max(len(ordinary), 1)
    odds = {x: n / per1 / ((n0[x] + 0.3) / per0) for x, n in n1.items()}
    family = {x for x, r in odds.items() if r >= ratio and n1[x] >= 4}
    relatives = set()
    for x, r in odds.items():
        if ratio > r >= ratio / 5 and n1[x] >= 2 and any(x[:k] in family for k in range(4, len(x))):
            relatives.add(x)
    return sorted(family | relatives, key=lambda x: (n1[x], x))


def _word_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], ratio: float) -> tuple[bytes, bytes, frozenset[bytes]]:
    """``(ordinary, toxic)`` dictionaries of stretched words, and how the words that differ begin."""
    common = Counter()
    for p in ordinary:
        common.update(set(p))
    ranked = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    base = b"".join(stretched(w) for w in ranked[:BASE_WORDS][::-1])
    typical = _typical(toxic, ordinary, ratio)
    extra, more, further = b"".join(stretched(x.rstrip(b" "), x.endswith(b" ")) for x in typical), b"", []
    for w in ranked[BASE_WORDS:]:
        if len(more) >= len(extra):
            break
        more += stretched(w)
        further.append(w)
    # small enough for the match finder to keep every position of either
    return more + base, extra + base, frozenset(x.rstrip(b" ")[:START] for x in (*typical, *further))


def _logistic(x: np.ndarray, y: np.ndarray, part: np.ndarray, prior: float, expected: tuple[float, ...] = (0.0, 1.0, 0.4),
              trust: tuple[float, ...] = (0.01, 5.0, 5.0), rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression drawn to what is ``expected`` (with ``trust``, which few rows
    can't outweigh); a row counts as ``part`` of a document, the toxic class as ``prior`` of all."""
    w, ridge = np.array(expected), np.diag(trust)
    share = part * np.where(y == 1, prior / (part * y).sum(), (1 - prior) / (part * (1 - y)).sum()) * part.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (share * (p - y)) + ridge @ (w - expected))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_passages(docs: DataFrame, labels: DataFrame, is_training: Column, per_class: int, id_col: str, text_col: str,
                    label_col: str) -> list[tuple[int, int, float, list[bytes]]]:
    """``(label, fold, part, words)`` of at most ``per_class`` passages of each class; ``part`` is the
    passage's share of its document.  Passages are drawn by hash with the odds of their part."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
              .where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).where(is_training).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    n = F.greatest(F.ceil(F.size(F.split("text", " ")) / F.lit(PASSAGE)), F.lit(1))
    places = (texts.select("id", F.xxhash64("text").alias("h"), n.alias("n")).join(marked, "id")
              .select("id", "h", "y", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("p")))
    key = -F.log((F.shiftrightunsigned(F.xxhash64("id", "h", "p"), 11).cast("double") + 0.5) * (2.0 ** -53)) * F.col("n")
    out = []
    for y in (1, 0):
        chosen = places.where(F.col("y") == y).orderBy(key, "id", "h", "p").limit(per_class).groupBy("id", "h").agg(
            F.collect_set((F.col("p") - 0.5) / F.col("n")).alias("at"))

        def cut(batches):
            for b in batches:
                got, parts = [], []
                for t, at in zip(b.column(1), b.column(2)):
                    p = passages(windows(t.as_py()))
                    got.append([p[int(len(p) * x)] for x in at.as_py()])
                    parts.append(1 / len(p))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.list_(pa.binary()))), pa.array(parts, pa.float64())],
                                                 names=["fold", "p", "part"])

        fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(1 << 20)).cast("int").alias("fold")
        rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"]).select(
            fold, "text", "at").mapInArrow(cut, "fold int, p array<array<binary>>, part double").collect()
        out += sorted((y, r["fold"], r["part"], list(map(bytes, p))) for r in rows for p in r["p"])
    return out


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, per_class: int = 1200, ratio: float = 40.0,
        prior: float = 0.2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``2 * per_class`` passages (the one bound on what is learnt from).  ``ratio``:
    how many times as frequent a typical word is in toxic text; ``prior``: the share of toxic documents
    to expect.  ``is_training``: a condition on the column ``id`` that says which labelled rows may be
    learnt from."""
    rows = sample_passages(docs, labels, is_training, per_class, id_col, text_col, label_col)
    toxic, ordinary = [[(f % PARTS, p) for y, f, _, p in rows if y == kind] for kind in (1, 0)]
    m0, m1, starts = _word_dictionaries([p for _, p in toxic], [p for _, p in ordinary], ratio)
    if not toxic or not ordinary:
        return Model(m0, m1, starts, (-3.0, 0.0, 0.0))
    # what a passage shows is measured by dictionaries that its own document had no part in
    judges = [Distances(*_word_dictionaries(*[[p for g, p in x if g != f] for x in (toxic, ordinary)], ratio)) for f in range(PARTS)]
    words = [[judges[f].passage(p) for f, p in x] for x in (toxic, ordinary)]
    s0, s1, *found = _span_dictionaries(*[[spans(p) for _, p in x] for x in (toxic, ordinary)],
                                        [[f for f, _ in x] for x in (toxic, ordinary)], PARTS)
    e, se = _table(*words, WORD_CLIP), _table(*found, CLIP)
    x = np.array([(1.0, _seen(w, e, WORD_CLIP), _seen(d, se, CLIP)) for w, d in zip(sum(words, []), sum(found, []))])
    y, part = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows])
    weights = tuple(float(v) for v in _logistic(x, y, part, prior))
    return Model(m0, m1, starts, weights, tuple(e.tolist()), s0, s1, tuple(se.tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """``id_col, *keep, score`` for every row; ``score`` in 0..1, toxic from 0.5."""
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    out = rows.drop("_text").withColumn("score", F.lit(0.0))

    def run(batches):
        cache = worker_cache(f"toxicity:{hash((model.ordinary, model.toxic, model.span_toxic))}")
        if "judge" not in cache:
            cache["judge"] = Judge(model)
        judge = cache["judge"]
        for batch in batches:
            got = [judge.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())],
                                             names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, out.schema)
