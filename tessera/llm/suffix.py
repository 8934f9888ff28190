"""Exact substring deduplication by a distributed, prefix-aware merge sort of suffixes.

Every byte covered by a string of ``span`` bytes that also starts anywhere else goes.

1. Equal texts are one class: a text that occurs twice and has ``span`` bytes goes whole, and one
   copy of it stands for all.  Each class reports its anchors (see ``anchors``: every window of
   ``span`` bytes has one, at the same place in each occurrence).  Anchors that occur once are done
   with: no window around them repeats.
2. Texts with repeated anchors meet them by a join.  An anchor and the bytes its windows reach are one
   suffix (from the anchor on) with its left context.  Tasks sort their suffixes, front-code them
   into runs per bucket (by anchor, so equal beginnings meet), and exchange the runs.
3. Each bucket merges its runs with a loser tree that never compares known prefixes again
   (``merge``).  The merged order and its common prefixes split the suffixes into groups that agree
   for ``d`` bytes, for any ``d``; a window that begins ``j`` bytes left of its anchor repeats if
   another suffix of its group for ``span - j`` bytes has the same ``j`` bytes to the left.

A run holds each string (left context and suffix) once, with the list of its places, so a passage
that is everywhere the same is one string per run however often it occurs.  Buckets are numerous
enough to hold about ``bucket_rows`` strings each.  Anchors with more occurrences than that may
still have many different strings: where a bucket of theirs does, its windows are split in two by
their place around the anchor, again and again: all windows of a part share what lies in all of
them (the *core*), so strings are dealt by their cores, and cut to what the part needs, equal ones
become one.  A part of a single place holds one string per core and run.

Null text is empty.  Ids only name the rows: null and repeated ids are kept, repeated rows are
copies of each other.  Texts shorter than ``span`` lose nothing.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import owners
from tessera.llm.common import stored
from tessera.llm.merge import decoded, front_coded, merge_runs
from tessera.llm.shingles import mixed, rolling

PHRASE = 32                  # bytes of an anchor
CHUNK = 1 << 20              # window starts handled at once in a long text
LAST = (1 << 63) - 1


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _owned(x: bytes, span: int):
    """``(first window start, hashes of the runs, anchor of each window)`` chunk by chunk."""
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for a in range(0, len(x) - span + 1, CHUNK):
        h = rolling(codes[np.frombuffer(x, np.uint8, min(CHUNK + span - 1, len(x) - a), a)], PHRASE)
        yield a, h, owners(h, PHRASE, span)


def _class_key(x: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(x), "<i8").tolist())


def _scan(span: int):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                cols = [[] for _ in range(6)]
                for t in part.column(1):
                    x = _bytes(t.as_py())
                    places, anchors = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for at, h, own in _owned(x, span):
                        p = np.unique(own)
                        places.append(p + at)
                        anchors.append(h[p].view(np.int64))
                    places, first = np.unique(np.concatenate(places), return_index=True)
                    for c, v in zip(cols, (len(x), *_class_key(x), hashlib.sha256(x).hexdigest(),
                                           np.concatenate(anchors)[first], places)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()),
                    pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))],
                    names=["id", "md5", "n_bytes", "d1", "d2", "sha", "anchors", "places"])

    return run


def _members(x: bytes, span: int, places: np.ndarray):
    """``(place, first start, last start)`` of the windows whose anchor is at one of ``places``."""
    for at, _, own in _owned(x, span):
        near = places[(places >= at) & (places <= at + int(own[-1]))] - at
        lo, hi = np.searchsorted(own, near, "left"), np.searchsorted(own, near, "right")
        for p, a, b in zip((near + at).tolist(), (lo + at).tolist(), (hi + at - 1).tolist()):
            if a <= b:
                yield p, a, b


RUN = ("bucket bigint, lo int, hi int, strings bigint, copies array<int>, m array<bigint>, t array<bigint>, p array<bigint>, "
       "near array<int>, far array<int>, shared array<int>, rest array<binary>, `left` array<binary>")
_LONGS, _INTS, _BYTES = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())
_RUN = pa.schema([("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("strings", pa.int64()), ("copies", _INTS),
                  ("m", _LONGS), ("t", _LONGS), ("p", _LONGS), ("near", _INTS), ("far", _INTS), ("shared", _INTS),
                  ("rest", _BYTES), ("left", _BYTES)])


class _Held:
    """Strings of a run in the making: bucket -> string -> places.  A string is ``(suffix, left, near,
    far)``: its windows begin ``near`` to ``far`` bytes left of the anchor."""

    def __init__(self):
        self.buckets, self.size = {}, 0

    def add(self, bucket, string, places):
        self.buckets.setdefault(bucket, {}).setdefault(string, []).extend(places)
        self.size += len(places)

    def flushed(self) -> pa.RecordBatch:
        out = {name: [] for name in _RUN.names}
        for (bucket, lo, hi), strings in self.buckets.items():
            rows = sorted(strings.items())
            shared, rest = front_coded([s[0] for s, _ in rows])
            places = [x for _, p in rows for x in p]
            for name, v in zip(out, (bucket, lo, hi, len(rows), [len(p) for _, p in rows], *[[x[i] for x in places] for i in range(3)],
                                     [s[2] for s, _ in rows], [s[3] for s, _ in rows], shared, rest, [s[1] for s, _ in rows])):
                out[name].append(v)
        self.__init__()
        return pa.RecordBatch.from_pydict(out, _RUN)


def _runs(span: int, buckets: int, run_rows: int, hot: bool):
    """Texts with their repeated anchors -> sorted, front-coded runs of suffixes per bucket."""
    def run(batches):
        held = _Held()
        for b in batches:
            for m, t, text, anchors in zip(*[b.column(i) for i in range(4)]):
                places = np.array(sorted(a["place"] for a in anchors.as_py() if a["hot"] == hot), np.int64)
                if not len(places):
                    continue
                x, m, t = _bytes(text.as_py()), m.as_py(), t.as_py()
                for p, first, last in _members(x, span, places):
                    suffix = x[p:last + span]
                    bucket = (xxhash.xxh32_intdigest(suffix[:PHRASE]) % buckets, 0, span - PHRASE)
                    held.add(bucket, (suffix, x[first:p], p - last, p - first), [(m, t, p)])
                    if held.size >= run_rows:
                        yield held.flushed()
        if held.size:
            yield held.flushed()

    return run


def _strings(row: dict):
    """``(string, places)`` of a run."""
    at = 0
    for (suffix, _), left, near, far, n in zip(decoded(row["shared"], row["rest"]), row["left"], row["near"], row["far"], row["copies"]):
        yield (suffix, left, near, far), list(zip(*[row[c][at:at + n] for c in ("m", "t", "p")]))
        at += n


def _halved(span: int, buckets: int, run_rows: int, level: int):
    """Runs of buckets that hold too many strings -> runs of either half of their windows, dealt by core."""
    def run(batches):
        held = _Held()
        for b in batches:
            for row in b.to_pylist():
                middle = (row["lo"] + row["hi"]) // 2
                for (suffix, left, near, far), places in _strings(row):
                    for lo, hi in ((row["lo"], middle), (middle + 1, row["hi"])):
                        n, f = max(near, lo), min(far, hi)
                        if n > f:
                            continue
                        core = left[len(left) - lo:] + suffix[:span - hi]
                        bucket = (level << 40) + xxhash.xxh64_intdigest(core, lo) % buckets
                        held.add((bucket, lo, hi), (suffix[:span - n], left[len(left) - f:], n, f), places)
                    if held.size >= run_rows:
                        yield held.flushed()
        if held.size:
            yield held.flushed()

    return run


def repeated_offsets(shared: np.ndarray, near: np.ndarray, far: np.ndarray, left: list[bytes], span: int) -> np.ndarray:
    """For suffixes in order, with the prefix each shares with the one before: which windows repeat.
    ``out[i, j]``: the window that begins ``j`` bytes left of suffix ``i``, ``near <= j <= far``."""
    n, widest = len(shared), int(far.max(initial=0))
    out = np.zeros((n, widest + 1), bool)
    before = np.zeros((n, widest), np.uint64)              # bytes to the left, nearest first
    for i, x in enumerate(left):
        before[i, :len(x)] = np.frombuffer(x[::-1], np.uint8)
    context = np.zeros(n, np.uint64)
    for j in range(widest + 1):
        if j:
            context = context * np.uint64(0x9E3779B97F4A7C15) + before[:, j - 1] + np.uint64(1)
        valid = np.flatnonzero((near <= j) & (j <= far))
        group = np.cumsum(shared < span - j).astype(np.uint64)
        key = mixed(mixed(group) + context)[valid]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[valid[order[1:][same]], j] = True
        out[valid[order[:-1][same]], j] = True
    return out


def _merge_bucket(span: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [decoded(s, r) for s, r in zip(pdf["shared"], pdf["rest"])]
        fields = [pdf[c].tolist() for c in ("near", "far", "left")]
        places = [np.split(np.stack([r[c] for c in ("m", "t", "p")], axis=1), np.cumsum(r["copies"])[:-1]) for _, r in pdf.iterrows()]
        at = [0] * len(runs)
        rows, own, shared, seen, least = [], [], [], set(), span
        for r, n in merge_runs(runs):
            row = tuple(f[r][at[r]] for f in fields)
            mine = [x for x in map(tuple, places[r][at[r]].tolist()) if (*x, row[0]) not in seen]
            at[r] += 1
            least = min(least, n)
            if not mine:                                   # the same text read twice
                continue
            mine = list(dict.fromkeys(mine))
            seen.update((*x, row[0]) for x in mine)
            rows.append(row)
            own.append(mine)
            shared.append(least if len(rows) > 1 else 0)
            least = span
        out = {"m": [], "t": [], "lo": [], "hi": []}

        def put(row, a, b):
            """The windows that begin ``a`` to ``b`` bytes left of the anchor go, at each place."""
            for m, t, p in own[row]:
                for c, v in zip(out.values(), (m, t, p - b, p - a + span)):
                    c.append(v)

        # a string at several places repeats whole; one that shares little with both neighbours has no repeated window
        shared, far = np.array(shared), np.array([r[1] for r in rows])
        several = np.array([len(x) > 1 for x in own], bool)
        for i in np.flatnonzero(several).tolist():
            put(i, rows[i][0], rows[i][1])
        touch = np.maximum(shared, np.append(shared[1:], 0)) >= span - far
        keep = np.flatnonzero(touch)
        if len(keep):
            # the prefix shared by two kept neighbours is the least of those between them
            cut = np.minimum.reduceat(shared[:keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            kept = [rows[i] for i in keep]
            dup = repeated_offsets(cut, np.array([r[0] for r in kept]), far[keep], [r[2] for r in kept], span)
            dup[several[keep]] = False                     # these are out already
            edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            for row, a, b in zip(keep[i].tolist(), lo.tolist(), hi.tolist()):
                put(row, a, b - 1)
        return pd.DataFrame(out).astype({"m": "int64", "t": "int64", "lo": "int64", "hi": "int64"})

    return run


def _cut(keep_texts: bool):
    """Texts with the spans to remove -> bytes and spans removed, digest of the rest."""
    def run(batches):
        for b in batches:
            cols = [[] for _ in range(4)]
            for text, spans in zip(b.column(2), b.column(3)):
                x = _bytes(text.as_py())
                out, end, gone, runs = [], 0, 0, 0
                for s in sorted((s["lo"], s["hi"]) for s in spans.as_py()):
                    if s[0] > end or not runs:
                        out.append(x[end:s[0]])
                        gone, runs, end = gone + s[1] - s[0], runs + 1, s[1]
                    elif s[1] > end:
                        gone, end = gone + s[1] - end, s[1]
                out.append(x[end:])
                rest = b"".join(out)
                for c, v in zip(cols, (gone, runs, hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            got = [b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                   pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())]
            names = ["m", "t", "gone", "runs", "rest", "kept"]
            yield pa.RecordBatch.from_arrays(got[:5 + keep_texts], names=names[:5 + keep_texts])

    return run


def drop_repeated_strings(docs: DataFrame, span: int = 200, bucket_rows: int = 20_000,
                          run_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
                          keep_bytes: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for every row; ``keep_bytes`` adds
    ``kept``: the remaining bytes, or null where nothing goes (the text stays as it is)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        F.md5(F.col(text_col).cast("binary")).alias("md5"))
    signed = stored(texts.mapInArrow(_scan(span), "id long, md5 string, n_bytes long, d1 long, d2 long, sha string, "
                                                  "anchors array<bigint>, places array<bigint>"), "suf-signed")
    order = F.coalesce("id", F.lit(LAST))
    # t: the number of a class, as ids may be null or repeat
    classes = stored(signed.where(F.col("n_bytes") >= span).groupBy("d1", "d2").agg(
        F.min(order).alias("m"), F.count(F.lit(1)).alias("copies"), F.min("md5").alias("own_md5"))
        .withColumn("t", F.monotonically_increasing_id()), "suf-classes")
    spread = F.coalesce("t", "d1").alias("t")         # short texts have no class; m is null and joins with nothing
    is_first = F.coalesce(order == F.col("m"), F.lit(False))
    member = stored(signed.join(classes, ["d1", "d2"], "left").select(
        "id", "n_bytes", "sha", "m", spread, F.coalesce("copies", F.lit(1)).alias("copies"),
        F.when(is_first, F.arrays_zip("anchors", "places")).alias("a")), "suf-members")
    # repeated rows under one id would count an anchor twice; that only makes it a candidate
    rows = (member.where("a is not null").select("m", "t", F.explode("a").alias("x"))
            .select("m", "t", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place")))
    found = stored(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("anchor", (F.col("n") > bucket_rows).alias("hot")), "suf-repeated")
    lists = stored(rows.join(found, "anchor").groupBy("m", "t").agg(
        F.collect_set(F.struct("place", "hot")).alias("at")), "suf-lists")
    wanted = lists.join(classes.select("t", "own_md5"), "t").select(
        "m", "t", "at", "own_md5", F.when(F.col("m") != LAST, F.col("m")).alias("own"))
    is_own = F.col("id").eqNullSafe(F.col("own")) & (F.col("md5") == F.col("own_md5"))
    open_texts = stored(texts.join(wanted, is_own).select("m", "t", "text", "at"), "suf-texts")

    n = lists.agg(F.sum(F.size("at"))).first()[0] or 0
    buckets = max(64, -(-n // bucket_rows))
    parts = [open_texts.mapInArrow(_runs(span, buckets, run_rows, False), RUN)]
    often = open_texts.where(F.exists("at", lambda a: a["hot"])).mapInArrow(_runs(span, buckets, run_rows, True), RUN)
    level = 1
    while True:
        often = stored(often, "suf-runs")
        full = stored(often.groupBy("bucket").agg(F.sum("strings").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("width"))
                      .where((F.col("n") > bucket_rows) & (F.col("width") > 0)).select("bucket"), "suf-full")
        parts.append(often.withColumn("bucket", F.col("bucket") + F.lit(level << 48)).join(
            full.select((F.col("bucket") + F.lit(level << 48)).alias("bucket")), "bucket", "left_anti"))
        if full.isEmpty():
            break
        often = often.join(full, "bucket", "left_semi").mapInArrow(_halved(span, buckets, run_rows, level), RUN)
        level += 1
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.unionByName(p)
    merged = runs.groupBy("bucket").applyInPandas(_merge_bucket(span), "m long, t long, lo long, hi long")
    spans = stored(merged.groupBy("m", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suf-spans")
    cut = stored(open_texts.select("m", "t", "text").join(spans, ["m", "t"]).mapInArrow(
        _cut(keep_bytes), "m long, t long, gone long, runs long, rest string" + ", kept binary" * keep_bytes), "suf-cut")
    per_class = cut.groupBy("m", "t").agg(*[F.first(c).alias(c) for c in cut.columns[2:]])

    nothing = hashlib.sha256(b"").hexdigest()
    repeated = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    single = member.where(~repeated).drop("a").join(per_class, ["m", "t"], "left").select(
        "id", "n_bytes", F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce("runs", F.lit(0)).alias("n_spans"),
        F.coalesce("rest", "sha").alias("kept_sha256"), *["kept"] * keep_bytes)
    whole = member.where(repeated).select(
        "id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(nothing).alias("kept_sha256"), *[F.lit(b"").alias("kept")] * keep_bytes)
    return single.unionByName(whole).withColumnRenamed("id", id_col)
