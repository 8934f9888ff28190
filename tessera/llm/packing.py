"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents become token ids (a separator id closes each); those longer than a sequence are cut into
whole sequences after a first, shorter piece.  The plan needs only how many pieces there are of each
length (at most ``seq_len`` numbers, the one thing the driver sees): best-fit decreasing puts all
pieces of a length at once, into the open sequences with the smallest sufficient room first, which
is what piece-by-piece best fit gives.  The plan has a row per (length, range of ranks, group of like
sequences): a group takes each next length at most once and halves its room when it does, so there
are at most ``3 * seq_len * log2(seq_len)`` rows (proven bound), and it is broadcast.  Pieces are
then numbered in order of length by a range sort (never one task per length) and take their slots
by joining on length and rank.

Null text is empty: a document of the separator alone.  Repeated rows are documents of their own.
Null ids are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, worker_cache
from tessera.operators.position import with_ord

#: How the byte-level pre-tokeniser of such files cuts a text, and the bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens of a tokenizers file as bytes, if ids alone decide its merges: a plain byte-level BPE
    whose merges make ids in ascending order.  None for any other file."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in (
        "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True))
    if not plain:
        return None
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    basic = {t: i for t, i in vocab.items() if len(t) == 1}
    used = [t for t in vocab if t not in special]
    if made != sorted(set(made)) or len(basic) != 256 or len(made) + 256 != len(used) or (made and max(basic.values()) > made[0]):
        return None
    return {bytes(map(byte_of.__getitem__, t)): vocab[t] for t in used}


class Encoder:
    """Token ids of whole texts, as the file's own tokenizer gives them without special tokens at the
    ends.

    A byte-level BPE whose ids follow its merges is what tiktoken runs, several times faster than
    tokenizers on rarely repeated words; a text that holds an added token, and any other file, goes
    through tokenizers as it is."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"         # Spark runs a worker per core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = byte_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", ())]
        self.added = re.compile("|".join(added)) if added else None

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if not self.fast or self.added and self.added.search(text):
            return self.whole(text)
        return self.fast.encode_ordinary(text)


def piece_lengths(n: int, seq_len: int) -> list[int]:
    """A document of ``n`` ids as pieces: only a longer one is cut, its first piece may be shorter."""
    if n <= seq_len:
        return [n]
    first = n % seq_len
    return ([first] if first else []) + [seq_len] * (n // seq_len)


def pieces(docs: DataFrame, tokenizer: str, seq_len: int, separator: int, id_col: str, text_col: str,
           keep_ids: bool) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                         F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
                         *[F.array(F.lit(0)).alias("ids")] * keep_ids).schema

    def run(batches):
        cache = worker_cache(f"bpe:{tokenizer}")
        if "encoder" not in cache:
            cache["encoder"] = Encoder(tokenizer)
        encode = cache["encoder"].encode
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                at, cols = [], [[] for _ in range(5)]
                for i, text in enumerate(part.column(1)):
                    ids = encode(text.as_py())
                    ids.append(separator)
                    ids = np.array(ids, "<u4")
                    start = 0
                    for p, n in enumerate(piece_lengths(len(ids), seq_len)):
                        own = ids[start:start + n]
                        at.append(i)
                        for c, v in zip(cols, (p, start, n, zlib.crc32(own), own)):
                            c.append(v)
                        start += n
                out = [part.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()),
                       *[pa.array(c, pa.int64()) for c in cols[1:4]]]
                if keep_ids:
                    out.append(pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, rank_from, rank_to, sequence, per_sequence, offset)``: pieces of ``length``
    with ranks in the range go, ``per_sequence`` each, to sequences from ``sequence`` on, at
    ``offset`` and after."""
    room: dict[int, list[tuple[int, int]]] = {}    # room left -> (first sequence, how many)
    sizes: list[int] = []                          # rooms with sequences, sorted
    plan, opened = [], 0

    def put(r, first, n):
        if r and n:
            if r not in room:
                room[r] = []
                insort(sizes, r)
            room[r].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]

        def fill(r, first, n):
            """Fill a group of ``n`` sequences with room ``r``; what is not needed stays."""
            nonlocal rank, left
            per = r // length
            full = min(n, left // per)
            part = min(left - full * per, per) if full < n else 0
            for seqs, each, at in ((full, per, first), (min(part, 1), part, first + full)):
                if seqs:
                    plan.append((length, rank, rank + seqs * each, at, each, seq_len - r))
                    rank, left = rank + seqs * each, left - seqs * each
                    put(r - each * length, at, seqs)
            used = full + (part > 0)
            put(r, first + used, n - used)

        while left and sizes and sizes[-1] >= length:
            r = sizes.pop(bisect_left(sizes, length))
            for group in room.pop(r):
                if left:
                    fill(r, *group)
                else:
                    put(r, *group)
        if left:
            n = -(-left // (seq_len // length))
            fill(seq_len, opened, n)
            opened += n
    return plan


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, separator: int = 0, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    ``tokenizer``: path of a tokenizers file on the workers.  ``keep_ids`` adds the piece's ids,
    from which ``sequences`` builds the packed rows."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, seq_len, separator, id_col, text_col, keep_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = pd.DataFrame(best_fit_plan(counts, seq_len), dtype="int64",
                        columns=["length", "rank_from", "rank_to", "sequence", "per", "at"])
    smaller, first = 0, {}
    for n in sorted(counts):
        first[n], smaller = smaller, smaller + counts[n]
    base = plan["length"].map(first).astype("int64") if len(plan) else plan["length"]
    plan["rank_from"], plan["rank_to"] = plan["rank_from"] + base, plan["rank_to"] + base
    slots = spark.createDataFrame(plan, "length long, rank_from long, rank_to long, sequence long, per long, at long")
    ranked = with_ord(cut, ["length", "id", "piece", "start", "ids_crc32"], "rank")
    placed = ranked.join(F.broadcast(slots), "length").where(
        (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(rank - rank_from) div per")).alias("sequence_id"),
        (F.col("at") + (nth % F.col("per")) * F.col("length")).alias("offset"), *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed rows of ``pack(..., keep_ids=True)``.  A group is one
    sequence, so it never holds more than ``seq_len`` ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
