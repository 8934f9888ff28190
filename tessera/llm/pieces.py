"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here by the model's own compiled character map (``charmap``): the longest key
at each place is replaced, and every byte of the result remembers the source byte it comes from.
The normalised text is cut into short stretches before blanks that follow something else; where no
piece of the vocabulary reaches over such a border (checked when the model is read), no merge does,
so stretches are segmented on their own by the sentencepiece library, with the model's normaliser
switched off.  Lengths of pieces summed up are borders in the normalised text, and the remembered
places project them to byte spans of the original text.

A row gives ``ids`` (with the end id last, if asked for), ``begins`` and ``ends`` (bytes in the UTF-8
text; the spans of a text follow each other; all but the last byte piece of a character are empty, and
so is the end id) and ``decoded``, the text that the ids give back.

Null text is empty: no pieces but the end id.  Repeated rows are encoded alike, null ids are kept.
Output is cut by bytes, not rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.charmap import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, Model
from tessera.llm.common import worker_cache

STRETCH = 64                   # characters segmented at once, at least
OUTPUT_BYTES = 2 << 20         # text bytes per output batch (a longer text is a batch of its own)


class Codec:
    """Encodes texts with spans."""

    def __init__(self, model: Model):
        import sentencepiece
        self.model = model
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.plain)
        space = SPACE.encode()
        text = [p.decode() for p, k in zip(model.pieces, model.kinds) if k == NORMAL]
        crosses = re.compile(f"[^{SPACE}]{SPACE}")
        self.cut = None
        if SPACE in text and not any(map(crosses.search, text)):
            self.cut = re.compile(f".{{{STRETCH},}}?[^{SPACE}](?={SPACE})|.+", re.DOTALL)
        self.byte = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(model.pieces, model.kinds)], np.int16)
        self.surface = [b"" if k == CONTROL else model.unknown_text if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE
                        else p.replace(space, b" ") for p, k in zip(model.pieces, model.kinds)]
        self.length = np.array([len(p) if k == NORMAL else -1 if k == UNKNOWN else 0
                                for p, k in zip(model.pieces, model.kinds)], np.int64)

    def _lengths(self, ids: np.ndarray, stretches: list[str]) -> np.ndarray:
        """Normalised bytes that each piece covers; of the byte pieces of a character the last covers it."""
        n, value = self.length[ids], self.byte[ids]
        if len(n) and n.min() < 0:                       # unknown pieces: the library knows what they stand for
            return np.array([p.end - p.begin for s in stretches for p in self.library.encode(s, return_type="proto").pieces], np.int64)
        is_byte = value >= 0
        if is_byte.any():
            at, follows = np.arange(len(ids)), is_byte & (value & 0xC0 == 0x80)
            lead = np.maximum.accumulate(np.where(is_byte & ~follows, at, 0))
            last = is_byte & ~np.append(follows[1:], False)
            n[last] = (at - lead + 1)[last]
        return n

    def _dropped(self, ids) -> int:
        """Blanks that decoding drops at the beginning."""
        norm, n = self.model.normaliser, 0
        if norm.dummy_prefix or norm.extra_space_goes:
            for i in ids:
                s = self.surface[i]
                if s[:1] == b" " and self.model.kinds[i] == NORMAL:
                    n += 1
                    if not norm.extra_space_goes:
                        break
                if len(s) > 1 or s not in (b"", b" "):
                    break
        return n

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """``(ids, begins, ends, decoded)`` of each text."""
        normal = [self.model.normaliser(t) for t in texts]
        stretches = [self.cut.findall(d.decode()) if self.cut else [d.decode()] if d else [] for d, _ in normal]
        found = iter(self.library.encode([s for x in stretches for s in x], num_threads=1))
        out = []
        for (_, places), parts in zip(normal, stretches):
            listed = [i for ids in islice(found, len(parts)) for i in ids]
            ids = np.array(listed, np.int64)
            borders = places[np.concatenate([[0], np.cumsum(self._lengths(ids, parts))])]
            text = b"".join(map(self.surface.__getitem__, listed))
            out.append((ids, borders[:-1], borders[1:], text[self._dropped(listed):]))
        return out


def encode(docs: DataFrame, model_path: str, end_id: int | None = 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id_col, ids, begins, ends, decoded`` for every row.  ``model_path``: a sentencepiece model
    on the workers."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select(F.col(id_col), *[F.array(F.lit(0)).alias(c) for c in ("ids", "begins", "ends")],
                         F.lit("").alias("decoded")).schema
    tail = np.array([] if end_id is None else [end_id], np.int64)

    def lists(arrays):
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32)))

    def run(batches):
        cache = worker_cache(f"pieces:{model_path}")
        if "codec" not in cache:
            cache["codec"] = Codec(Model.read(model_path))
        codec = cache["codec"]
        for b in batches:
            texts, a = b.column(1).to_pylist(), 0
            while a < len(texts):
                z = size = a
                size = 0
                while z < len(texts) and (z == a or size + len(texts[z]) <= OUTPUT_BYTES):
                    size += len(texts[z])
                    z += 1
                cols = [[] for _ in range(4)]
                for ids, begins, ends, text in codec.encode(texts[a:z]):
                    last = tail * 0 + (ends[-1] if len(ends) else 0)
                    for c, v in zip(cols, (np.concatenate([ids, tail]), np.concatenate([begins, last]),
                                           np.concatenate([ends, last]), text.decode("utf-8", "replace"))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), *map(lists, cols[:3]), pa.array(cols[3], pa.string())],
                                                 names=schema.names)
                a = z

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(F.col(id_col), F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
