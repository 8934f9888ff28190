"""Character maps and vocabularies of sentencepiece model files.

A model file is a protobuf message; only the few fields needed are read.  A character map is a
double-array trie over UTF-8 keys followed by the zero-terminated replacements.  It is read once
into a dictionary, and normalising takes the longest key at each place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"               # fixed value: stands for a blank in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)      # fixed values: kinds of pieces


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _encoded(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """``(number, value, raw bytes)`` of a message's fields."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + n], at + n
        yield tag >> 3, value, data[start:at]


def charmap_rules(blob: bytes) -> dict[str, str]:
    """All keys of a compiled character map with their replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts = blob[4 + size:]
    offset = (units >> 10) << ((units & 512) >> 6)
    label = units & 0x800000FF
    rules, letters = {}, np.arange(1, 256, dtype=np.uint32)
    nodes, keys = np.zeros(1, np.uint32), [b""]
    while len(nodes):
        base = nodes ^ offset[nodes]
        for i in np.flatnonzero(units[nodes] >> 8 & 1):
            at = int(units[base[i]] & 0x7FFFFFFF)
            rules[keys[i].decode()] = texts[at:texts.index(b"\0", at)].decode()
        child = base[:, None] ^ letters
        ok = child < len(units)
        ok[ok] = label[child[ok]] == np.broadcast_to(letters, ok.shape)[ok]
        parent, letter = np.nonzero(ok)
        keys = [keys[p] + bytes([c + 1]) for p, c in zip(parent.tolist(), letter.tolist())]
        nodes = child[ok]
    return rules


@dataclass
class Normaliser:
    """Longest-prefix normalisation that keeps, for each byte of the result, the place in the source."""
    rules: dict[str, str]
    dummy_prefix: bool = True
    extra_space_goes: bool = True
    escape: bool = True
    prefix_at_end: bool = False
    _look: re.Pattern | None = field(init=False, default=None)

    def __post_init__(self):
        if self.rules:
            single = {k for k in self.rules if len(k) == 1}
            longer = [k for k in self.rules if len(k) > 1]
            chars = lambda x: "[" + "".join(map(re.escape, sorted(x))) + "]"
            parts = [chars(single)] * bool(single)
            if longer:
                parts.append(f"{chars({k[0] for k in longer})}(?={chars({k[1] for k in longer})})")
            self._look = re.compile("|".join(parts))
            self._longest = max(map(len, self.rules))

    def _mapped(self, text: str) -> tuple[bytes, np.ndarray]:
        """The mapped text, and the source byte each of its bytes comes from."""
        data = text.encode("utf-8", "replace")
        if self._look is None or not self._look.search(text):
            return data, np.arange(len(data), dtype=np.int64)
        out, places, at, source = [], [], 0, 0
        while True:
            hit = self._look.search(text, at)
            start = hit.start() if hit else len(text)
            end, new = start, b""
            if hit:
                for n in range(min(self._longest, len(text) - start), 0, -1):
                    found = self.rules.get(text[start:start + n])
                    if found is not None:
                        end, new = start + n, found.encode()
                        break
                else:
                    start = end = start + 1                  # no key after all: the character stays
            same = text[at:start].encode("utf-8", "replace")
            out.append(same)
            places.append(np.arange(source, source + len(same), dtype=np.int64))
            source += len(same)
            out.append(new)
            places.append(np.full(len(new), source, np.int64))
            source += len(text[start:end].encode("utf-8", "replace"))
            at = end
            if not hit:
                return b"".join(out), np.concatenate(places)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """``(normalised, places)``: ``places`` has one entry more, the end of what was read."""
        data, places = self._mapped(text)
        end = len(text.encode("utf-8", "replace"))
        start = 0
        if self.extra_space_goes:
            raw = np.frombuffer(data, np.uint8)
            blank = raw == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            data, places = raw[keep].tobytes(), places[keep]
            start = int(places[0]) if len(places) else 0
        if not data:
            return b"", np.zeros(1, np.int64) + end
        if self.escape:
            places = np.repeat(places, np.where(np.frombuffer(data, np.uint8) == 32, 3, 1))
            data = data.replace(b" ", SPACE.encode())
        mark = SPACE.encode() if self.escape else b" "
        if self.dummy_prefix and not self.prefix_at_end:     # nothing but blanks gets no prefix
            data, places = mark + data, np.concatenate([np.full(len(mark), start), places])
        while self.extra_space_goes and data.endswith(mark):     # a mark of the text itself goes as well
            data = data[:-len(mark)]
            end, places = int(places[len(data)]), places[:len(data)]
        if self.dummy_prefix and self.prefix_at_end:
            data, places = data + mark, np.concatenate([places, np.full(len(mark), end)])
        return data, np.append(places, end)


@dataclass
class Model:
    """Pieces of a model with their kinds, its normaliser, and the same model without one."""
    pieces: list[bytes]
    kinds: list[int]
    normaliser: Normaliser
    unknown_text: bytes
    plain: bytes

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, kinds, trainer, spec, rest = [], [], {}, {}, []
        for number, value, raw in fields(data):
            if number == 1:
                p = {n: v for n, v, _ in fields(value)}
                pieces.append(p[1])
                kinds.append(p.get(3, NORMAL))
            if number == 2:
                trainer = {n: v for n, v, _ in fields(value)}
            if number == 3:
                spec = {n: v for n, v, _ in fields(value)}
            elif number != 5:
                rest.append(raw)
            elif any(n == 2 and v for n, v, _ in fields(value)):
                raise ValueError("a model with a denormaliser is not supported")
        if USER in kinds:
            raise ValueError("a model with user-defined symbols is not supported")
        normaliser = Normaliser(charmap_rules(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)),
                                bool(spec.get(5, 1)), bool(trainer.get(24, 0)))
        # identity map, no prefix, no blanks removed, no escaping: what comes in is normalised already
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        plain = b"".join(rest) + b"\x1a" + _encoded(len(off)) + off
        return cls(pieces, kinds, normaliser, trainer.get(44, " ⁇ ".encode()), plain)
