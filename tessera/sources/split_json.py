"""The id array of one large JSON log, read by many tasks.

A log in the single-file form is one JSON object with a long array of ids.  Spark's JSON reader gives such
a file to one task.  Here the file is cut into byte ranges that know nothing of each other:

1. Every range reports whether it holds an odd number of quotes, and its brackets and key names outside of strings for
   either case, that it begins inside a string or outside.  (Whether its first byte is escaped follows from
   the backslashes just before it.)
2. The driver goes over the ranges once, one small record each: which case holds, and where the array begins and ends.
3. Every range emits the elements that begin in it, the last one read to its end beyond the border; ``list_pos`` is the place
   in the range plus the counts of the ranges before.

Elements are strings (unescaped as JSON), ``null`` (a null id) or other scalars (their text).  Nested
values are refused, as is a file with many brackets outside of strings: it is not such a log.  The file is read twice;
a task holds one range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import stored
from tessera.sources.ledger import _filesystem

RANGE_BYTES = 64 << 20
_MAX_MARKS = 256                       # brackets and names outside of strings, per range
_MAX_REST = 16 << 20                   # bytes of the object without its array


def _read(path: str, begin: int, end: int) -> bytes:
    store, name = _filesystem(path)
    with store.open_input_file(name) as f:
        f.seek(begin)
        return f.read(max(0, end - begin))


def _escaped(path: str, begin: int) -> bool:
    """Is the byte at ``begin`` escaped: does an odd number of backslashes stand before it?"""
    n, step = 0, 64
    while begin - n > 0:
        lo = max(0, begin - n - step)
        block = _read(path, lo, begin - n)
        tail = len(block) - len(block.rstrip(b"\\"))
        n += tail
        if tail < len(block):
            break
        step *= 2
    return n % 2 == 1


def _plain(block: bytes, escaped: bool) -> bytes:
    """The block with escapes blanked out, as long as before: what quotes are left begin or end strings."""
    if escaped:
        block = b"." + block[1:]
    return re.sub(rb"\\.|\\$", lambda m: b"." * len(m.group()), block, flags=re.S)


def _marks(plain: bytes, inside: bool, at: int) -> list:
    """``[place, bracket]`` outside of strings."""
    text = b'"' + plain if inside else plain
    shift = at - 1 if inside else at
    out = []
    for m in re.finditer(rb'"[^"]*(?:"|$)|[\[\]{}]', text):
        if m.group()[:1] != b'"':
            out.append([m.start() + shift, m.group().decode()])
            if len(out) > _MAX_MARKS:
                return [[-1, "too many"]]
    return out


def _scan(path: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for begin, end in zip(pdf["begin"], pdf["end"]):
                plain = _plain(_read(path, begin, end), _escaped(path, begin))
                rows.append((plain.count(b'"') % 2, json.dumps(_marks(plain, False, begin)), json.dumps(_marks(plain, True, begin))))
            yield pdf.assign(odd=[r[0] for r in rows], outside=[r[1] for r in rows], inside=[r[2] for r in rows])

    return scan


_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[^\s,"]+', re.S)


def _elements(path: str, step: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, begin, end, stop, inside in zip(pdf["part"], pdf["begin"], pdf["end"], pdf["stop"], pdf["inside"]):
                begin, end, stop = int(begin), int(end), int(stop)
                block, first = _read(path, begin, end), 0
                if inside:                               # the string that begins in a range before
                    close = _plain(block, _escaped(path, begin)).find(b'"')
                    if close < 0:
                        continue
                    first = close + 1
                elif begin > 0 and block and re.match(rb'[^\s,"\[]', block) and re.match(rb'[^\s,"\[]', _read(path, begin - 1, begin)):
                    first = re.match(rb'[^\s,"]+', block).end()        # the scalar that begins in a range before
                tail, size = b"", step
                while end + len(tail) < stop and _open_end(block[first:] + tail):
                    tail += _read(path, end + len(tail), min(stop, end + len(tail) + size))
                    size *= 2
                ids = []
                for m in _TOKEN.finditer(block + tail, first):
                    if m.start() >= end - begin:
                        break
                    token = m.group()
                    ids.append(json.loads(token) if token[:1] == b'"' else None if token == b"null" else token.decode())
                yield pd.DataFrame({"part": part, "place": range(len(ids)), "id": pd.Series(ids, dtype=object)})

    return emit


def _open_end(text: bytes) -> bool:
    """Does the text stop inside a string or a scalar?"""
    plain = _plain(text, False)
    return plain.count(b'"') % 2 == 1 or bool(re.search(rb'[^\s,"]$', plain))


def read_id_array(spark: SparkSession, path: str, field: str = "failed_sample_ids",
                  range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, dict]:
    """``(ids[id string, list_pos bigint], the object without the array)`` of a JSON file whose object has the
    array ``field``.  An object without it, or with null, has no ids."""
    store, name = _filesystem(path)
    size = store.get_file_info(name).size
    parts = max(1, -(-size // range_bytes))
    ranges = spark.range(0, parts, 1, parts).select(
        F.col("id").alias("part"), (F.col("id") * range_bytes).alias("begin"),
        F.least((F.col("id") + 1) * range_bytes, F.lit(size)).alias("end"))
    scanned = ranges.mapInPandas(_scan(path), "part long, begin long, end long, odd int, outside string, inside string")
    begin = end = None
    depth, inside, entry = 0, False, {}
    for r in sorted(scanned.collect(), key=lambda r: r.part):
        entry[r.part] = inside
        for place, mark in json.loads(r.inside if inside else r.outside):
            if place < 0 or (begin is not None and end is None and mark != "]"):
                raise ValueError(f"{path} is not an id log: nested values or too many brackets")
            if mark == "[" and depth == 1 and begin is None and _names(path, place, field):
                begin = place + 1
            elif mark == "]" and depth == 2 and begin is not None and end is None:
                end = place
            depth += 1 if mark in "[{" else -1
        inside ^= bool(r.odd)
    if begin is None:
        return spark.createDataFrame([], "id string, list_pos bigint"), _rest(path, 0, 0, size, field)
    if end is None:
        raise ValueError(f"{path} is cut off")
    summary = _rest(path, begin, end, size, field)
    held = [(p, max(begin, p * range_bytes), min(end, (p + 1) * range_bytes), end, entry[p] and p * range_bytes >= begin)
            for p in entry if p * range_bytes < end and (p + 1) * range_bytes > begin]
    work = spark.createDataFrame(held, "part long, begin long, end long, stop long, inside boolean").repartitionByRange(max(1, len(held)), "part")
    found = stored(work.mapInPandas(_elements(path, min(range_bytes, 1 << 16)), "part long, place long, id string"), "log-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)        # one row per range
    offsets = found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return found.join(F.broadcast(offsets), "part").select("id", (F.col("off") + F.col("place")).alias("list_pos")), summary


def _names(path: str, place: int, field: str) -> bool:
    """Does the name of ``field`` stand before the bracket?"""
    before = _read(path, max(0, place - len(field) - 4096), place).rstrip()
    return before.endswith(b":") and before[:-1].rstrip().endswith(json.dumps(field).encode())


def _rest(path: str, begin: int, end: int, size: int, field: str) -> dict:
    if size - (end - begin) > _MAX_REST:
        raise ValueError(f"{path} is not an id log: more than {_MAX_REST} bytes beside its ids")
    value = json.loads(_read(path, 0, begin) + _read(path, end, size))
    value.pop(field, None)
    return value
