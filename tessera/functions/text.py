"""Text functions: Python-compatible strip, first-tag extraction, templating."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() / re "\s" treat as
# whitespace.  Java's "\s" and SQL trim() cover fewer, so they are spelled out.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regular-expression class (valid for Java and RE2).
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """``str.strip()``: remove Python whitespace at both ends (null stays null)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def strip_long(col) -> Column:
    """``strip`` for long texts and costly expressions: the text is evaluated once.  A text that ends in a
    visible ASCII character, or in one line feed or blank after it, is cut by bytes; any other goes to
    ``btrim``, which looks up where every character lies."""
    def stripped(x):
        data, byte = x.cast("binary"), lambda i: F.substring(x.cast("binary"), i, 1)
        visible = lambda i: (byte(i) > F.lit(b"\x20")) & (byte(i) < F.lit(b"\x7f"))
        one = ((byte(-1) == F.lit(b"\n")) | (byte(-1) == F.lit(b" "))) & visible(-2)
        cut = F.substring(data, F.lit(1), F.octet_length(x) - F.lit(1)).cast("string")
        return (F.when(visible(-1), F.ltrim(x, F.lit(PY_WHITESPACE)))
                .when(one, F.ltrim(cut, F.lit(PY_WHITESPACE))).otherwise(strip(x)))
    return let(_c(col), stripped)


def is_blank(col) -> Column:
    """True when null, empty or whitespace only (``not s.strip()``)."""
    return F.coalesce(F.ltrim(_c(col), F.lit(PY_WHITESPACE)) == "", F.lit(True))     # reads no further than the first character that stays


def not_blank(col) -> Column:
    return ~is_blank(col)


def let(value, fn) -> Column:
    """Evaluate ``value`` once and apply ``fn`` to it (a one-element array and
    a lambda): keeps nested helpers from copying a costly argument."""
    return F.get(F.transform(F.array(value), fn), 0)


def first_tag_or_null(col, tag) -> Column:
    """Content of the first ``<tag>…</tag>`` block, untouched; null if absent.

    Same result as ``re.search(r"<tag>(.*?)</tag>", text, re.DOTALL)``: the
    match starts at the first opening tag and ends at the first closing tag
    after it (if no closing tag follows the first opening tag, none follows a
    later one).  So two ``locate`` (indexOf) calls replace the regex engine.
    ``tag`` may be a string or a Column (per-row names such as ``sample_3``).
    Pass a column (not a large expression) as ``col``: it is referenced
    several times."""
    s = _c(col)
    if isinstance(tag, str):
        open_, close = F.lit(f"<{tag}>"), F.lit(f"</{tag}>")
        width = F.lit(len(tag) + 2)
    else:
        open_ = F.concat(F.lit("<"), tag, F.lit(">"))
        close = F.concat(F.lit("</"), tag, F.lit(">"))
        width = F.length(tag) + F.lit(2)
    p = F.call_function("locate", open_, s)
    start = p + width
    q = F.call_function("locate", close, s, start)
    return F.when((p > 0) & (q > 0), F.substring(s, start, q - start))


def first_tag(col, tag) -> Column:
    """Content of the first block, stripped; ``""`` when absent."""
    return F.coalesce(strip(first_tag_or_null(col, tag)), F.lit(""))


def first_tag_stripped_or_null(col, tag) -> Column:
    """``re.search(r'<t>\\s*(.*?)\\s*</t>')`` then strip: stripped content or null."""
    return strip(first_tag_or_null(col, tag))


def numbered_tag(col, name: str, i) -> Column:
    """``<name_i>`` block (stripped, null if absent) with ``i`` an int or Column."""
    if not isinstance(i, Column):
        return first_tag_stripped_or_null(col, f"{name}_{i}")
    return first_tag_stripped_or_null(col, F.concat(F.lit(f"{name}_"), i.cast("string")))


def tag_tokens(col, names) -> tuple[Column, Column]:
    """Tokenise a text once for numbered tags ``<name_i>`` / ``</name_i>``:
    ``(tags, pieces)`` where ``tags`` lists every tag in text order and
    ``pieces`` the text around them (``len(pieces) = len(tags) + 1``)."""
    rx = "</?(?:" + "|".join(re.escape(n) for n in names) + ")_[0-9]+>"
    return (F.regexp_extract_all(_c(col), F.lit(rx), 0), F.split(_c(col), rx, -1))


def tag_stretches(col, names) -> Column:
    """Every tag ``<name_i>`` / ``</name_i>`` of a text in order, each with the text up to the next one: one
    pass that steps from ``<`` to ``<``.  Text before the first tag is left out, as it is in no block."""
    tag = "/?(?:" + "|".join(re.escape(n) for n in names) + ")_[0-9]+>"
    # a possessive group is repeated in a loop, without a stack frame for every "<" of a text; "[^<]*" alone is
    # one loop if it is greedy, but a call for every character if it is possessive
    return F.regexp_extract_all(_c(col), F.lit(f"<{tag}[^<]*(?:<(?!{tag})[^<]*)*+"), 0)


def stretch_tokens(stretches) -> tuple[Column, Column]:
    """``tag_tokens`` from the column of ``tag_stretches`` (the text before the first tag is empty here)."""
    tag = lambda s: F.concat(F.substring_index(s, ">", 1), F.lit(">"))
    text = lambda s: F.substring(s.cast("binary"), F.octet_length(tag(s)) + F.lit(1), F.octet_length(s)).cast("string")
    return F.transform(_c(stretches), tag), F.concat(F.array(F.lit("")), F.transform(_c(stretches), text))


def with_tag(col, names) -> Column:
    """A text that has an opening tag ``<name_i>``; null instead of any other, as there is no block in it."""
    tag = "(?:" + "|".join(re.escape(n) for n in names) + ")_[0-9]+>"
    first = F.regexp_extract_all(_c(col), F.lit(f"\\A[^<]*(?:<(?!{tag})[^<]*)*+<{tag}"), 0)
    return F.when(F.size(first) > 0, _c(col))


def first_blocks(texts: pa.Array, names, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The first ``<name_i>…</name_i>`` block of every name and number from 1 to ``last`` in every text: its row, the
    place of its name, its number, and its content without whitespace around it, ordered by the three.  A block
    goes from the first opening tag to the first closing tag after it; other tags between them are kept.

    Tags are found in the bytes of all texts at once: no byte of ``<``, a name or a number is part of another character."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(ends or bytes(8), np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    base, ends = ends[:1].sum(), ends - ends[:1].sum()
    size = int(ends[-1]) if len(ends) else 0
    room = 4 + max(map(len, names)) + len(str(last))
    raw = np.zeros(size + room, np.uint8)                      # behind the end there is no tag
    raw[:size] = np.frombuffer(data or b"", np.uint8)[base:base + size]
    at = np.flatnonzero(raw == ord("<"))
    closes = raw[at + 1] == ord("/")
    word = at + 1 + closes
    begins = raw[word]
    found = []
    for f, name in enumerate(n.encode() for n in names):
        kept = np.flatnonzero(begins == name[0])
        for i, c in enumerate(name[1:] + b"_", 1):
            right = raw[word[kept] + i] == c
            if not right.all():
                kept = kept[right]
        place = word[kept] + len(name) + 1
        number = raw[place].astype(np.int64) - ord("0")
        place += 1
        ok, reading = (number >= 1) & (number <= 9), raw[place] != ord(">")
        while (reading & ok).any():                      # the numbers with more digits, a digit each time
            more = np.flatnonzero(reading & ok)
            digit = raw[place[more]].astype(np.int64) - ord("0")
            number[more] = number[more] * 10 + digit
            place[more] += 1
            ok[more] = (digit >= 0) & (digit <= 9) & (number[more] <= last)
            reading = ok & (raw[place] != ord(">"))
        ok &= (raw[place] == ord(">")) & (number <= last)
        found.append((at[kept][ok], np.full(ok.sum(), f), number[ok], closes[kept][ok], place[ok] + 1))
    start, field, number, closing, end = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start)
    start, field, number, closing, end = start[order], field[order], number[order], closing[order], end[order]
    row = np.searchsorted(ends, start, "right") - 1
    inside = end <= ends[row + 1]                              # not begun in one text and ended in the next
    if not inside.all():
        start, field, number, closing, end, row = (x[inside] for x in (start, field, number, closing, end, row))
    if not len(start):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), pa.array([], texts.type)
    by_tag = np.lexsort((np.arange(len(start)), number, field, row))
    starts = np.flatnonzero(np.r_[True, (np.diff(row[by_tag]) != 0) | (np.diff(field[by_tag]) != 0) | (np.diff(number[by_tag]) != 0)])
    shut, never = closing[by_tag], len(start)
    first = np.minimum.reduceat(np.where(shut, never, by_tag), starts)
    since = np.repeat(first, np.diff(np.r_[starts, len(by_tag)]))
    until = np.minimum.reduceat(np.where(shut & (by_tag > since), by_tag, never), starts)
    whole = until < never
    first, until = first[whole], until[whole]
    content = _spans(raw, end[first], start[until], size)
    return row[first], field[first], number[first], pc.utf8_trim(content.cast(texts.type), PY_WHITESPACE)


def _spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> pa.Array:
    """The texts between the given bytes.  Those that lie apart are cut by one array of borders, the others one by one."""
    order = np.argsort(begin, kind="stable")
    a, b = begin[order], end[order]
    apart = a >= np.r_[0, np.maximum.accumulate(b)[:-1]] if len(a) else np.zeros(0, bool)
    borders = np.empty(2 * apart.sum(), np.int64)
    borders[0::2], borders[1::2] = a[apart], b[apart]
    cut = pa.LargeStringArray.from_buffers(max(len(borders) - 1, 0), pa.py_buffer(borders if len(borders) else np.zeros(1, np.int64)), pa.py_buffer(raw))
    place = np.empty(len(a), np.int64)
    place[order[apart]] = 2 * np.arange(apart.sum())
    if not apart.all():
        rest = order[~apart]
        place[rest] = len(cut) + np.arange(len(rest))
        cut = pa.concat_arrays([cut, pa.array([raw[x:y].tobytes().decode() for x, y in zip(begin[rest].tolist(), end[rest].tolist())], cut.type)])
    return cut.take(pa.array(place))


def tag_from_tokens(tags, pieces, tag) -> Column:
    """First ``<tag>…</tag>`` content from ``tag_tokens`` output, or null.

    Equals the ``locate`` form: the first opening token, then the first
    closing token after it; text and any other tags between them are kept."""
    t, pc = _c(tags), _c(pieces)
    if isinstance(tag, str):
        open_, close = F.lit(f"<{tag}>"), F.lit(f"</{tag}>")
    else:
        open_ = F.concat(F.lit("<"), tag, F.lit(">"))
        close = F.concat(F.lit("</"), tag, F.lit(">"))

    def between(a, rel):
        b = a + rel
        inner = F.array_join(F.transform(F.sequence(a, b - 1), lambda k: F.concat(
            F.get(pc, k.cast("int")), F.when(k < b - 1, F.get(t, k.cast("int"))).otherwise(F.lit("")))), "")
        return F.when(rel == 1, F.get(pc, a.cast("int"))).when(rel > 0, inner)

    def after(a):
        rest = F.slice(t, (a + 1).cast("int"), F.greatest(F.size(t), F.lit(1)))
        # mostly the next token closes the block: nothing is copied then
        return F.when(a > 0, F.when(F.get(t, a.cast("int")) == close, F.get(pc, a.cast("int")))
                      .otherwise(let(F.array_position(rest, close), lambda rel: between(a, rel))))

    return let(F.array_position(t, open_), after)


def description_block(col) -> Column:
    """``<description>…</description>`` re-wrapped around the stripped content,
    or the whole text when there is no block."""
    inner = first_tag_or_null(col, "description")
    return F.coalesce(F.concat(F.lit("<description>"), strip(inner), F.lit("</description>")),
                      _c(col))


def wrap(tag: str, col, newline: bool = False) -> Column:
    """``<tag>col</tag>`` (optionally with the content on its own line)."""
    nl = "\n" if newline else ""
    return F.concat(F.lit(f"<{tag}>{nl}"), _c(col), F.lit(f"{nl}</{tag}>"))


def join_lines(col, sep: str = "\n") -> Column:
    """A list column joined by ``sep`` (strings pass through)."""
    return F.array_join(_c(col), sep)


def basename_no_ext(col) -> Column:
    """``os.path.splitext(os.path.basename(p))[0]``."""
    base = F.regexp_extract(_c(col), r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1)


def last_segment(col, sep: str = "/") -> Column:
    """``s.split(sep)[-1]``."""
    return F.element_at(F.split(_c(col), re.escape(sep)), -1)


def strip_boilerplate(col, patterns: list[str]) -> Column:
    """Remove every sentence that matches one of ``patterns`` (regexes)."""
    out = _c(col)
    for p in patterns:
        out = F.regexp_replace(out, F.lit(p), F.lit(""))
    return out
