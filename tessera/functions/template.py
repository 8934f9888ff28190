"""Chat templates as one column expression.

``compiled(source)`` reads a template in the usual chat-template notation (a small part of Jinja) and
builds from it, once on the driver, a column that renders an ``array<struct<role, content>>``:

* ``{% for m in messages %}`` (also over ``messages[1:]``, with ``loop.first``, ``loop.last``,
  ``loop.index0``, ``loop.index``), ``{% if %} / {% elif %} / {% else %}``, ``{% set x = ... %}``;
* ``{{ ... }}`` with texts, ``m['role']`` or ``m.role``, ``messages[0]['content']``, ``+``, comparisons,
  ``and / or / not``, ``in``, ``%``, ``messages | length`` and the filters ``trim``, ``upper``, ``lower``;
* ``{% generation %} ... {% endgeneration %}``: what training learns from;
* ``-`` at a tag's edge strips blanks there; as chat templates are rendered everywhere, a line end
  after a block tag goes, and blanks before one at the start of a line.

Names that are given neither by the template nor as variables are false, as in Jinja.  A null
content is empty text; null messages render to null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import _c, strip

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.DOTALL)
_FILTER = re.compile(r"((?:'[^']*'|\"[^\"]*\"|[\w.]+)(?:\[[^\]]*\]|\.\w+)*|\((?:[^()]|\([^()]*\))*\))\s*\|\s*(\w+)")
SEGMENTS = "array<struct<text: string, learnt: boolean>>"


class TemplateError(ValueError):
    """The template uses something that is not supported, or is not closed properly."""


def _tokens(source: str) -> list[tuple[str, str]]:
    """``(kind, body)``: text, block or value."""
    parts = _TAG.split(source)
    out: list[tuple[str, str]] = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            if before.endswith(("-%}", "-}}")):
                p = p.lstrip()
            elif before.startswith(("{%", "{#")):
                p = p.removeprefix("\n")
            if after.startswith(("{%-", "{{-")):
                p = p.rstrip()
            elif after.startswith(("{%", "{#")):
                p = re.sub(r"(^|\n)[ \t]*\Z", r"\1", p) if i == 0 or "\n" in p or before.startswith(("{%", "{#")) else p
            if p:
                out.append(("text", p))
        elif not p.startswith("{#"):
            out.append(("block" if p.startswith("{%") else "value", p[2:-2].strip("-").strip()))
    return out


@dataclass
class _Node:
    kind: str                              # text, value, set, for, if, generation
    body: str = ""
    name: str = ""
    branches: list | None = None           # (condition or None, nodes)


def _tree(tokens: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[_Node], int]:
    nodes = []
    while at < len(tokens):
        kind, body = tokens[at]
        word = body.split(None, 1)[0] if kind == "block" else ""
        if word in ends:
            return nodes, at
        at += 1
        if kind != "block":
            nodes.append(_Node(kind, body))
        elif word == "set":
            name, _, value = body[3:].partition("=")
            nodes.append(_Node("set", value.strip(), name.strip()))
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", body, re.DOTALL)
            if not m:
                raise TemplateError(f"loop not understood: {body}")
            inside, at = _tree(tokens, at, ("endfor",))
            nodes.append(_Node("for", m[2], m[1], [(None, inside)]))
            at += 1
        elif word == "generation":
            inside, at = _tree(tokens, at, ("endgeneration",))
            nodes.append(_Node("generation", branches=[(None, inside)]))
            at += 1
        elif word == "if":
            branches, condition = [], body[2:].strip()
            while True:
                inside, at = _tree(tokens, at, ("elif", "else", "endif"))
                branches.append((condition, inside))
                if at >= len(tokens):
                    raise TemplateError("an if is not closed")
                word, at, closing = tokens[at][1].split(None, 1)[0], at + 1, tokens[at][1]
                if word == "endif":
                    break
                condition = closing[4:].strip() if word == "elif" else None
            nodes.append(_Node("if", branches=branches))
        else:
            raise TemplateError(f"tag not supported: {body}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return nodes, at


def _expression(text: str) -> ast.expr:
    """A template expression as a Python one: filters become calls, line ends in quotes escapes."""
    text = re.sub(r"'[^']*'|\"[^\"]*\"|\n", lambda m: m[0].replace("\n", "\\n") if m[0] != "\n" else " ", text)
    while True:
        new = _FILTER.sub(r"\2(\1)", text, count=1)
        if new == text:
            break
        text = new
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"expression not understood: {text}") from e


def _is_array(x) -> bool:
    return isinstance(x, _Messages)


@dataclass
class _Messages:
    column: Column


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _truth(x):
    """A condition: Python values decide at once; a text is true if it is not empty."""
    if _is_array(x):
        return F.size(x.column) > 0
    return x


def _value(e: ast.expr, env: dict):
    """The value of an expression: a Python constant where everything is known, else a column."""
    if isinstance(e, ast.Constant):
        return e.value
    if isinstance(e, ast.Name):
        return {"true": True, "false": False, "none": None}.get(e.id, env.get(e.id))
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Name):
        (arg,) = [_value(a, env) for a in e.args]
        if e.func.id == "length":
            return F.size(arg.column) if _is_array(arg) else F.length(_col(arg))
        if e.func.id == "trim":
            return arg.strip() if isinstance(arg, str) else strip(arg)
        if e.func.id in ("upper", "lower"):
            return getattr(arg, e.func.id)() if isinstance(arg, str) else getattr(F, e.func.id)(arg)
        raise TemplateError(f"filter not supported: {e.func.id}")
    if isinstance(e, (ast.Subscript, ast.Attribute)):
        base = _value(e.value, env)
        if isinstance(e, ast.Subscript) and isinstance(e.slice, ast.Slice):
            start = e.slice.lower.value if e.slice.lower else 0
            if not _is_array(base) or e.slice.upper or e.slice.step:
                raise TemplateError("only messages[n:] is supported")
            return _Messages(F.filter(base.column, lambda _, i: i >= start))
        key = e.attr if isinstance(e, ast.Attribute) else _value(e.slice, env)
        if _is_array(base):
            return F.get(base.column, key if key >= 0 else F.size(base.column) + key)
        if isinstance(base, dict):
            return base.get(key)
        return F.coalesce(base[key], F.lit("")) if key == "content" else base[key]
    if isinstance(e, ast.BinOp) and isinstance(e.op, (ast.Add, ast.Mod)):
        a, b = _value(e.left, env), _value(e.right, env)
        if isinstance(e.op, ast.Mod):
            return a % b
        if not isinstance(a, Column) and not isinstance(b, Column):
            return a + b
        number = isinstance(a, int) or isinstance(b, int)
        return _col(a) + _col(b) if number else F.concat(_col(a), _col(b))
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub) and isinstance(e.operand, ast.Constant):
        return -e.operand.value
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        x = _truth(_value(e.operand, env))
        return ~x if isinstance(x, Column) else not x
    if isinstance(e, ast.BoolOp):
        out = None
        for part in e.values:
            x = _truth(_value(part, env))
            if out is None:
                out = x
            elif not isinstance(out, Column) and not isinstance(x, Column):
                out = (out and x) if isinstance(e.op, ast.And) else (out or x)
            else:
                known = out if not isinstance(out, Column) else x if not isinstance(x, Column) else None
                if known is not None:                      # a known side decides or falls away
                    column = x if isinstance(x, Column) else out
                    out = (column if known else False) if isinstance(e.op, ast.And) else (True if known else column)
                else:
                    out = (out & x) if isinstance(e.op, ast.And) else (out | x)
        return out
    if isinstance(e, ast.Compare) and len(e.ops) == 1:
        a, b, op = _value(e.left, env), None, e.ops[0]
        if isinstance(op, (ast.In, ast.NotIn)):
            right = e.comparators[0]
            if isinstance(right, (ast.List, ast.Tuple)):
                found = _col(a).isin([_value(x, env) for x in right.elts])
            else:
                found = F.contains(_col(_value(right, env)), _col(a))
            return ~found if isinstance(op, ast.NotIn) else found
        b = _value(e.comparators[0], env)
        known = not isinstance(a, Column) and not isinstance(b, Column)
        left, right = (a, b) if known else (_col(a), _col(b))
        kinds = {ast.Eq: lambda: left == right, ast.NotEq: lambda: left != right, ast.Lt: lambda: left < right,
                 ast.LtE: lambda: left <= right, ast.Gt: lambda: left > right, ast.GtE: lambda: left >= right}
        if type(op) in kinds:
            return kinds[type(op)]()
    raise TemplateError(f"expression not supported: {ast.unparse(e)}")


def _segment(text, learnt: bool) -> Column:
    return F.array(F.struct(_col(text).cast("string").alias("text"), F.lit(learnt).alias("learnt")))


def _none() -> Column:
    return F.array().cast(SEGMENTS)


def _turn(loop: _Node, env: dict, size: Column, learnt: bool) -> Callable[[Column, Column], Column]:
    """What a loop makes of one message; names set inside don't leave it."""
    def body(m, i):
        facts = {"index0": i, "index": i + 1, "first": i == 0, "last": i == size - 1, "length": size}
        return _built(loop.branches[0][1], env | {loop.name: m, "loop": facts}, learnt)[0]

    return body


def _built(nodes: list[_Node], env: dict, learnt: bool) -> tuple[Column, dict]:
    """Segments of the nodes, and the names known after them."""
    parts: list[Column] = []
    env = dict(env)
    for n in nodes:
        if n.kind == "text":
            parts.append(_segment(n.body, learnt))
        elif n.kind == "value":
            v = _value(_expression(n.body), env)
            if v is not None:
                parts.append(_segment(v, learnt))
        elif n.kind == "set":
            env[n.name] = _value(_expression(n.body), env)
        elif n.kind == "generation":
            inside, env = _built(n.branches[0][1], env, True)
            parts.append(inside)
        elif n.kind == "for":
            messages = _value(_expression(n.body), env)
            if not _is_array(messages):
                raise TemplateError(f"no list of messages: {n.body}")
            parts.append(F.flatten(F.transform(messages.column, _turn(n, env, F.size(messages.column), learnt))))
        else:
            chain, known = [], False
            for condition, inside in n.branches:
                c = True if condition is None else _truth(_value(_expression(condition), env))
                if not isinstance(c, Column):
                    if not c:
                        continue
                    known = True
                chain.append((c, *_built(inside, env, learnt)))
                if known:                                  # nothing after it is reached
                    break
            other, after = (chain.pop()[1:] if known else (_none(), env))
            out, merged = other, dict(after)
            for c, segments, names in reversed(chain):
                out = F.when(c, segments).otherwise(out)
                for k in names.keys() | merged.keys():
                    a, b = names.get(k), merged.get(k)
                    if a is not b:
                        merged[k] = (_Messages(F.when(c, a.column).otherwise(b.column)) if _is_array(a) and _is_array(b)
                                     else F.when(c, _col(a)).otherwise(_col(b)))
            parts.append(out)
            env = merged
    return (F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()), env


@dataclass
class Template:
    """A compiled template."""
    nodes: list[_Node]

    def segments(self, messages, add_generation_prompt: bool = False, **variables) -> Column:
        """The rendered text in pieces: ``array<struct<text, learnt>>``."""
        env = {"messages": _Messages(_c(messages)), "add_generation_prompt": add_generation_prompt, **variables}
        return F.when(_c(messages).isNotNull(), _built(self.nodes, env, False)[0])

    def render(self, messages, add_generation_prompt: bool = False, **variables) -> Column:
        """The rendered text."""
        return joined(self.segments(messages, add_generation_prompt, **variables))


def joined(segments) -> Column:
    return F.array_join(F.transform(_c(segments), lambda s: s["text"]), "")


def learnt_spans(segments) -> Column:
    """``array<struct<begin, end>>``: the stretches (in characters) of the joined text that training
    learns from; neighbouring pieces are one."""
    step = lambda acc, s: F.struct(
        (acc["at"] + F.length(s["text"])).cast("int").alias("at"),
        F.when(s["learnt"] & (F.length(s["text"]) > 0), F.when(
            F.try_element_at(acc["spans"], F.lit(-1))["end"] == acc["at"],
            F.concat(F.slice(acc["spans"], 1, F.size(acc["spans"]) - 1), F.array(F.struct(
                F.try_element_at(acc["spans"], F.lit(-1))["begin"].alias("begin"), (acc["at"] + F.length(s["text"])).cast("int").alias("end")))))
            .otherwise(F.concat(acc["spans"], F.array(F.struct(
                acc["at"].alias("begin"), (acc["at"] + F.length(s["text"])).cast("int").alias("end"))))))
        .otherwise(acc["spans"]).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("spans"))
    return F.when(_c(segments).isNotNull(), F.aggregate(_c(segments), start, step)["spans"])


def compiled(source: str) -> Template:
    """Compile a chat template.  Raises ``TemplateError`` for what is not supported."""
    nodes, _ = _tree(_tokens(source), 0, ())
    return Template(nodes)
