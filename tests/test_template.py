"""Chat templates against plain Python renderers."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import template

CHATML = ("{% for message in messages %}{% if loop.first and messages[0]['role'] != 'system' %}"
          "{{ '<|im_start|>system\nYou help.<|im_end|>\n' }}{% endif %}"
          "{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}"
          "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}")

HEADERS = """{% set loop_messages = messages %}{% for message in loop_messages %}
    {% set content = '<|start|>' + message['role'] + '<|stop|>\n\n' + message['content'] | trim + '<|eot|>' %}
    {% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}
    {{- content }}{% endfor %}
{% if add_generation_prompt %}{{ '<|start|>assistant<|stop|>\n\n' }}{% endif %}"""

INST = """{%- if messages[0]['role'] == 'system' %}
    {%- set system = messages[0]['content'] %}
    {%- set rest = messages[1:] %}
{%- else %}
    {%- set system = '' %}
    {%- set rest = messages %}
{%- endif %}
{{- bos_token }}
{%- for m in rest %}
    {%- if m.role == 'user' %}
        {%- if loop.first and system != '' %}
            {{- '[INST] ' + system + '\n\n' + m.content + '[/INST]' }}
        {%- else %}
            {{- '[INST] ' + m.content + '[/INST]' }}
        {%- endif %}
    {%- elif m.role == 'assistant' %}
        {%- generation %}{{ ' ' + m.content | trim + eos_token }}{% endgeneration %}
    {%- else %}
        {{- '[' + m.role | upper + ']' }}
    {%- endif %}
{%- endfor %}"""


def plain_chatml(ms, prompt):
    out = "" if not ms or ms[0][0] == "system" else "<|im_start|>system\nYou help.<|im_end|>\n"
    out += "".join(f"<|im_start|>{r}\n{c or ''}<|im_end|>\n" for r, c in ms)
    return out + "<|im_start|>assistant\n" * prompt


def plain_headers(ms, prompt):
    out = "".join(("<s>" if i == 0 else "") + f"<|start|>{r}<|stop|>\n\n{(c or '').strip()}<|eot|>" for i, (r, c) in enumerate(ms))
    return out + "<|start|>assistant<|stop|>\n\n" * prompt


def plain_inst(ms):
    """Text and what training learns from."""
    system, rest = (ms[0][1] or "", ms[1:]) if ms and ms[0][0] == "system" else ("", ms)
    out, learnt = "<s>", []
    for i, (r, c) in enumerate(rest):
        c = c or ""
        if r == "user":
            out += f"[INST] {system}\n\n{c}[/INST]" if i == 0 and system else f"[INST] {c}[/INST]"
        elif r == "assistant":
            piece = " " + c.strip() + "</s>"
            if learnt and learnt[-1][1] == len(out):
                learnt[-1] = (learnt[-1][0], len(out) + len(piece))
            else:
                learnt.append((len(out), len(out) + len(piece)))
            out += piece
        else:
            out += f"[{r.upper()}]"
    return out, learnt


@pytest.fixture(scope="module")
def chats(spark):
    rnd = random.Random(6)
    rows = [(0, []), (1, [("system", "be kind"), ("user", " hi \n"), ("assistant", "\tyes "), ("assistant", "more")]), (2, [("user", None)])]
    for i in range(3, 120):
        rows.append((i, [(rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["a", " b c ", "", "\n", "é日本 x", "'q'"]))
                         for _ in range(rnd.randint(1, 7))]))
    return rows, spark.createDataFrame(rows, "id int, m array<struct<role: string, content: string>>")


@pytest.mark.parametrize("prompt", [False, True])
@pytest.mark.parametrize("source,plain", [(CHATML, plain_chatml), (HEADERS, plain_headers)])
def test_published_styles(chats, source, plain, prompt):
    rows, df = chats
    got = df.select("id", template.compiled(source).render("m", prompt, bos_token="<s>").alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: plain(ms, prompt) for i, ms in rows}


def test_learnt_spans(chats):
    rows, df = chats
    segments = template.compiled(INST).segments("m", bos_token="<s>", eos_token="</s>")
    got = df.select("id", segments.alias("s")).select("id", template.joined("s").alias("t"), template.learnt_spans("s").alias("l")).collect()
    for r in got:
        text, learnt = plain_inst(rows[r["id"]][1])
        assert r["t"] == text and [tuple(x) for x in r["l"]] == learnt, rows[r["id"]]


def test_conditions_and_blanks(spark):
    df = spark.createDataFrame([([("user", "x"), ("tool", "y")],), (None,)], "m array<struct<role: string, content: string>>")
    render = lambda s, **v: df.select(template.compiled(s).render("m", **v)).first()[0]
    assert render("a\n  {% if tools %}T{% else %}\nN{% endif %}\n b") == "a\nN b"
    assert render("{% for m in messages %}{{ loop.index }}{% if not loop.last %}, {% endif %}{% endfor %}") == "1, 2"
    assert render("{% if messages | length > 1 and name == 'n' %}{{ name }}{% endif %}", name="n") == "n"
    assert render("{% for m in messages %}{% if m.role in ['tool', 'u'] %}{{ m['content'] }}{% endif %}{% endfor %}") == "y"
    assert render("{{ messages[-1]['role'] }}{# a note #}!") == "tool!"
    assert df.select(template.compiled("x").render("m")).where("m is null").collect()[0][0] is None


@pytest.mark.parametrize("bad", ["{% for m in messages %}", "{% if x %}", "{% macro f() %}", "{{ 1 + }}", "{{ x | tojson }}", "{% for m in 'x' %}{% endfor %}"])
def test_errors(spark, bad):
    with pytest.raises(template.TemplateError):
        template.compiled(bad).render(F.array())
