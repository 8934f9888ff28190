"""Chat messages and their text rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.template import Template, compiled
from tessera.functions.text import _c

# ChatML-style delimiters used when no other template is given.
CHATML = {"start": "<|im_start|>", "sep": "\n", "end": "<|im_end|>\n",
          "generation": "<|im_start|>assistant\n"}


#: The delimiters of two common template styles; what the assistant writes is learnt.
CHATML_TEMPLATE = ("{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\n' }}"
                   "{% if message['role'] == 'assistant' %}{% generation %}{{ message['content'] }}{% endgeneration %}"
                   "{% else %}{{ message['content'] }}{% endif %}{{ '<|im_end|>\n' }}{% endfor %}"
                   "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}")
INST_TEMPLATE = ("{% if messages[0]['role'] == 'system' %}{% set system = messages[0]['content'] | trim %}{% set rest = messages[1:] %}"
                 "{% else %}{% set system = '' %}{% set rest = messages %}{% endif %}{{ bos_token }}"
                 "{% for m in rest %}{% if m.role == 'user' %}{{ '[INST] ' }}"
                 "{% if loop.first and system != '' %}{{ system + '\n\n' }}{% endif %}{{ m.content | trim + ' [/INST]' }}"
                 "{% elif m.role == 'assistant' %}{% generation %}{{ ' ' + m.content | trim + eos_token }}{% endgeneration %}"
                 "{% endif %}{% endfor %}")


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _c(content).alias("content"))


def messages(*pairs) -> Column:
    """``messages(("system", c1), ("user", c2))`` → ``array<struct<role,content>>``."""
    return F.array(*[message(r, c) for r, c in pairs])


def render(msgs, template=None, add_generation_prompt: bool = False, **variables) -> Column:
    """Render messages to one string: with a dict of delimiters (every message alike), or with a chat
    template (its source, or compiled by ``functions.template``)."""
    if isinstance(template, (str, Template)):
        compiled_template = compiled(template) if isinstance(template, str) else template
        return compiled_template.render(msgs, add_generation_prompt, **variables)
    t = template or CHATML
    body = F.array_join(F.transform(_c(msgs), lambda m: F.concat(
        F.lit(t["start"]), m["role"], F.lit(t["sep"]), m["content"], F.lit(t["end"]))), "")
    return F.concat(body, F.lit(t["generation"])) if add_generation_prompt else body
