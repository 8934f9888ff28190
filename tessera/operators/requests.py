"""Model requests built as columns: one row per request, never a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import chat
from tessera.functions.text import _c, join_lines

# Default templates (own wording).  Every template is a parameter.
TRAIN_INSTRUCTION = (
    "<objective>\nTurn the CAD description into a JSON document of sketches and extrusions. "
    "Reason inside <think> first, then give the JSON inside <json>.\n</objective>")
STAGE1_INSTRUCTION = (
    "<objective>\nTurn the CAD description into a JSON document of sketches and "
    "extrusions. Answer with the JSON only.\n</objective>")
SYSTEM_MESSAGE = "You write CAD models as JSON."
REVIEW_TEMPLATE = ("Review the pair below. Answer <valid>Yes</valid> or <valid>No</valid>, "
                   "then a <description> and a <think> explaining the JSON.\n"
                   "<input>\n{prompt}\n</input>\n<output>\n{completion}\n</output>")
BATCH_RULES = "Follow the rules of the example for every sample."


def wrap_prompt(df: DataFrame, input_col: str = "input", output_col: str = "output",
                instruction: str = STAGE1_INSTRUCTION, keep=("uid",)) -> DataFrame:
    """Raw ``input/output`` → ``prompt/completion`` (P1, P2).  A list input is
    newline-joined first; other columns are dropped."""
    src = F.col(input_col)
    is_list = dict(df.dtypes)[input_col].startswith("array")
    text = join_lines(src) if is_list else src
    prompt = F.concat(F.lit(instruction + "\n\n<description>\n"), text, F.lit("\n</description>"))
    return df.select(*keep, prompt.alias("prompt"), F.col(output_col).alias("completion"))


def train_pairs(df: DataFrame, instruction: str = TRAIN_INSTRUCTION,
                description_col: str = "description", reasoning_col: str = "reasoning",
                completion_col: str = "completion", split_col: str | None = "split",
                rename: dict | None = None, keep=()) -> DataFrame:
    """Prompt = instruction + blank line + description; target = reasoning +
    blank line + completion (P3, P4).  Train and test share the projection; the
    ``split`` column is renamed through ``rename`` (P5, e.g. test → val)."""
    cols = [*keep,
            F.concat(F.lit(instruction + "\n\n"), F.col(description_col)).alias("prompt"),
            F.concat(F.col(reasoning_col), F.lit("\n\n"), F.col(completion_col)).alias("completion")]
    if split_col:
        s = F.col(split_col)
        for old, new in (rename or {}).items():
            s = F.when(F.col(split_col) == old, F.lit(new)).otherwise(s)
        cols.append(s.alias("split"))
    return df.select(*cols)


def _fill(template: str, values: dict):
    """``template.format(**values)`` as a ``concat`` of literals and columns."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(_c(values[m.group(1)]))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def single_requests(df: DataFrame, template: str = REVIEW_TEMPLATE,
                    prompt_col: str = "prompt", completion_col: str = "completion") -> DataFrame:
    """One request text per row."""
    return df.withColumn("request", _fill(template, {"prompt": prompt_col,
                                                      "completion": completion_col}))


def batch_requests(batched: DataFrame, input_col: str = "completion",
                   rules: str = BATCH_RULES) -> DataFrame:
    """k rows → one request (P8): numbered ``<input_i>`` blocks, a numbered
    ``<sample_i>`` skeleton and the rules.  Groups are bounded by the batch
    size, so ``collect_list`` per ``batch_id`` holds at most k small structs."""
    g = batched.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col(input_col).alias("x")))).alias("items"))
    inputs = F.array_join(F.transform("items", lambda it: F.concat(
        F.lit("<input_"), it["pos"], F.lit(">\n"), it["x"], F.lit("\n</input_"), it["pos"],
        F.lit(">"))), "\n")
    skeleton = F.array_join(F.transform("items", lambda it: F.concat(
        F.lit("<sample_"), it["pos"], F.lit(">\noutput_"), it["pos"], F.lit("\n</sample_"),
        it["pos"], F.lit(">"))), "\n")
    k = F.size("items")
    request = F.concat(F.lit("Process each of the "), k.cast("string"),
                       F.lit(" inputs separately.\n\nINPUTS:\n"), inputs,
                       F.lit("\n\nOUTPUT:\n"), skeleton, F.lit("\n\nRULES:\n" + rules + "\n"))
    return g.select("batch_id", k.cast("bigint").alias("n_rows"), request.alias("request"))


def inference_requests(df: DataFrame, text_col: str, template: str = TRAIN_INSTRUCTION,
                       system: str = SYSTEM_MESSAGE, chat_template: dict | None = None
                       ) -> DataFrame:
    """System + user messages rendered with the generation prefix."""
    user = F.concat(F.lit(template + "\n\n<description>\n"), F.col(text_col),
                    F.lit("\n</description>"))
    msgs = chat.messages(("system", F.lit(system)), ("user", user))
    return df.withColumn("messages", msgs).withColumn(
        "rendered", chat.render("messages", chat_template, add_generation_prompt=True))


def chat_pairs(df: DataFrame, prompt_col: str = "prompt", completion_col: str = "completion",
               system_col: str | None = None, chat_template: dict | None = None) -> DataFrame:
    """Prompt → ``[{system}, {user}]``, completion → ``[{assistant}]`` and the rendered
    training text (P10, P12, C9).  A null system, prompt or completion gives no message; an
    unanswered prompt renders up to its user message."""
    present = lambda m: F.filter(m, lambda x: x["content"].isNotNull())
    head = [("system", F.col(system_col))] if system_col else []
    return (df.withColumn("prompt_messages", present(chat.messages(*head, ("user", F.col(prompt_col)))))
              .withColumn("completion_messages", present(chat.messages(("assistant", F.col(completion_col)))))
              .withColumn("text", chat.render(F.concat("prompt_messages", "completion_messages"),
                                              chat_template)))
