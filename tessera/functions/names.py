"""Split and log names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import _c, basename_no_ext

TS_FORMAT = "yyyyMMdd_HHmmss"   # Python's "%Y%m%d_%H%M%S"


def bucket_split_name(label, lang) -> Column:
    """``{range_a_b}_{lang}``."""
    return F.concat_ws("_", _c(label), _c(lang))


def range_split_name(split: str, start: int, end: int) -> str:
    """``{split}_{start}_{end}``."""
    return f"{split}_{start}_{end}"


def parts_split_name(split: str, start: int, end: int, consistent: bool,
                     expected_parts: int | None) -> str:
    """Index-range name with ``_{k}parts`` when the survey was consistent."""
    base = range_split_name(split, start, end)
    if consistent and expected_parts is not None:
        return f"{base}_{expected_parts}parts"
    return base


def retry_split_name(log_path, original_split, n_ids, ts) -> Column:
    """``retry_{name without failed_ids_}_{n}samples`` for logs named by the
    multi-turn job, else ``retry_{name}_{split}_{n}samples_{timestamp}``."""
    name = basename_no_ext(log_path)
    n = _c(n_ids).cast("string")
    return F.when(F.startswith(name, F.lit("failed_ids_")),
                  F.concat(F.lit("retry_"), F.substring(name, 12, 1 << 30), F.lit("_"), n,
                           F.lit("samples"))
                  ).otherwise(F.concat(F.lit("retry_"), name, F.lit("_"), _c(original_split),
                                       F.lit("_"), n, F.lit("samples_"),
                                       F.date_format(_c(ts), TS_FORMAT)))


def log_file_stem(dataset: str) -> str:
    """Dataset names become file-name safe (``/`` → ``_``)."""
    return dataset.replace("/", "_")
