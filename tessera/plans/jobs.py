"""End-to-end jobs (C3-C8) composed from the operators.

Model calls are not part of the library: a *responder* turns requests into a
``(key, response)`` table — a stand-in in tests, or a user's ``mapInPandas``
hook around a model client (see ``model_hook``).  Jobs write the counted documents, the requests, the
responses and the judged rows once and read them back, so each request is sent
once however many consumers follow, and the logs match the published rows.
``publish_*`` helpers write the results as named splits and the logs; run a job
and its publishing inside ``session.scratch_space`` to drop its tables.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonx import clean_cad_json, clean_cad_json_exact
from tessera.functions.names import (bucket_split_name, parts_split_name, range_split_name,
                                     retry_split_name)
from tessera.functions.text import description_block, first_tag
from tessera.functions.tokens import approx_token_count, bucket_label
from tessera.operators import position, requests as rq, responses as rs, retry, survey
from tessera.session import stored
from tessera.sources import logs, splits

Responder = Callable[[DataFrame, DataFrame], DataFrame]


def model_hook(call: Callable[[str], str | None], key_col: str = "batch_id",
               request_col: str = "request") -> Callable[[DataFrame], DataFrame]:
    """Wrap a per-request model callable as a ``mapInPandas`` step over the
    requests table.  Any exception makes that response null (the rows of the
    request are then failed, as in the reference)."""

    def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf[request_col]:
                try:
                    out.append(call(r))
                except Exception:  # noqa: BLE001 - a failed call is data here
                    out.append(None)
            yield pd.DataFrame({key_col: pdf[key_col], "response": out})

    def apply(requests: DataFrame) -> DataFrame:
        key_type = dict(requests.dtypes)[key_col]
        return requests.mapInPandas(_run, f"{key_col} {key_type}, response string")

    return apply


# ---------------------------------------------------------------- C6
def clean_and_bucket(stage1: DataFrame, width: int = 500, labels=("en", "vi"),
                     json_mode: str = "exact", counter=approx_token_count,
                     ord_col: str = "ord") -> DataFrame:
    """``json_mode``: "exact" keeps every field and spelling of the cleaned document;
    "typed_lossy" stays in the JVM but keeps schema fields only.  Language by position → description block → cleaned JSON → drop invalid
    → token count → ``range_{a}_{b}_{lang}`` split (C6).  One narrow plan; the
    only wide step is the final partitioned write."""
    clean = {"exact": clean_cad_json_exact, "typed_lossy": clean_cad_json}[json_mode]
    df = position.deinterleave(stage1, labels, ord_col)
    df = (df.withColumn("prompt", description_block(F.col("prompt")))
            .withColumn("completion", clean(F.col("completion")))
            .where(F.col("completion").isNotNull())
            .withColumn("n_tokens", counter(F.col("prompt"))))
    return df.withColumn("split", bucket_split_name(bucket_label(F.col("n_tokens"), width), F.col("lang")))


def publish_buckets(cleaned: DataFrame, path: str) -> None:
    """Write every bucket of ``clean_and_bucket`` as a named split."""
    splits.write_splits(cleaned, path)


# ---------------------------------------------------------------- P3-P5
def assemble_train(reasoned: DataFrame, instruction: str = rq.TRAIN_INSTRUCTION,
                   keep=("doc_id",)) -> DataFrame:
    return rq.train_pairs(reasoned, instruction, rename={"test": "val", "en_vi": "train_en_vi"},
                          keep=keep)


# ---------------------------------------------------------------- C5
def reasoning_job(bucket: DataFrame, responses: DataFrame, split: str, start: int,
                  end: int | None, clamp_name: bool = False, ord_col: str = "ord"
                  ) -> tuple[DataFrame, str]:
    """Slice ``[start, end)`` → responses by position → accept/reject.
    Returns (all sliced rows with ``accepted``, split name).  Accepted rows
    are ``where(accepted)``; rejected positions ``where(~accepted)`` (S7)."""
    sliced = position.slice_range(bucket, start, end, ord_col)
    judged = rs.accept(sliced.join(responses, ord_col, "left"))
    e = end
    if clamp_name or end is None:
        e = position.clamped_end(bucket, end)
    return judged, range_split_name(split, start, e)


def run_reasoning(bucket: DataFrame, responder: Responder, split: str, start: int, end: int | None,
                  clamp_name: bool = False, ord_col: str = "ord") -> dict:
    """C5 from rows to verdicts: slice → one request per row (P7) → responses, stored once →
    accept/reject, stored once.  ``bucket`` has ``ord, prompt, completion``."""
    sliced = position.slice_range(bucket, start, end, ord_col)
    reqs = stored(rq.single_requests(sliced).select(ord_col, "request"), "reasoning-requests")
    responses = stored(responder(sliced, reqs).select(ord_col, "response"), "reasoning-responses")
    judged, name = reasoning_job(bucket, responses, split, start, end, clamp_name, ord_col)
    judged = stored(judged, "reasoning-judged")
    return {"judged": judged, "requests": reqs, "split": name, "counts": rs.accept_counts(judged)}


def publish_reasoning(job: dict, path: str, log_base: str, ord_col: str = "ord") -> dict:
    """Accepted rows as a named split (S3), rejected positions as a log."""
    judged = job["judged"]
    splits.write_splits(judged.where("accepted").select(
        "description", "reasoning", "completion", F.lit(job["split"]).alias("split")), path)
    folder = f"{log_base}/valid_{job['split']}"
    logs.write_invalid_positions(judged.where(~F.col("accepted")), folder, ord_col)
    return {"split": job["split"], "invalid": folder}


# ---------------------------------------------------------------- C7 / C8
def predictions(source: DataFrame, responses: DataFrame, key: str = "uid",
                input_col: str = "input", output_col: str = "output") -> DataFrame:
    """Inference results beside the truth (C7, J4, P13).  ``key`` is unique in
    ``responses``; a repeated key would repeat its source row."""
    r = F.col("response")
    j = source.join(responses, key, "left")
    return j.select(key, F.col(input_col).alias("input"),
                    first_tag(F.coalesce(r, F.lit("")), "think").alias("reasoning"),
                    first_tag(F.coalesce(r, F.lit("")), "json").alias("predicted_output"),
                    F.col(output_col).alias("ground_truth_output"))


def predictions_range(source: DataFrame, responses: DataFrame, split: str, start: int,
                      end: int | None, key: str = "uid", ord_col: str = "ord",
                      **kw) -> tuple[DataFrame, str]:
    """Index range with the clamped end in the split name."""
    e = position.clamped_end(source, end)
    sliced = position.slice_range(source, start, e, ord_col)
    return predictions(sliced, responses, key, **kw), range_split_name(split, start, e)


def run_predictions(source: DataFrame, responder: Responder, split: str, start: int = 0,
                    end: int | None = None, key: str = "uid", ord_col: str = "ord",
                    input_col: str = "input", output_col: str = "output") -> dict:
    """C7/C8 from rows to predictions: slice → rendered requests (P9) → responses, stored once →
    results beside the truth.  ``source`` has ``ord`` if a range is asked for."""
    name = split
    if start or end is not None:
        e = position.clamped_end(source, end)
        source, name = position.slice_range(source, start, e, ord_col), range_split_name(split, start, e)
    reqs = stored(rq.inference_requests(source, input_col).select(key, F.col("rendered").alias("request")), "pred-requests")
    responses = stored(responder(source, reqs).select(key, "response"), "pred-responses")
    out = stored(predictions(source, responses, key, input_col, output_col), "predictions")
    return {"predictions": out, "requests": reqs, "split": name}


def publish_predictions(job: dict, path: str) -> str:
    """The predictions as a named split (S3)."""
    splits.write_splits(job["predictions"].withColumn("split", F.lit(job["split"])), path)
    return job["split"]


# ---------------------------------------------------------------- C3
def _with_id(data: DataFrame, id_col: str, ord_col: str) -> DataFrame:
    """Rows without an id column are named by their position (X13); a null id stays null."""
    if id_col in data.columns:
        return data
    return data.withColumn(id_col, F.concat(F.lit("unknown_"), F.col(ord_col).cast("string")))


def _respond(batched: DataFrame, responder: Responder, batch_size: int, max_parts: int) -> tuple[DataFrame, DataFrame]:
    """Requests, then the judged rows: requests, responses and verdicts are each written once."""
    reqs = stored(rq.batch_requests(batched), "requests")
    responses = stored(responder(batched, reqs).select("batch_id", "response"), "responses")
    return reqs, stored(rs.verdict(rs.unbatch(batched, responses, batch_size), max_parts), "judged")


def multi_turn_job(data: DataFrame, responder: Responder, batch_size: int = 5,
                   expected_parts: int | None = None, start: int = 0,
                   workers: int | None = None, per_worker: int | None = None,
                   split: str = "data", on_mismatch: str = "stop",
                   id_col: str = "id", ord_col: str = "ord") -> dict:
    """Survey → gate → slice → batch → respond → un-batch → verdict.

    ``data`` has ``completion`` and ``ord`` (and ``id``; without it the id is
    ``unknown_{ord}``).  Returns the stored frames ``judged`` (one row per input
    row, ok or failed) and ``requests``, ``failed_ids``, and the driver-side
    survey dict, ``max_parts`` and ``split`` name."""
    # stored: the survey and the verdicts read the same part counts, so every document is parsed once
    data = stored(survey.with_part_count(_with_id(data, id_col, ord_col)).drop("parsed"), "counted")
    s = survey.gate(survey.survey(data, expected_parts), expected_parts, on_mismatch)
    max_parts = int(s["max_parts"])
    rows = position.slice_range(data, start, None, ord_col)
    if workers and per_worker:
        rows, _ = position.worker_slices(rows, workers, per_worker, start, ord_col)
    batched = position.with_batches(rows, batch_size, start, ord_col)     # arithmetic on the position: not stored again
    total = batched.count()
    reqs, judged = _respond(batched, responder, batch_size, max_parts)
    name = parts_split_name(split, start, start + total, bool(s["is_consistent"]), expected_parts)
    return {"judged": judged, "requests": reqs, "survey": s, "max_parts": max_parts,
            "split": name, "start": start, "failed_ids": judged.where(F.col("is_failed")).select(id_col)}


def publish_multi_turn(job: dict, path: str, log_base: str, dataset: str, source_split: str,
                       id_col: str = "id", ts: str | None = None) -> dict:
    """Wide rows of every judged row as a named split (P15, S3, S12), failed ids as a log."""
    wide = rs.widen(job["judged"], job["max_parts"], keep=(id_col,))
    splits.write_splits(wide.withColumn("split", F.lit(job["split"])), path)
    folder, n = logs.write_failed_log(job["failed_ids"], log_base, dataset, source_split, job["start"], id_col, ts)
    return {"split": job["split"], "log": folder, "n_failed": n}


# ---------------------------------------------------------------- C4
def retry_job(data: DataFrame, ids: DataFrame, responder: Responder, batch_size: int = 4,
              expected_parts: int | None = None, id_col: str = "id",
              ord_col: str = "ord", on_mismatch: str = "warn") -> dict | None:
    """Failed ids → rows (semi join) → parts survey → the C3 tail (C4).
    Found rows keep dataset order through their ``ord``; batches number them
    again from 0 (``retry_ord``).  None when the list is empty or no row is found.
    ``warnings`` says when no found row has ``expected_parts`` (an error with
    ``on_mismatch="stop"``)."""
    data = _with_id(data, id_col, ord_col)
    # the table of with_ord holds the semi join's result and its part counts once: documents are parsed behind the exchange
    found = position.with_ord(retry.failed_rows(data, ids, id_col).drop("retry_ord"), ord_col, "retry_ord",
                              then=survey.with_part_count)
    if found.isEmpty():
        return None
    dist = survey.histogram(found, include_zero=True)
    warnings = []
    max_parts = expected_parts
    if expected_parts and found.where(F.col("parsed") & (F.col("part_count") == expected_parts)).isEmpty():
        warnings.append(f"no failed row has {expected_parts} parts")
        if on_mismatch == "stop":
            raise survey.SurveyGateError(warnings[0])
    if not expected_parts:
        max_parts = int(found.agg(F.max("part_count")).first()[0] or 0)
        if max_parts == 0:
            raise survey.SurveyGateError("cannot determine max_parts from failed rows")
    batched = position.with_batches(found, batch_size, 0, "retry_ord")
    reqs, judged = _respond(batched, responder, batch_size, max_parts)
    return {"found": found, "distribution": dist, "max_parts": max_parts, "judged": judged, "requests": reqs,
            "summary": retry.retry_summary(ids, found, judged, id_col), "warnings": warnings,
            "missing": retry.missing_ids(ids, data, id_col), "n_ids": ids.count(),
            "failed_ids": judged.where(F.col("is_failed")).select(id_col)}


def publish_retry(job: dict, path: str, log_base: str, log_path: str, dataset: str, source_split: str,
                  id_col: str = "id", ts: str | None = None) -> dict:
    """Wide rows of the retried rows as a named split (S13), ids that failed again as a log."""
    spark = job["judged"].sparkSession
    name = spark.range(1).select(retry_split_name(F.lit(log_path), F.lit(source_split), F.lit(job["n_ids"]),
                                                  F.current_timestamp())).first()[0]
    wide = rs.widen(job["judged"], job["max_parts"], keep=(id_col,))
    splits.write_splits(wide.withColumn("split", F.lit(name)), path)
    folder, n = logs.write_retry_log(job["failed_ids"], log_base, log_path, dataset, name, id_col, ts)
    return {"split": name, "log": folder, "n_failed": n}
