"""A ledger of model responses, so that a call that was answered is never sent again.

A request is known by its digest.  The ledger is a folder of small JSON-lines files, each written and
closed right after the calls it holds (``every`` calls, one by default), so what was answered
survives a task that fails half-way, a lost executor and a driver that dies:

* before sending, requests meet the ledger by an anti join on the digest, and equal requests are
  one;
* they are dealt to tasks by digest, so a retried task gets the requests of the one before; it reads
  the files of its part of the run first and goes on behind them;
* a rerun of the job finds everything in the ledger and sends nothing.

A speculative copy of a task would run beside the first and send the same calls, so a session with
``spark.speculation`` is refused.  Executors reach the folder through ``pyarrow.fs`` (a shared mount,
or a store that pyarrow knows); ``compact`` merges the small files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "digest string, ok boolean, response string"


def digest(request, model: str = "") -> F.Column:
    """The name of a request to one model (``model``: its name and settings)."""
    return F.sha2(F.concat_ws("\n", F.lit(model), request).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``digest, ok, response``: one row per digest, an answer before a failed call.  A line that was
    cut off by a crash is no row."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return rows.where("digest is not null and ok is not null").groupBy("digest").agg(
        F.max("ok").alias("ok"), F.max_by("response", F.struct("ok", F.coalesce("response", F.lit("")))).alias("response"))


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sender(call: Callable[[str], str | None], path: str, run: str, every: int = 1, part: Callable[[], int] | None = None):
    """A ``mapInPandas`` function over ``digest, request`` that sends what its part of the run has not
    sent yet and writes every answer down before the next call.  A call that raises is a failed call."""
    part = part or (lambda: TaskContext.get().partitionId())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        store, root = _filesystem(path)
        folder = f"{root}/{run}/part-{part():06d}"
        done = set()
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            with store.open_input_stream(f.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        done.add(json.loads(line)["digest"])
                    except ValueError:                     # cut off by a crash: as if not sent
                        pass
        store.create_dir(folder, recursive=True)
        held: list[dict] = []

        def write():
            if held:
                with store.open_output_stream(f"{folder}/{uuid.uuid4().hex}.jsonl") as out:
                    out.write("".join(json.dumps(h) + "\n" for h in held).encode())
                held.clear()

        sent = 0
        try:
            for pdf in batches:
                for name, request in zip(pdf["digest"], pdf["request"]):
                    if name in done:
                        continue
                    try:
                        held.append({"digest": name, "ok": True, "response": call(request)})
                    except Exception:  # noqa: BLE001 - a failed call is data here
                        held.append({"digest": name, "ok": False, "response": None})
                    done.add(name)
                    sent += 1
                    if len(held) >= every:
                        write()
        finally:
            write()
        yield pd.DataFrame({"sent": [sent]})

    return send


def send_new(requests: DataFrame, call: Callable[[str], str | None], path: str, model: str = "", request_col: str = "request",
             every: int = 1, retry_failed: bool = False, parts: int | None = None) -> int:
    """Send the requests that the ledger has no answer for; returns how many calls were made.
    ``retry_failed`` sends those again whose call failed."""
    spark = requests.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks would send calls twice: turn spark.speculation off")
    store, root = _filesystem(path)
    store.create_dir(root, recursive=True)
    known = read_ledger(spark, path)
    known = (known.where("ok") if retry_failed else known).select("digest")
    new = (requests.where(F.col(request_col).isNotNull())
           .select(digest(F.col(request_col), model).alias("digest"), F.col(request_col).alias("request"))
           .join(known, "digest", "left_anti").dropDuplicates(["digest"]))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = new.repartition(parts, "digest").mapInPandas(sender(call, path, f"run-{uuid.uuid4().hex}", every), "sent long")
    return int(made.agg(F.sum("sent")).first()[0] or 0)


def answers(requests: DataFrame, path: str, model: str = "", key_col: str = "batch_id", request_col: str = "request") -> DataFrame:
    """``key_col, response`` of every request, from the ledger; null if it failed or was never sent."""
    named = requests.select(key_col, digest(F.col(request_col), model).alias("digest"))
    return named.join(read_ledger(requests.sparkSession, path).select("digest", "response"), "digest", "left").select(key_col, "response")


def ledger_hook(call: Callable[[str], str | None], path: str, model: str = "", key_col: str = "batch_id", request_col: str = "request",
                **options) -> Callable[[DataFrame], DataFrame]:
    """As ``jobs.model_hook``, with a ledger: requests in, ``key_col, response`` out, no call made twice."""
    def apply(requests: DataFrame) -> DataFrame:
        send_new(requests, call, path, model, request_col, **options)
        return answers(requests, path, model, key_col, request_col)

    return apply


def compact(spark: SparkSession, path: str, files: int = 1) -> None:
    """Merge all files into ``files`` new ones.  The old ones go only after the new ones are there; a crash
    in between leaves both, which read as one."""
    store, root = _filesystem(path)
    from pyarrow import fs
    old = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    if not old:
        return
    target = f"{path.rstrip('/')}/merged-{uuid.uuid4().hex}"
    rows = read_ledger(spark, path).select(F.to_json(F.struct("digest", "ok", "response"), {"ignoreNullFields": "false"}).alias("value"))
    rows.repartition(files).write.text(target)
    made = f"{root.rstrip('/')}/{target.rsplit('/', 1)[-1]}"
    for f in store.get_file_info(fs.FileSelector(made)):
        if f.path.endswith(".txt"):
            store.move(f.path, f.path[:-4] + ".jsonl")
    for f in old:
        store.delete_file(f)
