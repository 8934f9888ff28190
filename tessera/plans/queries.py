"""The registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables (directly or through ``fixtures``) and runs
one operator family of the library over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, chat, jsonx, names, template, text as tx, tokens
from tessera.operators import cad, coverage, labels, position, requests as rq, responses as rs, retry, survey
from tessera.plans import fixtures as fx, jobs
from tessera.session import scratch_dir, stored
from tessera.sources import batches, ledger, logs, positions, snapshots, splits, survey_state

BATCH = 4


def tag_first_trimmed(spark, d):
    a = F.col("answer")
    return fx.tagged(spark, d).select("doc_id", *[tx.first_tag(a, t).alias(t) for t in
                                                  ("think", "json", "valid", "description")])


def tag_first_or_null(spark, d):
    a = F.col("answer")
    return fx.tagged(spark, d).select("doc_id", *[tx.first_tag_or_null(a, t).alias(t) for t in
                                                  ("think", "json", "valid", "description")])


def description_block(spark, d):
    return fx.tagged(spark, d).select("doc_id", tx.description_block(F.col("answer")).alias("prompt"))


def prompt_wrap(spark, d):
    raw = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), F.split("text", "\n").alias("input"),
        F.concat(F.lit('{"lang":"'), "lang", F.lit('","n":'), F.col("n_chars").cast("string"),
                 F.lit("}")).alias("output"))
    return rq.wrap_prompt(raw)


def assemble_train(spark, d):
    return jobs.assemble_train(fx.reasoned(spark, d)).select("doc_id", "split", "prompt", "completion")


def train_length_max(spark, d):
    t = jobs.assemble_train(fx.reasoned(spark, d))
    return t.groupBy("split").agg(F.max(tokens.approx_token_count(
        F.concat("prompt", "completion"))).alias("max_tokens"))


def json_strict_filter(spark, d):
    c = fx.cad_damaged(spark, d)
    return c.select("id", jsonx.json_block(F.col("completion")).alias("doc")).where(
        F.col("doc").isNotNull())


def json_clean(spark, d):
    c = fx.cad(spark, d)
    return c.select("id", jsonx.clean_cad_json(jsonx.json_block(F.col("completion"))).alias("cleaned"))


def json_clean_exact(spark, d):
    c = fx.cad(spark, d)
    return c.select("id", jsonx.clean_cad_json_exact(jsonx.json_block(F.col("completion"))).alias("cleaned"))


def part_count(spark, d):
    return survey.with_part_count(fx.cad_damaged(spark, d)).select("id", "part_count")


def part_survey(spark, d):
    return survey.survey(survey.with_part_count(fx.cad_damaged(spark, d)), expected_parts=3)


def part_histogram(spark, d):
    return survey.histogram(survey.with_part_count(fx.cad_damaged(spark, d)))


def deinterleave_lang(spark, d):
    c = position.with_ord(fx.cad_damaged(spark, d), "id")
    c = position.deinterleave(c).withColumn("kept", jsonx.json_block(F.col("completion")).isNotNull())
    return survey.lang_counts(c, "kept")


def interleave(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    by_lang = [position.with_ord(docs.where(F.col("lang") == x), "doc_id") for x in ("en", "fr", "de", "es")]
    return position.interleave(by_lang).select("ord", "doc_id", "lang")


def index_slice(spark, d):
    o = position.with_ord(fx.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    name = f"orders_{1000}_{20000}"
    return position.slice_range(o, 1000, 20000).select("ord", "o_orderkey", F.lit(name).alias("split"))


def worker_slices(spark, d):
    o = position.with_ord(fx.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    rows, _ = position.worker_slices(o, workers=4, per_worker=3000, start=100)
    return rows.groupBy("slice_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def _doc_buckets(spark, d):
    docs = fx.table(spark, d, "documents")
    n = tokens.approx_token_count(F.col("text"))
    return docs.withColumn("n_tokens", n).withColumn(
        "split", F.concat_ws("_", tokens.bucket_label(F.col("n_tokens")), F.col("lang")))


def token_buckets(spark, d):
    return splits.split_sizes(_doc_buckets(spark, d))


def token_minmax(spark, d):
    return survey.token_minmax(_doc_buckets(spark, d))


def split_sizes(spark, d):
    b = _doc_buckets(spark, d).select("doc_id", "text", "split", "lang")
    path = scratch_dir(spark, "splits")
    # two split dicts (English, the rest) written into one dataset, then read back whole
    splits.write_splits(b.where(F.col("lang") == "en").drop("lang"), path)
    splits.write_splits(b.where(F.col("lang") != "en").drop("lang"), path)
    return splits.split_sizes(splits.read_split(spark, path))


def _stage1_ord(spark, d):
    return position.with_ord(fx.stage1(spark, d), "doc_id")


def clean_and_bucket(spark, d):
    out = jobs.clean_and_bucket(_stage1_ord(spark, d))
    return out.select("doc_id", "lang", "split", "n_tokens", "prompt", "completion")


def single_requests(spark, d):
    return rq.single_requests(fx.stage1(spark, d)).select("doc_id", "request")


def batch_requests(spark, d):
    return rq.batch_requests(fx.batched_cad(spark, d, BATCH))


def inference_requests(spark, d):
    return rq.inference_requests(fx.table(spark, d, "documents"), "text").select("doc_id", "rendered")


def chat_messages(spark, d):
    p = rq.chat_pairs(fx.pairs(spark, d), system_col="system")
    return p.select("conv_id", "turn", F.col("completion").isNotNull().alias("answered"), "text")


def _responder(batched, _requests):
    return fx.stand_in_model(batched)


def _cad_ord(spark, d):
    return fx.with_completion(fx.cad_items_ord(spark, d))


def _first_pass(spark, d, data=None):
    """``data``: the numbered documents, for queries that read them again after the first pass."""
    # the survey and the verdict read the same part counts: the documents are parsed once
    data = _cad_ord(spark, d) if data is None else data
    b = position.with_batches(stored(survey.with_part_count(data).drop("items", "parsed"), "counted"), BATCH)
    parsed = rs.unbatch(b, fx.stand_in_model(position.with_batches(data, BATCH)), BATCH)
    max_parts = survey.gate(survey.survey(b))["max_parts"]
    return parsed, int(max_parts)


def unbatch(spark, d):
    parsed, _ = _first_pass(spark, d)
    return parsed.select("id", "batch_id", "pos", "new_length")


def _judged(spark, d, data=None):
    parsed, n = _first_pass(spark, d, data)
    return rs.verdict(parsed, n), n


def turns_long(spark, d):
    j, _ = _judged(spark, d)
    return rs.turns_long(j)


def turns_wide(spark, d):
    j, n = _judged(spark, d)
    wide = rs.widen(j, n)
    # as many columns as the survey measured; one row-count-independent schema for the comparison
    fields = [f for i in range(1, n + 1) for f in (f"input_{i}", f"think_{i}", f"json_{i}")]
    return wide.select("id", "original_completion", "new_length", F.lit(n).cast("bigint").alias("width"),
                       F.to_json(F.array(*fields)).alias("turns"))


def verdict(spark, d):
    j, _ = _judged(spark, d)
    return j.select("id", "batch_id", "pos", "new_length", "original_parts", "generated", "is_failed")


def _verdict_summary(spark, d, data=None):
    """The first pass's per-row verdict columns, written once so the failed log,
    the retry and the merge read one materialised result."""
    j, _ = _judged(spark, d, data)
    return stored(j.select("id", "generated", "original_parts", "is_failed"), "verdicts")


def _write_failed_log(spark, d, verdicts=None, data=None):
    v = verdicts if verdicts is not None else _verdict_summary(spark, d, data)
    folder, _ = logs.write_failed_log(v.where("is_failed"), scratch_dir(spark, "logs"), "tables/cad",
                                      "orders", 0)
    return folder


def failed_log(spark, d):
    ids, _ = logs.read_failed_log(spark, _write_failed_log(spark, d))
    return ids.select("id")


def _failed_ids(spark, d, verdicts=None, data=None):
    """Failed ids of the first pass as read back from its written log, plus two
    ids that are not in the data and one repeated id (a log can hold both)."""
    ids, _ = logs.read_failed_log(spark, _write_failed_log(spark, d, verdicts, data))
    f = ids.select(F.col("id").cast("bigint").alias("id"))
    extra = spark.range(-2, 0).select(F.col("id").cast("bigint"))
    rep = f.where(F.col("id") % 7 == 0).agg(F.min("id").alias("id"))
    return f.unionByName(extra).unionByName(rep)


def failed_rows(spark, d):
    data = _cad_ord(spark, d)
    return retry.failed_rows(data.select("id", "n"), _failed_ids(spark, d, data=data))


def missing_ids(spark, d):
    data = _cad_ord(spark, d)
    return retry.missing_ids(_failed_ids(spark, d, data=data), data)


def retry_parts(spark, d):
    data = _cad_ord(spark, d)
    found = retry.failed_rows(fx.damage(data).select("id", "completion"), _failed_ids(spark, d, data=data))
    return survey.histogram(survey.with_part_count(found), include_zero=True)


def _retry(spark, d, verdicts=None, data=None):
    data = _cad_ord(spark, d) if data is None else data
    return jobs.retry_job(data, _failed_ids(spark, d, verdicts, data), _responder, BATCH)


def retry_summary(spark, d):
    return _retry(spark, d)["summary"]


def retry_job(spark, d):
    return _retry(spark, d)["judged"].select("id", "new_length", "generated", "is_failed")


def multi_turn_job(spark, d):
    res = jobs.multi_turn_job(_cad_ord(spark, d), _responder, batch_size=BATCH, split="cad")
    return res["judged"].select("id", F.lit(res["split"]).alias("split"), "new_length",
                                "generated", "is_failed")


def publish_multi_turn(spark, d):
    """Run, publish and log, then read back: rows and failed ids of the published split."""
    job = jobs.multi_turn_job(_cad_ord(spark, d), _responder, batch_size=BATCH, split="cad")
    path, base = scratch_dir(spark, "published"), scratch_dir(spark, "logs")
    done = jobs.publish_multi_turn(job, path, base, "tables/cad", "orders")
    ids, _ = logs.read_failed_log(spark, done["log"], missing_ok=True)
    rows = splits.read_split(spark, path)
    return rows.join(ids.withColumn("logged", F.lit(True)), rows["id"].cast("string") == ids["id"], "left").select(
        rows["id"], "split", "new_length", F.coalesce("logged", F.lit(False)).alias("logged"), "list_pos")


def publish_retry(spark, d):
    """Retry from the written log, publish and log again, read the rows and the retry log back."""
    data = _cad_ord(spark, d)
    folder = _write_failed_log(spark, d, data=data)
    ids, _ = logs.read_failed_log(spark, folder, missing_ok=True)
    job = jobs.retry_job(data, ids.select(F.col("id").cast("bigint").alias("id")), _responder, BATCH)
    path, base = scratch_dir(spark, "published"), scratch_dir(spark, "logs")
    done = jobs.publish_retry(job, path, base, folder, "tables/cad", "orders")
    again, summary = logs.read_retry_log(spark, done["log"])
    rows = splits.read_split(spark, path)
    name = F.regexp_replace("split", "_[0-9]{8}_[0-9]{6}", "")       # without the log's time
    return rows.join(again.withColumn("again", F.lit(True)), rows["id"].cast("string") == again["id"], "left").select(
        rows["id"], name.alias("split"), F.coalesce("again", F.lit(False)).alias("failed_again"),
        F.lit(summary["retry_failed_count"]).cast("bigint").alias("n_failed_again"))


def consistent_split(spark, d):
    """Rows whose documents all have three parts: the published name says so."""
    three = fx.with_completion(fx.cad_items(spark, d)).where("n = 3")
    job = jobs.multi_turn_job(position.with_ord(three, "id"), _responder, batch_size=BATCH, expected_parts=3, split="cad")
    path, base = scratch_dir(spark, "published"), scratch_dir(spark, "logs")
    jobs.publish_multi_turn(job, path, base, "tables/cad", "orders")
    return splits.split_sizes(splits.read_split(spark, path))


def default_ids(spark, d):
    """Rows without an id column are named by position, in the run and in the retry."""
    data = _cad_ord(spark, d)
    items = data.select("ord", F.col("id").alias("order_id"), "items", "completion")

    def responder(batched, _requests):
        return fx.stand_in_model(batched.withColumn("id", F.col("order_id")))

    job = jobs.multi_turn_job(items, responder, batch_size=BATCH, split="cad")
    again = jobs.retry_job(items, job["failed_ids"], responder, BATCH)
    return again["judged"].select("id", "order_id", "is_failed")


def model_calls(spark, d):
    """A Python model behind ``model_hook``: each request's answer is stored once (D3)."""
    hook = jobs.model_hook(lambda request: f"<sample_1><json_1>{len(request)}</json_1><prompt_1>p</prompt_1>"
                                           "<think_1>t</think_1></sample_1>")
    job = jobs.multi_turn_job(_cad_ord(spark, d), lambda b, reqs: hook(reqs), batch_size=BATCH, split="cad")
    return job["judged"].select("id", "pos", "generated", "is_failed")


def path_names(spark, d):
    """Base names and last segments of paths, log names and timestamps."""
    docs = fx.table(spark, d, "documents")
    path = F.concat(F.lit("logs/"), "lang", F.lit("/v1."), F.col("doc_id").cast("string"), F.lit("/"), "source", F.lit(".en.json"))
    at = F.timestamp_seconds(F.col("doc_id") * 3601)
    return docs.select("doc_id", tx.basename_no_ext(path).alias("name"), tx.last_segment(path).alias("file"),
                       F.concat(F.lit(logs.failed_log_name("tables/cad", "orders", 0, "")),
                                F.date_format(at, names.TS_FORMAT)).alias("log"))


def publish_buckets(spark, d):
    path = scratch_dir(spark, "published")
    jobs.publish_buckets(jobs.clean_and_bucket(_stage1_ord(spark, d)), path)
    return splits.split_sizes(splits.read_split(spark, path))


def _tagged_ord(spark, d):
    return position.with_ord(fx.tagged(spark, d), "doc_id")


def accept_reject(spark, d):
    t = fx.tagged(spark, d)
    return rs.accept(t, "answer").select("doc_id", "accepted", "description", "reasoning")


def reasoning_job(spark, d):
    t = _tagged_ord(spark, d)
    bucket = t.select("ord", "doc_id")
    responses = t.select("ord", F.col("answer").alias("response"))
    judged, name = jobs.reasoning_job(bucket, responses, "range_0_500_en", 100, 100000)
    return judged.select("ord", "doc_id", "accepted", F.lit(name).alias("split"))


def _reasoned(spark, d):
    """The reasoning job over all stage-1 rows; the stand-in answers a row with its tagged text."""
    bucket = position.with_ord(fx.stage1(spark, d), "doc_id")
    answers = fx.tagged(spark, d)

    def responder(rows, requests):
        return requests.join(rows.select("ord", "doc_id"), "ord").join(answers, "doc_id").select(
            "ord", F.col("answer").alias("response"))

    return jobs.run_reasoning(bucket, responder, "stage1", 10, None)


def reasoning_counts(spark, d):
    """Accepted and rejected rows."""
    return _reasoned(spark, d)["counts"]


def publish_reasoning(spark, d):
    """Published accepted rows per split, and the rejected positions read back."""
    job = _reasoned(spark, d)
    path = scratch_dir(spark, "published")
    done = jobs.publish_reasoning(job, path, scratch_dir(spark, "logs"))
    kept = splits.split_sizes(splits.read_split(spark, path))
    bad = spark.read.parquet(done["invalid"]).agg(F.count(F.lit(1)).cast("bigint").alias("n_invalid"),
                                                  F.sum("invalid_index").cast("bigint").alias("sum_invalid"))
    return kept.join(bad)


def publish_predictions(spark, d):
    """Requests, answers, predictions and their published split."""
    docs, resp = _pred_inputs(spark, d)
    docs = position.with_ord(docs, "doc_id")
    job = jobs.run_predictions(docs, lambda rows, reqs: reqs.join(resp, "uid"), "test", 50, None)
    path = scratch_dir(spark, "published")
    jobs.publish_predictions(job, path)
    return splits.read_split(spark, path).select("uid", "split", "reasoning", "predicted_output", "ground_truth_output")


def _pred_inputs(spark, d):
    docs = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), F.col("text").alias("input"),
        F.col("lang").alias("output"), "doc_id")
    resp = fx.tagged(spark, d).select(F.col("doc_id").cast("string").alias("uid"),
                                      F.col("answer").alias("response"))
    return docs, resp


def predictions(spark, d):
    docs, resp = _pred_inputs(spark, d)
    return jobs.predictions(docs, resp)


def predictions_range(spark, d):
    docs, resp = _pred_inputs(spark, d)
    docs = position.with_ord(docs, "doc_id")
    out, name = jobs.predictions_range(docs, resp, "test", 50, None)
    return out.withColumn("split", F.lit(name))


def token_counter_udf(spark, d):
    counter = tokens.make_token_counter(lambda s: len(s.split()))
    return fx.table(spark, d, "documents").select("doc_id", counter(F.col("text")).alias("n_tokens"))


def progressive_docs(spark, d):
    return cad.progressive_docs(fx.cad(spark, d))


def progressive_check(spark, d):
    j, _ = _judged(spark, d)
    return cad.progressive_check(j)


def loop_closure(spark, d):
    return cad.loop_closure(fx.sketches(spark, d))


def operation_check(spark, d):
    c = fx.cad(spark, d).withColumn("completion", F.when(
        F.col("id") % 19 == 0, F.replace("completion", F.lit('"CutFeatureOperation"'), F.lit('"Cut"'))
    ).otherwise(F.col("completion")))
    return cad.operation_check(c)


def number_coverage(spark, d):
    a = F.col("answer")
    t = fx.tagged(spark, d).select("doc_id", tx.first_tag_or_null(a, "json").alias("j"),
                                   tx.first_tag_or_null(a, "description").alias("t"))
    out = cad.number_coverage(t, "j", "t", keep=("doc_id",))
    return out.select("doc_id", F.coalesce("n_json_numbers", F.lit(0)).alias("n_json_numbers"),
                      F.coalesce("n_covered", F.lit(0)).alias("n_covered"))


# A sentence (text between ".", newline or the start) that names a copyright or
# licence is removed.  Matches may only start at a sentence start (lookbehind),
# which gives the same matches as the unanchored form without its quadratic
# backtracking on long sentences.
BOILERPLATE = [r"(?i)(?<=^|[.\n])[^.\n]*?(?:copyright|licen[cs]e)[^.\n]*\.?"]


def drop_boilerplate(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars_before"),
                       F.length(tx.strip_boilerplate(F.col("text"), BOILERPLATE)).cast("bigint")
                       .alias("n_chars_after"))


def route_by_parts(spark, d):
    c = position.deinterleave(position.with_ord(fx.cad_damaged(spark, d), "id"))
    return splits.split_sizes(cad.route_by_parts(c))


def union_shards(spark, d):
    docs = position.with_ord(fx.table(spark, d, "documents").select("doc_id"), "doc_id")
    start = F.col("ord") - F.pmod(F.col("ord"), F.lit(300))
    shards = docs.withColumn("split", F.format_string("docs_%d_%d", start, start + 300))
    path = scratch_dir(spark, "shards")
    splits.write_splits(shards.select("doc_id", "split"), path)
    back = splits.read_splits_like(spark, path, "docs_")
    s, e = splits.parse_range_split(F.col("split"), "docs")
    return back.select("doc_id", s.alias("shard_start"), e.alias("shard_end"))


def merge_retry(spark, d):
    data = _cad_ord(spark, d)
    j = _verdict_summary(spark, d, data)
    r = _retry(spark, d, j, data)["judged"]
    m = retry.merge_retry(j.select("id", "generated", "is_failed"),
                          r.select("id", "generated", "is_failed"))
    return m.select("id", "source", "generated", "is_failed")


def unwiden(spark, d):
    j, n = _judged(spark, d)
    return rs.unwiden(rs.widen(j, n), n)


def length_audit(spark, d):
    p = fx.pairs(spark, d).withColumn("prompt", F.concat_ws("\n", "system", "prompt"))
    p = p.withColumn("completion", F.coalesce("completion", F.lit("")))
    return survey.length_audit_summary(survey.length_audit(p, limit=200))


def canonical_values(spark, d):
    """Do two texts hold the same JSON value (R2)?"""
    p = fx.json_pairs(spark, d)
    return p.select("doc_id", canonical.same_value("a", "b").alias("same"),
                    F.coalesce(canonical.json_digest("a") == canonical.json_digest("b"), F.lit(False)).alias("same_digest"))


def _chat(spark, d):
    """Messages of every pair, without those that have no text."""
    p = fx.pairs(spark, d)
    every = chat.messages(("system", F.col("system")), ("user", F.col("prompt")), ("assistant", F.col("completion")))
    return p.withColumn("messages", F.filter(every, lambda m: m["content"].isNotNull()))


def chat_templates(spark, d):
    """Every pair rendered by two template styles."""
    c = _chat(spark, d)
    return c.select("conv_id", "turn", chat.render("messages", chat.CHATML_TEMPLATE, True).alias("chatml"),
                    chat.render("messages", chat.INST_TEMPLATE, bos_token="<s>", eos_token="</s>").alias("inst"))


def label_spans(spark, d):
    """The characters and tokens of every pair that training learns from (R12, C9); the spans of a
    pair give back its completion."""
    c = labels.with_label_spans(_chat(spark, d), template.compiled(chat.CHATML_TEMPLATE))
    rows = labels.span_rows(c, keep=("conv_id", "turn", "completion"))
    return rows.select("conv_id", "turn", "span", "begin", "end", "first_token", "n_tokens",
                       (F.col("learnt") == F.col("completion")).alias("is_completion"))


def resumed_calls(spark, d):
    """Requests through a response ledger (D3): half of the batches, then all, then all again.  Each
    request is sent once, whatever was sent before."""
    reqs = stored(rq.batch_requests(fx.batched_cad(spark, d, BATCH)), "requests")
    path = scratch_dir(spark, "ledger")
    call = lambda request: f"{len(request)} characters"
    sent = [ledger.send_new(part, call, path, model="stand-in", every=64) for part in (reqs.where("batch_id % 2 = 0"), reqs, reqs)]
    found = ledger.answers(reqs, path, model="stand-in")
    return found.select("batch_id", "response", *[F.lit(n).cast("bigint").alias(f"n_sent_{i}") for i, n in enumerate(sent, 1)])


def stored_positions(spark, d):
    """Documents numbered where they lie (W1): even ids first, odd and null ids appended behind them."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    table, path = scratch_dir(spark, "documents"), scratch_dir(spark, "positions")
    for part in (0, 1):
        docs.where(F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(1)) == part).write.mode("append").parquet(table)
        positions.append(spark, table, path, "doc_id")
    return positions.read(spark, table, path).select("ord", "doc_id", F.length("text").cast("bigint").alias("n_chars"))


def snapshot_splits(spark, d):
    """Rows per language in every published version (S3, S4): all documents, English ones again without
    short texts, then German ones alone; read after the last publication."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("split"))
    path = scratch_dir(spark, "snapshots")
    snapshots.publish(docs, path)
    snapshots.publish(docs.where("split = 'en' AND length(text) >= 500"), path)
    snapshots.publish(docs.where("split = 'de'"), path, replace_all=True)
    out = None
    for v in snapshots.versions(spark, path):
        sizes = splits.split_sizes(snapshots.read(spark, path, version=v)).withColumn("version", F.lit(v))
        out = sizes if out is None else out.unionByName(sizes)
    return out


def shard_coverage(spark, d):
    """Ranges of ten positions per document, some too long and some too short: where they overlap and
    where they leave gaps (R8)."""
    docs = fx.table(spark, d, "documents")
    start = F.col("doc_id") * 10
    end = start + 10 + F.when(F.col("doc_id") % 7 == 0, 5).otherwise(0) - F.when(F.col("doc_id") % 11 == 0, 4).otherwise(0)
    total = (docs.agg(F.max("doc_id")).first()[0] or 0) * 10 + 10
    return coverage.range_coverage(docs.select(start.alias("start"), end.alias("end")), total)


def unbatch_colocated(spark, d):
    """Requests and responses stored by batch, so that un-batching shuffles nothing."""
    path = scratch_dir(spark, "requests")
    b = batches.publish(fx.batched_cad(spark, d, BATCH), path)
    answers = batches.publish_like(fx.stand_in_model(b), path, scratch_dir(spark, "responses"))
    return rs.unbatch_colocated(b, answers, BATCH).select("id", "batch_id", "pos", "new_length")


def _surveyed(spark, d):
    """State of documents that came in two parts: the second update reads the second part only."""
    rows = stored(fx.cad_damaged(spark, d), "damaged")
    table, path = scratch_dir(spark, "documents"), scratch_dir(spark, "survey")
    for part in (0, 1):
        rows.where(F.pmod("id", F.lit(2)) == part).write.mode("append").parquet(table)
        survey_state.update(spark, table, path, tokens.approx_token_count(F.col("completion")))
    return survey_state.current(spark, table, path)


def merged_survey(spark, d):
    """The survey, merged from the state of every file (A1, A3), with token extremes."""
    state = _surveyed(spark, d)
    return survey_state.survey(state, expected_parts=3).join(survey_state.token_minmax(state).drop("label"))


def merged_histogram(spark, d):
    """The part-count histogram, merged from the state of every file (A2)."""
    return survey_state.histogram(_surveyed(spark, d))


REGISTRY = {name: fn for name, fn in list(globals().items())
            if callable(fn) and not name.startswith("_") and fn.__module__ == __name__
            and name not in ("REGISTRY",)}
