"""A training corpus in five stages, each one operator of ``tessera.llm`` over all that the stage
before it kept: toxicity, near duplicates, repeated substrings, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of ``documents``
(``doc_id, text, lang, source, n_chars``); the last returns the packing plan.  Rows keep their
``doc_id``; a document that the mix takes more than once has a row for each copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dup, packing, substring, toxicity
from tessera.llm.common import table
from tessera.llm.queries import tokenizer_path, toxicity_model
from tessera.session import scratch_dir, scratch_space

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stored_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()``, written once and read back; the tables that it wrote on the way are dropped."""
    path = scratch_dir(spark, name)
    with scratch_space(spark):
        out = make()
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 stay, those without text among them; repeated rows
    share their fate.  An empty table gives an empty one."""
    docs = docs.select(*COLUMNS)
    model = toxicity_model(spark, sf_dir, docs)
    rest = [c for c in COLUMNS if c != "doc_id"]
    scored = toxicity.score(docs, model, keep=rest)
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates stays: five-word shingles at
    similarity 0.8."""
    docs = docs.select(*COLUMNS)
    kept = stored_alone(spark, "pipeline-kept", lambda: near_dup.near_duplicates(docs, k=5, percent=80).where("kept").select(
        F.col("doc_id").alias("kept_id")).distinct())
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that also start in a smaller document go; a document with no word
    left goes, all others stay (unchanged, if nothing in them repeats).  Cuts are joined by id and
    text, as ids may be null or repeat."""
    docs = docs.select(*COLUMNS, F.md5(F.col("text").cast("binary")).alias("md5"))
    cut = stored_alone(spark, "pipeline-cut", lambda: substring.drop_repeated_windows(docs, span=50, keep_texts=True)
                       .where("n_removed > 0").select(
        F.col("doc_id").alias("cut_id"), F.col("md5").alias("cut_md5"), "n_words", "n_removed", "kept")
        .dropDuplicates(["cut_id", "cut_md5"]))
    out = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("md5") == F.col("cut_md5")), "left")
    text = F.coalesce("kept", "text")
    return (out.where(F.col("n_removed").isNull() | (F.col("n_removed") < F.col("n_words")))
            .select("doc_id", text.alias("text"), "lang", "source",
                    F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn: a row for each copy that the mix takes.  A null source is the
    last one; null text has no words and is never taken; repeated rows are taken on their own.  An
    empty table gives an empty one."""
    docs = docs.select(*COLUMNS)
    mixed = stored_alone(spark, "pipeline-mixed", lambda: mixing.mix(docs).where("copies > 0").select(
        "copies", "key1", "key2", "placements"))
    return mixing.mixed_documents(docs, mixed).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: where each piece of each document goes.  Null text is a separator
    alone; repeated rows are packed each.  An empty table gives an empty plan."""
    return packing.pack(docs, tokenizer_path(), seq_len=2048)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("repeated_passages", drop_repeated_passages), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Toxicity, MinHash and token ids can't be expressed in SQL; the tests hold each stage against a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and what it stored
    on the way is dropped."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(spark, f"pipeline-{name}", lambda: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
