"""The queries ``opN_<name>`` and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import ann, conversation_sql, mixing, near_dup, packing, pieces, repair, sharding, substring, suffix, topk, toxicity, trie, url_filter
from tessera.llm.common import table

#: The URL rules of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules, default="allow")


def op3_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "placements")


def op5_sharding(spark, sf_dir):
    tree = sharding.even_tree(8)
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), tree, sharding.grow(tree, 8))
    return rows.withColumn("law", F.lit("key"))


def op4_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_substring_dedup(spark, sf_dir):
    return substring.drop_repeated_windows(table(spark, sf_dir, "documents"), span=50)


def op7_minhash_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_suffix_dedup(spark, sf_dir):
    return suffix.drop_repeated_strings(table(spark, sf_dir, "documents"), span=200)


def op9_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def is_held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def toxicity_model(spark, sf_dir, docs):
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("id")))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_sentencepiece(spark, sf_dir):
    import public_tokenizers
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op12_structure_repair(spark, sf_dir):
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def op13_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


REGISTRY = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filters, op3_mixing, op4_exact_top_k, op5_sharding, op6_substring_dedup, op7_minhash_near_dup, op8_suffix_dedup, op9_ann, op10_toxicity, op11_sentencepiece,
                                     op12_structure_repair, op13_prefix_trie)}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_url_filters": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS row_no, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (
  SELECT row_no, r_host || r_path AS rule, r_verdict, row_number() OVER (
    PARTITION BY row_no ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, r_verdict DESC) AS n
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (row_no)""",
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.own <> b.own AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS x
  FROM w, unnest(range(1, len(words) - 48)) AS t(i) WHERE len(words) >= 50),
first AS (SELECT x, min(doc_id) AS owner FROM windows GROUP BY x),
lost AS (SELECT DISTINCT doc_id, i FROM windows JOIN first USING (x) WHERE doc_id > owner),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM lost, unnest(range(0, 50)) AS t(k)),
flat AS (SELECT doc_id, p, words[p] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_minhash_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
  FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * m >= 80 * (na.n + nb.n - m)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT doc_id, b FROM reach JOIN links ON a = other)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
       w.doc_id = min(other) AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id""",
} | conversation_sql.ORACLES
