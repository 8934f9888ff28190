"""URL filters by host-suffix and path-prefix expressions.

Every URL is cut into host and path.  Its host expressions are all suffixes of the host at label
borders; its path expressions are the prefixes of its path at the lengths that the rules of a
matching host have.  Expressions are compared by hash: an equi-join on the first 32 bits of the
digest, then equality of the whole SHA-256 digest.  All JVM-side; the rules may be any number
(they are joined, not collected), a hot host is split by the skew join.

Precedence: the longest rule (host and path together) wins, then the longer host, then ``block``.

Null url, or one without ``://``: host and path are empty and no rule fits.  Repeated pages keep
their rows; a null ``page_id`` is kept.  Rules with a null host or path are ignored, repeated rules
count once.  Empty tables give empty results (no pages) or the default verdict (no rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.instr(url, F.lit("://")) > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return (F.when(F.instr(url, F.lit("://")) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
            .otherwise(F.lit("")))


def host_suffixes(host: Column) -> Column:
    """All suffixes of a host at label borders, itself included; none of an empty host."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    all_of = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.array_distinct(F.filter(all_of, lambda s: s != ""))


def _hashed(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the digest of ``text`` and its first 32 bits (the join key)."""
    return (df.withColumn(f"{name}_digest", F.sha2(text, 256))
            .withColumn(f"{name}_short", F.conv(F.substring(F.col(f"{name}_digest"), 1, 8), 16, 10).cast("bigint")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    ``rules``: ``host, path, verdict`` (``allow`` or ``block``); a rule fits its host and all
    subdomains if the URL's path starts with the rule's path."""
    r = (rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"),
                      F.col("verdict").alias("r_verdict"))
         .where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull()).distinct())
    hosts = _hashed(r.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")),
                    F.col("r_host"), "h").select("h_short", F.col("h_digest").alias("rh_digest"), "lengths")
    exprs = _hashed(r, F.concat("r_host", F.lit("\n"), "r_path"), "e").select(
        "e_short", F.col("e_digest").alias("re_digest"), "r_host", "r_path", "r_verdict")

    cut = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = cut.select("host", "path").where(F.col("host") != "").distinct()
    suffixes = _hashed(urls.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix")),
                       F.col("suffix"), "h")
    known = (suffixes.join(hosts, "h_short").where(F.col("h_digest") == F.col("rh_digest"))
             .select("host", "path", "suffix", "lengths"))
    prefixes = known.select("host", "path", "suffix", F.explode(F.filter(
        "lengths", lambda n: n <= F.length("path"))).alias("n")).select(
        "host", "path", F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, n)")).alias("expr"))
    fits = (_hashed(prefixes, F.col("expr"), "e").join(exprs, "e_short")
            .where(F.col("e_digest") == F.col("re_digest")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
        (F.col("r_verdict") == "block").alias("b"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    return (cut.join(best, ["host", "path"], "left")
            .select(id_col, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))
