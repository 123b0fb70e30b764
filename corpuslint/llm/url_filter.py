"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, full digest, precedence.

A rule is (host, path, action): it fits its host and all subdomains where the URL's path starts with the rule's. A URL
is expanded into every suffix of its host at a dot, times every prefix of its path that is as long as some rule's path.
The first ``PREFIX`` hex digits of an expression's SHA-256 are joined with the rules'; the full digest confirms a hit.
The longest rule (host and path together) wins, then the longer host, then ``block`` before ``allow``.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule; rules with null parts are left out and
repeated rules count once. Equal URLs are judged once, so a URL that holds a third of all pages is one row of the join;
every page keeps its row, repeated or with a null id. Other columns are not read; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

PREFIX = 8


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lowered) and path to ``pages`` (url)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": lower_ascii(host), "path": path})


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (host and path, or null) and verdict."""
    known = (
        rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "action")
        .dropna().groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("start", F.left("digest", F.lit(PREFIX)))
    )
    # The lengths of rule paths are as few as the longest of them is long.
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect())
    split = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path")
    urls = split.select("host", "path").filter("host <> ''").distinct()
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    parts = urls.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix")).select(
        "host", "path", "suffix", F.explode(prefixes).alias("n")
    )
    tried = parts.withColumn("full", _digest(F.col("suffix"), F.substring("path", F.lit(1), F.col("n")))).withColumn(
        "start", F.left("full", F.lit(PREFIX))
    )
    hits = tried.join(known, "start").filter("full = digest")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "action", "rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select(
        "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.action").alias("action")
    )
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(otherwise)).alias("verdict")
    )
