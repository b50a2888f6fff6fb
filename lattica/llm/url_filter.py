"""URL rules by host suffix and path prefix.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the
rule's; the longest fitting rule wins. Each distinct URL is expanded into all pairs of
a host suffix and a path prefix (of the lengths that rules have), expressions
and rules meet in an equi-join on a short prefix of their digests, and a hit
counts only if the full digests agree.

Defined results: a null URL or one without ``://`` has empty host and path and
fits no rule; of rules with the same host and path a block stands before an
allow; a rule without a host or path is left out; repeated rows are judged alike; an
empty table gives no rows, and without rules ``default`` stands everywhere; URLs of any
length are read whole; other columns are kept out, whatever they are called.

Pages without a URL are spread over many keys in the last join; a URL that many pages
repeat is judged once, and the join's task that meets its pages is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number (of 100 bytes or so each) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url) and rules (host, path, verdict) to page_id, host, path, rule, verdict; ``default`` where no rule fits."""
    rules = rules.select("host", "path", "verdict").filter("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("block"))
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("n")).scalar()  # no more than the longest path has characters
    count = rules.limit(BROADCAST_RULES + 1).count()
    digest = _digest(F.col("host"), F.col("path"))
    known = rules.select(_short(digest).alias("short"), digest.alias("full"), F.concat("host", "path").alias("rule"), F.when(F.col("block") == 1, "block").otherwise("allow").alias("verdict"))
    if count <= BROADCAST_RULES:
        known = F.broadcast(known)

    url = F.col("url")
    urls = pages.select("url").filter(url.isNotNull()).distinct().select("url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("lengths", lengths)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    asked = urls.filter(F.col("host") != "").select("url", F.explode(F.array_distinct(digests)).alias("digest")).select("url", "digest", _short(F.col("digest")).alias("short"))
    hits = asked.join(known, "short").filter(F.col("digest") == F.col("full"))
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    # null matches nothing, so it may have any key
    key = F.coalesce(url, F.concat(F.lit("?"), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string")))
    out = pages.select("page_id", "url", key.alias("key")).join(best.withColumnRenamed("url", "key"), "key", "left")
    return out.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
