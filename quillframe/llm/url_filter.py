"""URL filters: prefix rules first, then a listed-URL test by a blocked Bloom filter and an exact join.

The Bloom filter has blocks of 512 bits, eight words of 64; a key picks one block and sets one bit
in each word. Filter rows (block, eight words) are bounded by `max_blocks`, whatever the list's
length, so that they may always be broadcast: a longer list raises the share of false positives,
which the exact hash join removes. Only possible hits reach that join. At 12 bits a key and 2^20 blocks the filter is
full at about 45 million keys; beyond, more and more rows reach the join, until at some 400 million nearly all do.

Nulls, empty and odd urls: null or a url without "://" has empty host and path, no canonical form
and so no rule and no listing: it is allowed. Repeated rows each get their verdict. Extra columns
of the input are kept; those named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

WORDS = 8
#: (verdict, host, path) of the standing rules of the op2 query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading www. or m., path without a trailing slash or .html; null where there is no host.

    Scheme, query and fragment do not count.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    return F.when(host_of(url) != "", F.concat(host, path))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are a parameter of at most MAX_RULES."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    other = F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, bits_per_key: int = 12, max_blocks: int = 1 << 20) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the blocks that have a bit, and the number of blocks; at most 72 bytes x max_blocks."""
    n = keys.count()
    blocks = min(max_blocks, 1 << max(0, math.ceil(math.log2(max(1, n * bits_per_key / (64 * WORDS))))))
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    listed_verdict: str = "block",
    other_verdict: str = "allow",
    bits_per_key: int = 12,
    max_blocks: int = 1 << 20,
) -> DataFrame:
    """Judge every row of `pages`: adds host, path, canonical_url, rule and verdict.

    listed: a table with a column canonical_url; repeats and nulls in it do not matter. A rule's verdict
    goes before the list's.
    """
    keys = listed.select(F.col("canonical_url").alias("__listed")).where("__listed is not null").distinct()
    bloom, blocks = bloom_filter(keys, "__listed", bits_per_key, max_blocks)
    out = ("host", "path", "canonical_url", "rule", "verdict")
    rest = [c for c in pages.columns if c not in out or c == url]
    judged = pages.select(
        *(F.col(f"`{c}`") for c in rest),
        host_of(F.col(url)).alias("__host"),
        path_of(F.col(url)).alias("__path"),
        canonical(F.col(url)).alias("__key"),
    ).withColumn("__rule", matching_rule(F.col("__host"), F.col("__path"), rules))
    # A block that is not in the filter has no bit set; without a key there is nothing to look up.
    probed = judged.withColumn("__block", F.when(F.col("__rule").isNull() & F.col("__key").isNotNull(), _block(F.col("__key"), blocks)))
    probed = probed.join(F.broadcast(bloom.withColumnRenamed("block", "__block")), "__block", "left")
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("__key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    probed = probed.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    keep = [*rest, "__host", "__path", "__key", "__rule"]
    missed = probed.where("not __hit").select(*(F.col(f"`{c}`") for c in keep), F.lit(False).alias("__found"))
    hits = probed.where("__hit").select(*(F.col(f"`{c}`") for c in keep))
    # A hot url may be a third of all hits: in this outer join Spark can split its partition.
    found = hits.join(keys.hint("shuffle_hash"), hits["__key"] == keys["__listed"], "left").select(*(F.col(f"`{c}`") for c in keep), F.col("__listed").isNotNull().alias("__found"))
    return missed.unionByName(found).select(
        *(F.col(f"`{c}`") for c in rest if c not in out or c == url and url not in out),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__key").alias("canonical_url"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("__found"), F.lit(listed_verdict)).otherwise(F.lit(other_verdict))).alias("verdict"),
    )


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list of the op2 query: canonical urls that more than one row of `pages` has, as crawl traps and mirrors do."""
    keys = pages.select(canonical(F.col(url)).alias("canonical_url")).where("canonical_url is not null")
    return keys.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical_url")
