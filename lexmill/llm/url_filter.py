"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed URL; a block is one 64-bit word, in which a URL sets four bits.
BITS_PER_URL = 16
#: Filters up to this many blocks (16 MB) are broadcast; larger ones are joined by block.
BROADCAST_BLOCKS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _or(hash_: Column) -> Column:
    """The four bits of a hash within its block."""
    out = None
    for shift in (20, 28, 36, 44):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hash_, shift).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (any columns of those names are replaced).

    rules(host, path, verdict): a rule fits its host and all subdomains when the URL's path
    starts with its path; the longest (host and path together, then host) wins, of
    equal rules with different verdicts `block`.  rule is host and path of the winner, null if
    none fits; then verdict is default.  Null or malformed URLs have empty host and path.

    Each distinct (host, path) names the listed URLs that could fit it: every suffix
    of its host with every prefix of its path that is as long as some listed
    path.  Those that the filter lets pass meet the list in a hash join on the URL
    itself.  The only values brought to the driver are the listed path lengths
    and the number of rules.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where(
        "rule_host is not null and rule_path is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max(F.col("verdict") == "block").alias("b"), F.max("verdict").alias("v")).select(
        "rule_host", "rule_path", F.when(F.col("b"), "block").otherwise(F.col("v")).alias("rule_verdict"))
    n, lengths = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    if not n:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    blocks = -(-n * BITS_PER_URL // 64)
    url_hash = F.xxhash64("rule_host", F.lit("\n"), "rule_path")
    block = F.pmod(F.col("hash"), F.lit(blocks))
    words = rules.select(url_hash.alias("hash")).select(block.alias("block"), _or(F.col("hash")).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)

    urls = pages.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    could = (urls.withColumn("rule_host", F.explode(hosts))
             .withColumn("size", F.explode(F.filter(F.lit(lengths), lambda x: x <= F.length("path"))))
             .withColumn("rule_path", F.expr("substring(path, 1, size)"))
             .withColumn("hash", url_hash).withColumn("block", block))
    passed = could.join(words, "block").where(F.col("word").bitwiseAND(_or(F.col("hash"))) == _or(F.col("hash")))
    size = F.length("rule_host") + F.length("rule_path")
    hit = (passed.join(rules, ["rule_host", "rule_path"])
           .groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("own"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("m"))
           .select("host", "path", "m.rule", F.col("m.rule_verdict").alias("verdict")))
    out = pages.join(hit, ["host", "path"], "left")
    return out.select(*[c for c in pages.columns if c not in ("host", "path")], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
