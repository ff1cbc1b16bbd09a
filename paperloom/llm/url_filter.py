"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (host, path, action) of the rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Canonical URLs (host, path) that the query blocks where no rule speaks.
LISTED = [("ads-track.example.org", "/"), ("spam-farm.example.org", "/"), ("cheap-pills.example.com", "/")]

#: Bits of a block, and bits that each key sets in its block.
BLOCK_BITS, PROBES = 64, 4
#: Blocks up to which the filter goes with the tasks as one array (8 bytes a block); a larger one is joined by block.
ARRAY_BLOCKS = 1 << 20


def rest_of(url: Column) -> Column:
    """What follows the first ://; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """Path up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """`host` without user, port and trailing dots, as hosts are listed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")


def _mask(key: Column) -> Column:
    """The bits of `key` in its block."""
    bit = lambda i: F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 10 + 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
    )
    mask = bit(0)
    for i in range(1, PROBES):
        mask = mask.bitwiseOR(bit(i))
    return mask


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of the string column `key`: the set bits of each block that has any.

    Built by one pre-aggregated bit_or per block; its size follows the list, not the pages.
    """
    h = F.xxhash64("key")
    return keys.select(F.pmod(h, F.lit(blocks)).alias("block"), _mask(h).alias("bits")).groupBy("block").agg(
        F.bit_or("bits").alias("bits")
    )


def possible_hits(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of `asked` (_key, ...) whose key the filter of `listed` (key) does not rule out; no shuffle while it is small."""
    blocks = max(1, listed.count() * 16 // BLOCK_BITS)
    h, bits = F.xxhash64("_key"), bloom(listed, blocks)
    if blocks > ARRAY_BLOCKS:
        kept = asked.withColumn("_block", F.pmod(h, F.lit(blocks))).join(bits.withColumnsRenamed({"block": "_b", "bits": "_bits"}), F.col("_block") == F.col("_b"))
        return kept.where(F.col("_bits").bitwiseAND(_mask(h)) == _mask(h)).select(*asked.columns)
    # All blocks in order, as the one row of a global aggregate.
    every = bits.join(bits.sparkSession.range(blocks).select(F.col("id").alias("_i")), F.col("block") == F.col("_i"), "right")
    whole = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("bits", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("_bits"))
    found = F.get("_bits", F.pmod(h, F.lit(blocks)).cast("int"))
    return asked.join(F.broadcast(whole), found.bitwiseAND(_mask(h)) == _mask(h)).select(*asked.columns)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`pages` plus url_host, url_path, url_rule and url_verdict.

    `rules`: host, path, action (block or allow), listed (true: speaks only where no other rule does). A rule fits its
    host and all subdomains if the URL's path starts with the rule's; the longest host and path wins, then the longer
    host. Listed rules look at the canonical host (no user, port or trailing dot) and take an empty path for /.
    Every URL that no rule fits is allowed. Null or schemeless URLs have empty host and path and are allowed.
    Repeated pages and repeated rules are fine (of equal rules, block wins); an empty table gives an empty result. Only
    the four new names must be free in `pages`.

    Each distinct URL gives one candidate key for each shape (labels of the host, characters of the path) that occurs in
    the list; candidates pass the Bloom filter, then the exact join on the key. The filter goes along as one array while
    its size, which is counted, is small.
    """
    mark = F.when(F.col("listed"), "l").otherwise("r")
    listed = rules.select(
        F.concat_ws("/", mark, "host", "path").alias("key"), "host", "path", "action", "listed",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"),
    )
    # Shapes are pairs of two lengths that URL syntax bounds, so the driver gets few rows however long the list is.
    shapes = [tuple(r) for r in listed.select("listed", "labels", "chars").distinct().collect()]
    urls = pages.select(F.col(url).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    parts = urls.select("_u", host_of(F.col("_u")).alias("_host"), path_of(F.col("_u")).alias("_path"))
    parts = parts.withColumns({"_labels": F.split("_host", r"\."), "_own": F.split(canonical_host(F.col("_host")), r"\."), "_full": F.when(F.col("_path") == "", "/").otherwise(F.col("_path"))})

    def key(known: bool, n: int, m: int) -> Column:
        labels, path = ("_own", "_full") if known else ("_labels", "_path")
        fits = (F.size(labels) >= n) & (F.length(path) >= m) & (F.col("_host") != "")
        return F.when(fits, F.concat_ws("/", F.lit("l" if known else "r"), F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, m)))

    keys = F.array_compact(F.array(*[key(*s) for s in shapes])) if shapes else F.array().cast("array<string>")
    possible = possible_hits(parts.select("_u", F.explode(keys).alias("_key")), listed)
    order = F.struct(~F.col("listed"), F.length("key"), F.length("host"), F.col("action") == "block")
    best = (
        possible.join(listed, F.col("_key") == F.col("key"))
        .groupBy("_u")
        .agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "action", "listed"), order).alias("_best"))
    )
    # Columns of `pages` keep out of the way until the new ones stand.
    names = {c: f"_p{i}" for i, c in enumerate(pages.columns)}
    u = F.col(names[url])
    out = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).join(best, u == F.col("_u"), "left")
    return out.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        host_of(u).alias("url_host"),
        path_of(u).alias("url_path"),
        F.when(~F.col("_best.listed"), F.col("_best.rule")).alias("url_rule"),
        F.coalesce(F.col("_best.action"), F.lit("allow")).alias("url_verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(*r, False) for r in RULES] + [(h, p, "block", True) for h, p in LISTED],
        "host string, path string, action string, listed boolean",
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
    )


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), q AS (
  SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS full_path,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS own FROM p
), rules(h, p, action, listed) AS (
  VALUES ('net', '/', 'block', 0), ('example.net', '/en/', 'allow', 0), ('example.com', '/de/', 'block', 0), ('org', '/fr/', 'allow', 0),
         ('ads-track.example.org', '/', 'block', 1), ('spam-farm.example.org', '/', 'block', 1), ('cheap-pills.example.com', '/', 'block', 1)
), m AS (
  SELECT page_id, host, path, h || rules.p AS rule, action, listed,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY listed NULLS LAST, length(h || rules.p) DESC) AS k
  FROM q LEFT JOIN rules ON CASE WHEN listed = 1 THEN (own = h OR ends_with(own, '.' || h)) AND starts_with(full_path, rules.p)
                                 ELSE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) END
)
SELECT page_id, host, path, CASE WHEN listed = 0 THEN rule END AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
