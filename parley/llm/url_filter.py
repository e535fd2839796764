"""URL filters: path rules by longest match, and for all other hosts a cascade of Bloom filters.

The cascade knows all keys of the corpus: level 1 holds the listed keys, level 2 the unlisted ones that level 1 takes
for listed, level 3 the listed ones that level 2 takes for unlisted, and so on until a level makes no mistake. The
first level that doesn't know a key then tells exactly whether it is listed. Pages probe bit arrays; they are never
joined with the list. Arrays are cut into shards by the key's hash, so that none outgrows a row, and each shard is
copied for ``COPIES`` groups of pages, so that a host of a third of all pages is probed in many tasks.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.support import ascii_lower, staged

#: (verdict, host and path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bits per key and hashes per key of a level; keys of a shard on average; copies of each shard.
BITS_PER_KEY, HASHES, SHARD_KEYS, COPIES = 12, 6, 50_000, 16


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as a struct (verdict, rule), else null. Of rules of one length the first counts."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits))


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """``keys(shard, key)`` to one row per shard: ``shard, words array<long>``, ``bits`` bits in words of 64."""
    spots = keys.select("shard", F.explode(F.array(*(_position(F.col("key"), level, i, bits) for i in range(HASHES)))).alias("p"))
    words = spots.groupBy("shard", F.expr("cast(p div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x"))
    of = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    return of.select("shard", F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def _knows(words: Column, key: Column, level: int, bits: int) -> Column:
    """Whether all of a key's bits are set; a shard without an array at this level knows nothing."""
    out = words.isNotNull()
    for i in range(HASHES):
        p = _position(key, level, i, bits)
        out = out & (F.get(words, (p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
    return out


class Cascade:
    """``levels`` (one row per shard with an array per level), and what is needed to probe them."""

    def __init__(self, table: DataFrame, bits: list[int], shards: int) -> None:
        self.table, self.bits, self.shards = table, bits, shards

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards)).cast("int")

    def listed(self, key: Column) -> Column:
        """For rows joined with the table: whether the key, one of the corpus, is listed."""
        out = F.lit(len(self.bits) % 2 == 1)
        for level in range(len(self.bits), 0, -1):
            out = F.when(_knows(F.col(f"level{level}"), key, level, self.bits[level - 1]), out).otherwise(F.lit(level % 2 == 0))
        return out


def build_cascade(keys: DataFrame) -> Cascade:
    """From ``keys(key, listed)``, the distinct keys of the corpus, each with its mark."""
    n = keys.count()
    shards = 1 + n // SHARD_KEYS
    cascade = Cascade(keys.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")), [], shards)
    known = staged(keys.select(cascade.shard(F.col("key")).alias("shard"), "key", "listed"))
    inside, outside = known.where("listed"), known.where("not listed")
    while True:
        fullest = inside.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        if not fullest:
            return cascade
        level, bits = len(cascade.bits) + 1, 64 * (1 + fullest * BITS_PER_KEY // 64)
        array = staged(_level(inside, level, bits).withColumnRenamed("words", f"level{level}"))
        cascade.bits.append(bits)
        cascade.table = staged(cascade.table.join(array, "shard", "left"))
        mistaken = outside.join(array, "shard").where(_knows(F.col(f"level{level}"), F.col("key"), level, bits)).drop(f"level{level}")
        inside, outside = staged(mistaken), inside


def filter_urls(pages: DataFrame, listed_hosts: DataFrame | None = None, rules: tuple = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``.

    ``listed_hosts`` is the block list, a table with a column ``host`` (A-Z lower-cased here; repeats and nulls don't matter; none is
    an empty list); it meets the distinct hosts of the pages once, and pages only probe the cascade. Without a fitting
    rule the cascade decides: listed hosts are blocked, others allowed. A null url and one without ``://`` have an empty host
    and path and are allowed, unless the list holds the empty host. Repeated pages are judged each; ids may be null; very long urls are
    judged whole; other columns are not read. A table without rows gives none.
    """
    address = F.col(url).cast("string")
    judged = pages.select(F.col(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    judged = judged.withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    keys = judged.select(F.col("host").alias("key")).distinct()
    if listed_hosts is None:
        keys = keys.withColumn("listed", F.lit(False))
    else:
        marks = listed_hosts.where("host is not null").select(ascii_lower(F.col("host")).alias("key"), F.lit(True).alias("listed")).distinct()
        keys = keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascade = build_cascade(staged(keys))
    copies = cascade.table.withColumn("copy", F.explode(F.expr(f"sequence(0, {COPIES - 1})")))
    probing = judged.select("*", cascade.shard(F.col("host")).alias("shard"), F.pmod(F.xxhash64("page_id", "path"), F.lit(COPIES)).cast("int").alias("copy"))
    probed = probing.join(copies, ["shard", "copy"], "left").withColumn("listed", cascade.listed(F.col("host")))
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return probed.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
