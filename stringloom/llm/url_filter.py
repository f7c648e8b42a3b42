"""Operator 5: URL rules and a host list through Bloom filter cascades, with DataFrame functions only.

A cascade holds a key set exactly over a stated universe: level 1 is a Bloom filter of the listed keys, level 2 one of the universe's
other keys that level 1 takes in falsely, level 3 one of the listed keys that level 2 takes in falsely, and so on until a level takes
in nothing falsely. The universe is the complete set of distinct keys of the corpus, so the answer is exact for every row, and probing
is arithmetic on constant bit arrays: no join touches the pages.

The keys of a page: for each shape of rule (number of host labels, length of path) the page's own host suffix and path prefix of that
shape. A rule fits exactly when its key is one of them, so a page has as many keys as there are shapes, not rules. Two cascades, over
the same universe, hold the blocking and the allowing keys; the longest listed key of a page decides (of equally long ones, the one with
the longer host). A page that no rule fits is blocked if its host or a parent domain is in the host list (a third cascade), else allowed.

Level 1 lets through at most as many other keys as are listed, and every further level one in 64, so the bits follow the listed keys (and
the logarithm of the universe's share to them), not the corpus. They travel as one constant for each level. If a level would need more
than MAX_BITS, the listed keys are joined to the pages' keys instead (`Members.mark` chooses by itself; the answer is the same).

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is allowed; repeated rows give a row each; a
very long url is judged as a whole; an empty table gives no rows; other columns are kept, whatever their names (host, path, rule and
verdict are replaced).
"""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common

#: (verdict, host, path): the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Domains blocked where no rule fits.
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: False positives of a level after the first, and the most that the first may have; bits of a level that travel as a constant.
#: (in fewer than LEAST_BITS, places by two hashes would repeat too often).
RATE, MAX_BITS, LEAST_BITS = 1 / 64, 1 << 25, 1 << 14


def _lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def shapes(rules) -> list[tuple[int, int]]:
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules}, reverse=True)


def _key(labels: Column, path: Column, n: int, length: int) -> Column:
    """The page's host suffix of n labels and path prefix of that length; null if it has none."""
    return F.when((F.size(labels) >= n) & (F.length(path) >= length), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, length)))


def _bits(key: Column, level: int, m: int, hashes: int) -> list[Column]:
    """Places by two hashes of 31 bits."""
    one, step = (F.shiftrightunsigned(F.xxhash64(F.lit(2 * level + i), key), 33) for i in (0, 1))
    return [F.pmod(one + step * i, F.lit(m)) for i in range(hashes)]


def _filter(keys: DataFrame, level: int, m: int, hashes: int) -> list[int]:
    """The words of a Bloom filter of m bits: bits set by equal words are merged before the shuffle; at most m / 64 words reach the driver."""
    bit = keys.select(F.explode(F.array(*_bits(F.col("key"), level, m, hashes))).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    out = [0] * (-(-m // 64))
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def _in_filter(key: Column, level: int, m: int, hashes: int, words: list[int]) -> Column:
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # one constant, folded when the plan is made
    hit = F.lit(True)
    for bit in _bits(key, level, m, hashes):
        word = F.get(table, F.floor(bit / F.lit(64)).cast("int"))
        hit = hit & (F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1)
    return hit


def _keys(spark: SparkSession, listed) -> DataFrame:
    """Distinct listed keys as a table; listed: strings, or a table with the column key."""
    if isinstance(listed, DataFrame):
        return listed.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    if len(listed) <= 100_000:
        return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(set(listed)))), "array<string>")).alias("key"))
    return spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")


class Members:
    """Exact membership of `listed` within `universe` (a DataFrame with the distinct column `key`): by a cascade, or by join beyond MAX_BITS."""

    def __init__(self, universe: DataFrame, listed):
        self.listed = inside = _keys(universe.sparkSession, listed)
        self.levels: list[tuple[int, int, list[int]]] | None = []
        n = inside.count()
        # keys that no page has need no answer, so only listed keys of the universe and the others of the universe count
        others = universe.join(F.broadcast(inside) if n < 100_000 else inside, "key", "left_anti")
        rate = min(RATE, n / (math.sqrt(2) * max(1, others.count()))) if n else RATE
        level = 0
        while n:
            hashes = max(1, round(math.log2(1 / rate)))
            m = max(LEAST_BITS, math.ceil(n * hashes / math.log(2)))
            if m > MAX_BITS:
                self.levels = None
                return
            words = _filter(inside, level, m, hashes)
            self.levels.append((m, hashes, words))
            false = common.stage(others.where(_in_filter(F.col("key"), level, m, hashes, words)), "cascade")
            others, inside, rate = inside, false, RATE
            n = inside.count()
            level += 1
            if level > 64:
                raise RuntimeError("cascade does not end")

    def holds(self, key: Column) -> Column:
        """True for listed keys, false for the others; null for a null key. By the cascade."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            # leaving at an odd level (from 1) means not listed, at an even one listed
            out = F.when(_in_filter(key, level, *self.levels[level]), out).otherwise(F.lit(level % 2 == 1))
        return F.when(key.isNotNull(), out)

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with the boolean column `name`: whether its column `key` is listed."""
        if self.levels is not None:
            return df.withColumn(name, F.coalesce(self.holds(F.col(key)), F.lit(False)))
        found = self.listed.select(F.col("key").alias("__listed"))
        return df.join(found, F.col(key) == F.col("__listed"), "left").withColumn(name, F.col("__listed").isNotNull()).drop("__listed")


def filter_urls(pages: DataFrame, rules=RULES, listed_hosts=LISTED_HOSTS, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict."""
    host, path = split_url(F.col(url))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = pages.select(*[F.col(f"`{c}`") for c in names], host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    rule_shapes = shapes(rules)
    # the host list: one key for each number of labels that it has
    host_shapes = sorted({h.count(".") + 1 for h in listed_hosts}, reverse=True)
    by_shape = {f"__r{i}": _key(labels, F.col("path"), n, length) for i, (n, length) in enumerate(rule_shapes)}
    by_host = {f"__h{i}": _key(labels, F.lit(""), n, 0) for i, n in enumerate(host_shapes)}
    out = out.withColumns(by_shape | by_host)

    def members(keys, listed):
        universe = common.stage(out.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct(), "keys")
        return [Members(universe, x) for x in listed]

    found = []
    if rules:
        keyed = [(v, h + p) for v, h, p in rules]
        blocking, allowing = members(by_shape, [[k for v, k in keyed if v == x] for x in ("block", "allow")])
        for k, (n, _) in zip(by_shape, rule_shapes):
            out = allowing.mark(blocking.mark(out, k, f"{k}b"), k, f"{k}a")
            verdict = F.when(F.col(f"{k}b"), "block").otherwise("allow")
            found.append(F.when(F.col(f"{k}b") | F.col(f"{k}a"), F.struct(F.length(k).alias("n"), F.lit(n).alias("labels"), F.col(k).alias("rule"), verdict.alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
    out = out.withColumn("__best", best)
    on_list = F.lit(False)
    if by_host:
        (hosts,) = members(by_host, [list(listed_hosts)])
        for k in by_host:
            out = hosts.mark(out, k, f"{k}l")
            on_list = on_list | F.col(f"{k}l")
    by_method = F.when(on_list, "block").otherwise("allow")
    return out.select(*[F.col(f"`{c}`") for c in names], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), by_method).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
