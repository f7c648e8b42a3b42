"""Operator 4: proportional stratified interleaving, with DataFrame functions only.

Rows are put in a seeded random order within their source and get the fractional rank (rank - phase) / rows of the source, where the
phase is the source's own, from 0 to 1 by hash. Sorted by it, every stretch of the whole holds the sources in proportion (to one row), so
cutting it into equal stretches gives shards that match the mixture; sources of one size don't share their fractions.

Law held: `rows` (shards' row counts are at most one apart). grown_shard is null, as that belongs to the law `key`. Rows are shuffled one
by one, so equal texts are not kept in one shard: a group of them may be larger than a shard, and the law leaves no room.

No source and no global order meets in one task: a rank is the count of the rows in earlier hash (or fraction) buckets plus the
place in one's own bucket; the number of buckets follows the rows, so a bucket stays small: rows that are the same in all columns are
counted first and numbered, so that they have hashes of their own, too. Only narrow rows are shuffled.

Defined results: null or empty text has size 8 and text_crc32 0; a null source is a source of its own; rows that are the same in all
these columns are interchangeable and get places of their own; a very long text is one row like any other; an empty table gives no rows;
other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stringloom.llm import common

SHARDS, SEED = 24, 20240229
#: Rows of a bucket on average; buckets of one group are windows of their own.
BUCKET_ROWS = 4096


def _ranked(rows: DataFrame, group: list[str], bucket, order: list, total: str, rank: str) -> DataFrame:
    """rows with `rank` (from 0) in `order` within `group`, and the group's rows as `total`; bucket must not decrease along `order`."""
    rows = rows.withColumn("_b", bucket)
    place = W.partitionBy(*group, "_b").orderBy(*order)
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    # the counts of at most BUCKETS buckets per group: summed in two steps, so that one window holds at most a square root of them
    counts = counts.withColumn("_hi", F.floor(F.col("_b") / 1024))
    his = counts.groupBy(*group, "_hi").agg(F.sum("_n").alias("_hn"))
    every = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    his = his.withColumn("_before", F.coalesce(F.sum("_hn").over(every.orderBy("_hi").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(total, F.sum("_hn").over(every)).drop("_hn")
    inner = W.partitionBy(*group, "_hi").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).drop("_n").join(his, [*group, "_hi"])
    counts = counts.select(*group, "_b", (F.col("_before") + F.col("_in")).alias("_off"), total)
    rows = rows.withColumn(rank, F.row_number().over(place))
    return rows.join(counts, [*group, "_b"]).withColumn(rank, (F.col(rank) - 1 + F.col("_off")).cast("long")).drop("_b", "_off")


def _numbered(rows: DataFrame, number: str) -> DataFrame:
    """rows with equal ones numbered from 0: counted, then written out again in pieces of 4096."""
    names = rows.columns
    many = rows.groupBy(*names).agg(F.count("*").alias("_m"))
    pieces = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_m - 1) div 4096"))).alias("_piece"))
    return pieces.select(*names, F.explode(F.expr("sequence(_piece * 4096, least(_m, (_piece + 1) * 4096) - 1)")).alias(number))


def interleave(rows: DataFrame, source: str, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows (narrow: the columns `keys` and `source`) with shard and slot."""
    rows = common.stage(_numbered(rows.select(*keys, source), "_j"), "numbered")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    names = F.xxhash64(F.lit(1), source)
    rows = rows.withColumn("_s", F.when(F.col(source).isNull(), F.lit(0)).otherwise(names))
    rows = rows.withColumn("_u", F.xxhash64(F.lit(seed), *keys, "_j"))
    part = F.floor((F.shiftrightunsigned("_u", 33).cast("double") / 2.0**31) * buckets).cast("long")
    by = [F.shiftrightunsigned("_u", 33), "_u", *keys, "_j"]
    rows = _ranked(rows, ["_s"], part, by, "_of", "_r")
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(2), "_s"), 33).cast("double") / 2.0**31
    rows = rows.withColumn("_f", (F.col("_r") + phase) / F.col("_of"))
    rows = rows.withColumn("_g", F.lit(0))
    part = F.floor(F.col("_f") * buckets).cast("long")
    rows = _ranked(rows, ["_g"], part, ["_f", "_s", "_u", *keys, "_j"], "_all", "_rank")
    shard = F.expr(f"(({shards}L * (_rank + 1)) - 1) div _all")
    rows = rows.withColumn("shard", shard.cast("int"))
    return rows.withColumn("slot", (F.col("_rank") - F.expr(f"(shard * _all) div {shards}L")).cast("long")).drop("_j", "_s", "_u", "_of", "_r", "_f", "_g", "_all", "_rank")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = interleave(rows, "source", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
