"""The token-frequency index: how often each code occurs, as cumulative counts."""
from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stringloom.config import MAX_TOKENS
from stringloom.errors import IndexDefect, InvalidFrequencyIndex
from stringloom.functions.dictionary import Dictionary, TokenRange

_MOST = 2**32 - 1


class FrequencyIndex:
    """cumulative[i] counts the codes below i; the last entry is the total."""

    def __init__(self, cumulative: Sequence[int]):
        c = list(cumulative)
        if not c:
            raise InvalidFrequencyIndex(IndexDefect.EMPTY)
        if len(c) > MAX_TOKENS + 1:
            raise InvalidFrequencyIndex(IndexDefect.TOO_MANY_TOKENS)
        if c[0] != 0:
            raise InvalidFrequencyIndex(IndexDefect.FIRST_NOT_ZERO)
        if any(b < a for a, b in zip(c, c[1:])):
            raise InvalidFrequencyIndex(IndexDefect.DECREASING)
        self.cumulative = c

    @staticmethod
    def of_counts(counts: Sequence[int], limit: int | None = _MOST) -> FrequencyIndex:
        if len(counts) > MAX_TOKENS:
            raise InvalidFrequencyIndex(IndexDefect.TOO_MANY_TOKENS)
        cumulative = [0, *accumulate(counts)]
        if limit is not None and cumulative[-1] > limit:
            raise InvalidFrequencyIndex(IndexDefect.FREQUENCY_OVERFLOW)
        return FrequencyIndex(cumulative)

    @property
    def num_tokens(self) -> int:
        return len(self.cumulative) - 1

    @property
    def total(self) -> int:
        return self.cumulative[-1]

    def frequency(self, code: int) -> int:
        if not 0 <= code < self.num_tokens:
            raise InvalidFrequencyIndex(IndexDefect.CODE_OUT_OF_RANGE)
        return self.cumulative[code + 1] - self.cumulative[code]

    def range_frequency(self, codes: TokenRange) -> int:
        return 0 if codes.empty else self.cumulative[min(codes.last + 1, self.num_tokens)] - self.cumulative[codes.begin]


def counts(df: DataFrame, dictionary: Dictionary, codes: str = "codes") -> DataFrame:
    """(code, cnt, cumulative) for every code of the dictionary; cumulative counts the codes below. Codes outside it are passed over.

    Counting combines before the shuffle, so at most a row for each code and task travels; the running sum is over the dictionary only.
    """
    spark = df.sparkSession
    seen = df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    every = spark.range(dictionary.num_tokens).select(F.col("id").cast("int").alias("code"))
    full = every.join(seen, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))
    below = W.orderBy("code").rowsBetween(W.unboundedPreceding, -1)
    return full.withColumn("cumulative", F.coalesce(F.sum("cnt").over(below), F.lit(0)).cast("long"))


def build(df: DataFrame, dictionary: Dictionary, codes: str = "codes") -> FrequencyIndex:
    """The exact index; a code outside the dictionary is an error. At most 65,536 counts reach the driver."""
    rows = df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n")).where(F.col("code").isNotNull()).limit(MAX_TOKENS + 1).collect()
    out = [0] * dictionary.num_tokens
    for r in rows:
        if not 0 <= r["code"] < dictionary.num_tokens:
            raise InvalidFrequencyIndex(IndexDefect.CODE_OUT_OF_RANGE)
        out[r["code"]] = r["n"]
    return FrequencyIndex.of_counts(out, None)


def sampled(df: DataFrame, dictionary: Dictionary, codes: str = "codes", share: float = 0.01, seed: int = 42, strict: bool = True) -> FrequencyIndex:
    """An index of blocks of 64 codes, chosen by hash of row and place, that hold about `share` of the codes.

    strict: a code outside the dictionary is an error; otherwise it is passed over.
    """
    block = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 64).cast("int"))
    blocks = df.where(F.size(codes) > 0).select(codes, F.explode(block).alias("b"))
    chosen = blocks.where(F.pmod(F.xxhash64(F.lit(seed), codes, "b"), F.lit(1_000_000)) < int(share * 1_000_000))
    part = chosen.select(F.slice(codes, F.col("b") * 64 + 1, F.lit(64)).alias(codes))
    if not strict:
        part = part.withColumn(codes, F.filter(codes, lambda c: (c >= 0) & (c < dictionary.num_tokens)))
    return build(part, dictionary, codes)


def sample_share(n_codes: int) -> float:
    """The share of n codes that planning a scan samples: four times the square root of their number, or all."""
    return 1.0 if n_codes <= 16 else min(1.0, 4 * math.isqrt(n_codes) / n_codes)


def from_table(table: DataFrame) -> FrequencyIndex:
    """The index of a stored table (code, cnt), as `counts` writes it: checked for gaps, and so for its size."""
    rows = sorted((r["code"], r["cnt"]) for r in table.select("code", "cnt").limit(MAX_TOKENS + 1).collect())
    if [c for c, _ in rows] != list(range(len(rows))):
        raise InvalidFrequencyIndex(IndexDefect.CODE_OUT_OF_RANGE)
    if any(n < 0 for _, n in rows):
        raise InvalidFrequencyIndex(IndexDefect.DECREASING)
    return FrequencyIndex.of_counts([n for _, n in rows], None)


def compression(df: DataFrame, dictionary: Dictionary, value: str, codes: str = "codes") -> DataFrame:
    """One row: raw and stored bytes of a column (dictionary, its offsets, two bytes a code, row offsets) and their ratio."""
    fixed = dictionary.logical_len + 4 * (dictionary.num_tokens + 1)
    sums = df.agg(F.sum(F.octet_length(value)).alias("raw_bytes"), F.sum(F.size(codes)).alias("n_codes"), F.count("*").alias("n_rows"))
    stored = F.lit(fixed) + 2 * F.col("n_codes") + 8 * (F.col("n_rows") + 1)
    return sums.withColumn("stored_bytes", stored).withColumn("ratio", F.col("raw_bytes") / F.col("stored_bytes"))
