"""Filters on encoded columns: equality, prefix and substring, without decoding the rows that don't match.

Equality and prefix compile to comparisons of `packed` with constants, which reach the Parquet scan. Substring search works on whole
batches of codes as arrays (columns of lists or packed rows): by the automaton, by a probe for the planned cover whose hits are checked
where they stand, or by decoding, whichever the plan prices lowest.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.functions.dictionary import EMPTY_RANGE, Dictionary, TokenRange
from stringloom.operators.codec import flat_codes, pack
from stringloom.plans.automaton import Automaton
from stringloom.plans.cover import SET_CODES, Cover, Scan, Verifier
from stringloom.sources.tables import bound_batches


def _bytes(value: bytes | str) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def equals(packed: Column, needle: bytes | str, dictionary: Dictionary) -> Column:
    return packed == F.lit(bytearray(pack(dictionary.tokenize(_bytes(needle)))))


class PrefixQuery:
    """For each place i of the needle's codes: the codes before it, and the range of codes that may stand there."""

    def __init__(self, needle: bytes | str, dictionary: Dictionary):
        needle = _bytes(needle)
        self.codes = dictionary.tokenize(needle)
        self.ranges: list[TokenRange] = []
        at = 0
        for code in self.codes:
            self.ranges.append(dictionary.prefix_range(needle[at:]) if len(needle) - at <= 16 else EMPTY_RANGE)
            at += dictionary.token_len(code)

    def matches(self, codes: list[int]) -> bool:
        """On the driver, for one row."""
        for i, want in enumerate(self.codes):
            if i >= len(codes):
                return False
            if codes[i] != want:
                return codes[i] in self.ranges[i]
        return True

    def bounds(self) -> list[tuple[bytes, bytes | None]]:
        """Half-open byte ranges of `packed`; their union is the predicate."""
        if not self.codes:
            return [(b"", None)]
        out = [(pack(self.codes), _above(self.codes))]  # the needle's own codes, then anything
        for i, r in enumerate(self.ranges):
            if not r.empty:
                out.append((pack([*self.codes[:i], r.begin]), _above([*self.codes[:i], r.last])))
        return out

    def column(self, packed: Column) -> Column:
        if not self.codes:
            return packed.isNotNull()
        tests = []
        for low, high in self.bounds():
            test = packed >= F.lit(bytearray(low))
            tests.append(test if high is None else test & (packed < F.lit(bytearray(high))))
        return reduce(or_, tests)


def _above(codes: list[int]) -> bytes | None:
    """The least packed value above all that start with codes; None if there is none."""
    codes = list(codes)
    while codes and codes[-1] == 0xFFFF:
        codes.pop()
    return pack([*codes[:-1], codes[-1] + 1]) if codes else None


def starts_with(packed: Column, needle: bytes | str, dictionary: Dictionary) -> Column:
    return PrefixQuery(needle, dictionary).column(packed)


def _by_rows(codes: Column, rows_of) -> Column:
    """A filter on a column of lists of codes or of packed rows; rows_of() makes, in the worker, the function of (codes, where rows begin)."""
    made: list = []

    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        if not made:
            made.append(rows_of())
        return pa.array(made[0](*flat_codes(column)), mask=column.is_null().to_numpy(zero_copy_only=False))

    return holds(codes)


def contains(codes: Column, pattern: bytes | str, dictionary: Dictionary) -> Column:
    """By automaton; exact for any tokenization, patterns of up to 255 bytes. codes: lists of codes, or packed rows."""
    automaton = Automaton(_bytes(pattern), dictionary)
    return _by_rows(codes, lambda: automaton.rows) if automaton.states > 1 else codes.isNotNull()


def probe(codes: Column, cover: Cover) -> Column:
    """Whether a row's list of codes has one of the cover, in the JVM."""
    every = cover.codes()
    if len(every) <= SET_CODES:
        # a set of over ten becomes a hash set; numbers that are no codes make up for fewer
        return F.exists(codes, lambda c: c.isin([*every, *range(-12, -1)]))

    def hit(c: Column) -> Column:
        tests = [c.between(a, b) for a, b in cover.ranges]
        if cover.points:
            tests.append(c.isin(cover.points))
        return reduce(or_, tests)

    return F.exists(codes, hit)


def contains_scan(df: DataFrame, pattern: bytes | str, dictionary: Dictionary, prefix: list[int] | None = None, codes: str = "codes", packed: str = "packed", way: str | None = None) -> DataFrame:
    """Rows of df that hold the pattern, by the way that the plan prices lowest (or `way`). Patterns of up to 65,535 bytes.

    Of the columns `codes` (lists) and `packed`, one is enough; without lists the JVM can't probe, and packed rows are cheaper to move.
    """
    bound_batches(df.sparkSession)
    pattern = _bytes(pattern)
    plan = Scan(pattern, dictionary, prefix)
    lists = codes in df.columns
    column = F.col(packed if packed in df.columns else codes)
    if plan.cover is None:
        return df.where(column.isNotNull())
    ways = [w for w in plan.ways if (way is None or w.kind == way) and (lists or w.kind != "native")]
    if not ways:
        raise ValueError(f"no way {way} to scan for this pattern")
    kind, cover = ways[0].kind, ways[0].cover
    if kind == "automaton":
        return df.where(contains(column, pattern, dictionary))
    if kind == "native":
        df = df.where(probe(F.col(codes), cover))
    return df.where(_by_rows(column, lambda: _verified(pattern, dictionary, cover)))


def _verified(pattern: bytes, dictionary: Dictionary, cover: Cover | None):
    """(codes, where rows begin) to whether each row holds the pattern; cover None: every code is a hit."""
    verifier = Verifier(pattern, dictionary)
    table = np.append(admits(cover, dictionary.num_tokens), False) if cover is not None else np.ones(dictionary.num_tokens + 1, bool)

    def rows(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = dictionary.num_tokens
        known = codes if not len(codes) or (codes.max() < n and codes.min() >= 0) else np.where((codes >= 0) & (codes < n), codes, n)
        return verifier.rows(codes, at, np.flatnonzero(table[known]))

    return rows


def admits(cover: Cover, num_tokens: int) -> np.ndarray:
    """The cover as a table over all codes."""
    out = np.zeros(num_tokens, bool)
    out[cover.points] = True
    for a, b in cover.ranges:
        out[a : b + 1] = True
    return out
