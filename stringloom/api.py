"""The engine's surface: fit a codec on a column, encode tables, search and decode them.

    codec = Codec.fit(df, "url")
    encoded = codec.transform(df)              # df with codes and packed
    codec.starting_with(encoded, "https://m.").select("page_id")
    codec.decode(encoded)                      # back again
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.config import DEFAULT_CONFIG, Config
from stringloom.functions.dictionary import Dictionary
from stringloom.operators import codec as ops
from stringloom.operators import frequency, predicates
from stringloom.operators.train import fit as fit_dictionary
from stringloom.plans.cover import Scan
from stringloom.sources.tables import bound_batches


@dataclass(frozen=True)
class Codec:
    """A trained dictionary for the column `column`; encodes any table that has it, also rows it was not trained on."""

    column: str
    dictionary: Dictionary

    @staticmethod
    def fit(df: DataFrame, column: str, config: Config = DEFAULT_CONFIG) -> Codec:
        return Codec(column, fit_dictionary(df, column, config))

    # -- encoding and decoding

    def transform(self, df: DataFrame, drop: bool = False, codes: bool = True) -> DataFrame:
        """df with codes and packed; drop: without the value; codes False: packed alone, which is enough to search and to decode."""
        return ops.encode(df, self.column, self.dictionary, "codes" if codes else None, drop=drop)

    def transform_distinct(self, df: DataFrame) -> DataFrame:
        """For columns of few distinct values: each value is encoded once and joined back."""
        values = df.select(self.column).where(F.col(self.column).isNotNull()).distinct()
        return df.join(ops.encode(values, self.column, self.dictionary), self.column, "left")

    def decode(self, encoded: DataFrame, value: str = "value", kind: str = "string") -> DataFrame:
        return ops.decode(encoded, self.dictionary, self._codes(encoded), value, kind)

    @staticmethod
    def _codes(encoded: DataFrame) -> str:
        """Packed rows are cheaper to move than lists."""
        return "packed" if "packed" in encoded.columns else "codes"

    def decode_row(self, encoded: DataFrame, key: str, k, value: str = "value", kind: str = "string") -> DataFrame:
        """Random access: the rows whose key is k, decoded; the others are not touched."""
        return self.decode(encoded.where(F.col(key) == k), value, kind)

    # -- searching

    def equal_to(self, encoded: DataFrame, needle: bytes | str) -> DataFrame:
        return encoded.where(predicates.equals(F.col("packed"), needle, self.dictionary))

    def starting_with(self, encoded: DataFrame, needle: bytes | str) -> DataFrame:
        return encoded.where(predicates.starts_with(F.col("packed"), needle, self.dictionary))

    def containing(self, encoded: DataFrame, pattern: bytes | str) -> DataFrame:
        bound_batches(encoded.sparkSession)
        return encoded.where(predicates.contains(F.col(self._codes(encoded)), pattern, self.dictionary))

    def containing_with_scan(self, encoded: DataFrame, pattern: bytes | str, index: frequency.FrequencyIndex | None = None) -> DataFrame:
        return predicates.contains_scan(encoded, pattern, self.dictionary, index.cumulative if index is not None else None)

    def plan(self, pattern: bytes | str, index: frequency.FrequencyIndex | None = None) -> Scan:
        return Scan(pattern.encode() if isinstance(pattern, str) else pattern, self.dictionary, index.cumulative if index is not None else None)

    # -- statistics

    def frequencies(self, encoded: DataFrame) -> frequency.FrequencyIndex:
        return frequency.build(encoded, self.dictionary)

    def sampled_frequencies(self, encoded: DataFrame, share: float | None = None, strict: bool = False) -> frequency.FrequencyIndex:
        """share None: as many codes as planning needs, four times the square root of their number."""
        if share is None:
            share = frequency.sample_share(encoded.agg(F.sum(F.size("codes"))).first()[0] or 0)
        return frequency.sampled(encoded, self.dictionary, share=share, strict=strict)

    def compression(self, encoded: DataFrame) -> DataFrame:
        return frequency.compression(encoded, self.dictionary, self.column)


def ordered(df: DataFrame, key: str) -> DataFrame:
    """Ascending row ids, for results that are compared in order."""
    return df.orderBy(key)


def payload(decoded: DataFrame, key: str, value: str = "value") -> bytes:
    """The whole column as one byte string in key order, streamed to the driver a partition at a time; for columns that fit there."""
    return b"".join(bytes(r[value]) for r in decoded.where(F.col(value).isNotNull()).select(key, F.col(value).cast("binary").alias(value)).orderBy(key).toLocalIterator())
