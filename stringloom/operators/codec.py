"""Encoding and decoding as projections: a byte string to `codes` (array of int) or `packed` (big-endian 16-bit units), and back.

Encoding is an Arrow function (the greedy match is sequential within a row), and so is decoding, by one gather of the tokens of a whole
batch (`decode_column` is the JVM expression, for use inside other expressions). NULL stays NULL, the empty string is the empty list.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from stringloom.errors import Defect, InvalidColumn
from stringloom.functions.dictionary import Dictionary
from stringloom.operators.matcher import Matcher
from stringloom.sources.tables import bound_batches


def encode(df: DataFrame, column: str, dictionary: Dictionary, codes: str | None = "codes", packed: str | None = "packed", drop: bool = False) -> DataFrame:
    """df with the columns `codes` and `packed` (either may be None); no shuffle, streaming tables too."""
    bound_batches(df.sparkSession)
    names = [c for c in df.columns if c not in (codes, packed) and not (drop and c == column)]
    added = ([StructField(codes, ArrayType(IntegerType(), False))] if codes else []) + ([StructField(packed, BinaryType())] if packed else [])
    schema = StructType([df.schema[n] for n in names] + added)
    source = df.select(*names, F.col(column).cast("binary").alias("__value"))

    def run(batches):
        matcher = Matcher(dictionary)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            units = [None if v is None else matcher.packed(v) for v in values.to_pylist()]
            out = [batch.column(i) for i in range(len(names))]
            if codes:
                out.append(_lists(units))
            if packed:
                out.append(pa.array(units, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _lists(units: list[bytes | None]) -> pa.Array:
    """Packed rows to lists of codes, through one flat array."""
    flat = np.frombuffer(b"".join([u for u in units if u is not None]), ">u2").astype(np.int32)
    ends = np.cumsum([0, *(0 if u is None else len(u) // 2 for u in units)]).astype(np.int32)
    missing = pa.array([u is None for u in units], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=missing if missing.true_count else None)


def pack(codes: list[int]) -> bytes:
    return b"".join(c.to_bytes(2, "big") for c in codes)


def unpack(packed: Column) -> Column:
    """packed to codes, in the JVM."""
    hexed = F.hex(packed)
    n = (F.octet_length(packed) / 2).cast("int")
    unit = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.conv(F.substr(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.when(packed.isNotNull(), unit)


def decode_column(codes: Column, dictionary: Dictionary) -> Column:
    """codes to bytes, in the JVM; a code that the dictionary lacks is an error."""
    table = F.lit([t.hex().upper() for t in dictionary.tokens])
    n = dictionary.num_tokens
    lookup = F.transform(codes, lambda c: F.when((c >= 0) & (c < n), F.get(table, c)).otherwise(F.raise_error(F.lit(Defect.CODE_OUT_OF_RANGE.value))))
    return F.unhex(F.array_join(lookup, ""))


def flat_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all codes, where each row's begin, one more entry) of a column of lists of codes or of packed rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return raw.view(">u2").astype(np.int32), (at - at[0]) // 2
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False), np.concatenate([[0], np.cumsum(sizes)])


class Decoder:
    """Bytes of whole batches of codes by one gather."""

    def __init__(self, dictionary: Dictionary):
        self.table = pa.array(dictionary.tokens, pa.large_binary())
        self.size = np.array([len(t) for t in dictionary.tokens], np.int64)
        self.n = dictionary.num_tokens

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, pa.Buffer | None]:
        """(where each code's bytes begin, one more entry; the bytes)."""
        if not len(codes):
            return np.zeros(1, np.int64), None
        if int(codes.max()) >= self.n or int(codes.min()) < 0:
            raise InvalidColumn(Defect.CODE_OUT_OF_RANGE)
        _, offsets, data = self.table.take(pa.array(codes)).buffers()
        return np.frombuffer(offsets, np.int64)[: len(codes) + 1], data

    def rows(self, codes: np.ndarray, at: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        """The values of rows that begin at `at` among the codes."""
        offsets, data = self.gather(codes)
        ends = np.ascontiguousarray(offsets[at])
        valid = None if missing is None or not missing.any() else pa.array(~missing).buffers()[1]
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [valid, pa.py_buffer(ends), data if data is not None else pa.py_buffer(b"")])
        return made.cast(pa.binary()) if int(ends[-1]) < 2**31 else made


def decode(df: DataFrame, dictionary: Dictionary, codes: str = "codes", value: str = "value", kind: str = "binary") -> DataFrame:
    """df with `value` decoded from the column `codes` (lists of codes, or packed rows); kind: binary, or string for what was text."""
    bound_batches(df.sparkSession)
    names = [c for c in df.columns if c != value]
    schema = StructType([df.schema[n] for n in names] + [StructField(value, BinaryType())])

    def run(batches):
        decoder = Decoder(dictionary)
        for batch in batches:
            column = batch.column(names.index(codes))
            flat, at = flat_codes(column)
            back = decoder.rows(flat, at, column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], back], names=[*names, value])

    return df.select(*names).mapInArrow(run, schema).withColumn(value, F.col(value).cast(kind))


def decode_bytes(codes: list[int], dictionary: Dictionary, capacity: int | None = None) -> bytes:
    """One list of codes on the driver; OutputTooSmall if the bytes exceed capacity."""
    from stringloom.errors import OutputTooSmall

    out = b"".join(dictionary.token(c) for c in codes)
    if capacity is not None and len(out) > capacity:
        raise OutputTooSmall
    return out
