"""Plain buffers: rows of (dict_bytes, dict_offsets, is_sorted, codes, row_offsets), each a self-contained chunk of a column.

codes are little-endian 16-bit units; row_offsets (one more than rows) delimit rows in codes; dict_bytes ends with read padding.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stringloom.errors import Defect, InvalidColumn
from stringloom.functions.dictionary import Dictionary

SCHEMA = "dict_bytes binary, dict_offsets array<long>, is_sorted boolean, codes binary, row_offsets array<long>"


def chunk(rows: list[list[int]], dictionary: Dictionary) -> tuple:
    flat = np.array([c for r in rows for c in r], "<u2")
    return dictionary.padded, dictionary.offsets, dictionary.sorted, flat.tobytes(), [0, *np.cumsum([len(r) for r in rows]).tolist()]


def rows_of(dict_bytes: bytes, dict_offsets: list[int], codes: bytes, row_offsets: list[int], validate: str = "full") -> tuple[Dictionary, list[list[int]]]:
    """A chunk's dictionary and rows; validate: full, safety or none."""
    dictionary = Dictionary.from_buffers(dict_bytes, dict_offsets, validate)
    flat = np.frombuffer(codes, "<u2")
    if validate != "none":
        if len(flat) and int(flat.max()) >= dictionary.num_tokens:
            raise InvalidColumn(Defect.CODE_OUT_OF_RANGE)
        if not len(row_offsets) or row_offsets[0] != 0 or row_offsets[-1] != len(flat) or any(b < a for a, b in zip(row_offsets, row_offsets[1:])):
            raise InvalidColumn(Defect.BAD_ROW_OFFSETS)
    return dictionary, [flat[a:b].tolist() for a, b in zip(row_offsets, row_offsets[1:])]


def export(df: DataFrame, dictionary: Dictionary, keys: list[str], codes: str = "codes") -> DataFrame:
    """Encoded rows to chunks, one an Arrow batch, with the rows' keys in the same order; null codes become empty rows."""
    from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

    plain = _parse_datatype_string(SCHEMA)
    schema = StructType([*plain.fields, *(StructField(k, ArrayType(df.schema[k].dataType)) for k in keys)])

    def run(batches):
        for batch in batches:
            made = chunk([x or [] for x in batch.column(len(keys)).to_pylist()], dictionary)
            cols = [pa.array([made[0]], pa.binary()), pa.array([made[1]], pa.list_(pa.int64())), pa.array([made[2]]), pa.array([made[3]], pa.binary()), pa.array([made[4]], pa.list_(pa.int64()))]
            cols += [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(i)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.select(*keys, codes).mapInArrow(run, schema)


def load(chunks: DataFrame, keys: list[str], value: str = "value", validate: str = "full") -> DataFrame:
    """Chunks to (keys, value): checked, then decoded by each chunk's own dictionary."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*(StructField(k, chunks.schema[k].dataType.elementType) for k in keys), StructField(value, BinaryType())])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                at = {n: batch.column(names.index(n))[i] for n in names}
                dictionary, rows = rows_of(at["dict_bytes"].as_py(), at["dict_offsets"].as_py(), at["codes"].as_py(), at["row_offsets"].as_py(), validate)
                back = pa.array([b"".join(dictionary.token(c) for c in r) for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*(at[k].values for k in keys), back], names=[*keys, value])

    return chunks.select("dict_bytes", "dict_offsets", "codes", "row_offsets", *keys).mapInArrow(run, schema)
