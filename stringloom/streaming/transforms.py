"""Encoding and searching streams: every operator after training is stateless, so a stream takes the batch operators as they are."""
from __future__ import annotations

from pyspark.sql import DataFrame

from stringloom.api import Codec


def encode_stream(stream: DataFrame, codec: Codec) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return codec.transform(stream)


def search_stream(stream: DataFrame, codec: Codec, pattern: bytes | str) -> DataFrame:
    """Rows of a stream of values that hold the pattern, found on their codes."""
    return codec.containing(encode_stream(stream, codec), pattern)
