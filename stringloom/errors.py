"""Errors: one class per kind, one fixed text per variant."""
from __future__ import annotations

from enum import Enum


class Error(ValueError):
    """Base of all errors raised for arguments and data."""


class InvalidArg(Error):
    def __init__(self, what: str = "invalid argument"):
        super().__init__(what)


class Defect(Enum):
    """What can be wrong with a stored column. The first eight make it unsafe to read, the last two only non-conforming."""

    EMPTY_DICTIONARY = "the dictionary has no tokens"
    FIRST_OFFSET_NOT_ZERO = "the first dictionary offset is not zero"
    DECREASING_OFFSETS = "dictionary offsets decrease"
    EMPTY_TOKEN = "a token is empty"
    TOKEN_TOO_LARGE = "a token is too long, or there are too many"
    MISSING_PADDING = "the dictionary bytes end before the read padding"
    CODE_OUT_OF_RANGE = "a code is not in the dictionary"
    BAD_ROW_OFFSETS = "row offsets are malformed"
    UNSORTED_TOKENS = "tokens are not strictly ascending"
    INCOMPLETE_ALPHABET = "a one-byte token is missing"


class InvalidColumn(Error):
    def __init__(self, defect: Defect):
        super().__init__(defect.value)
        self.defect = defect


class OutputTooSmall(Error):
    def __init__(self):
        super().__init__("the output is too small for the decoded bytes")


class ContainsError(Error):
    """Why a substring search can't be prepared."""


class PatternTooLong(ContainsError):
    def __init__(self, length: int, most: int):
        super().__init__(f"the pattern has {length} bytes; at most {most} are allowed")
        self.length, self.max = length, most


class FrequencyIndexMismatch(ContainsError):
    def __init__(self, index_tokens: int, dict_tokens: int):
        super().__init__(f"the frequency index counts {index_tokens} tokens, the dictionary has {dict_tokens}")
        self.index_tokens, self.dict_tokens = index_tokens, dict_tokens


class MissingByteToken(ContainsError):
    def __init__(self, byte: int):
        super().__init__(f"no token starts a match at byte {byte:#04x}")
        self.byte = byte


class IndexDefect(Enum):
    EMPTY = "the frequency index is empty"
    TOO_MANY_TOKENS = "the frequency index has too many entries"
    FIRST_NOT_ZERO = "the first cumulative count is not zero"
    DECREASING = "cumulative counts decrease"
    CODE_OUT_OF_RANGE = "a counted code is not in the dictionary"
    FREQUENCY_OVERFLOW = "more codes than 32 bits count"


class InvalidFrequencyIndex(Error):
    def __init__(self, defect: IndexDefect):
        super().__init__(defect.value)
        self.defect = defect
