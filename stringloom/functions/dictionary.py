"""The dictionary: sorted byte tokens whose code is their rank, with lookups and validation."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stringloom.config import MAX_TOKEN, MAX_TOKENS
from stringloom.errors import Defect, InvalidColumn

PADDING = 16


@dataclass(frozen=True)
class TokenRange:
    """Codes from begin to last, both included; empty if begin > last."""

    begin: int
    last: int

    @property
    def empty(self) -> bool:
        return self.begin > self.last

    def __len__(self) -> int:
        return 0 if self.empty else self.last - self.begin + 1

    def __contains__(self, code: int) -> bool:
        return self.begin <= code <= self.last


EMPTY_RANGE = TokenRange(1, 0)


def code_bits(num_tokens: int) -> int:
    """Bits that hold every code, at least one."""
    return max(1, (num_tokens - 1).bit_length())


def after(prefix: bytes) -> bytes | None:
    """The least byte string above everything that starts with prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


class Dictionary:
    """Immutable; picklable, so that it travels inside Arrow functions. Conforming: sorted, unique, complete, tokens of 1 to 16 bytes."""

    def __init__(self, tokens: Sequence[bytes], check: bool = True):
        self.tokens = tuple(bytes(t) for t in tokens)
        if check:
            self.check_safety(self.tokens)
            self.check_correctness()

    @staticmethod
    def of(extra: Iterable[bytes] = ()) -> Dictionary:
        """All single bytes and `extra`, sorted."""
        return Dictionary(sorted({bytes([b]) for b in range(256)} | set(extra)))

    # -- validation

    @staticmethod
    def check_safety(tokens: Sequence[bytes]) -> None:
        if not tokens:
            raise InvalidColumn(Defect.EMPTY_DICTIONARY)
        if len(tokens) > MAX_TOKENS:
            raise InvalidColumn(Defect.TOKEN_TOO_LARGE)
        for t in tokens:
            if not t:
                raise InvalidColumn(Defect.EMPTY_TOKEN)
            if len(t) > MAX_TOKEN:
                raise InvalidColumn(Defect.TOKEN_TOO_LARGE)

    def check_correctness(self) -> None:
        if not self.sorted:
            raise InvalidColumn(Defect.UNSORTED_TOKENS)
        if not self.complete:
            raise InvalidColumn(Defect.INCOMPLETE_ALPHABET)

    @staticmethod
    def from_buffers(data: bytes, offsets: Sequence[int], validate: str = "full") -> Dictionary:
        """Stored buffers to a dictionary. validate: full; safety (order and completeness aren't checked); none (trusted input)."""
        if validate != "none":
            if len(offsets) < 2:
                raise InvalidColumn(Defect.EMPTY_DICTIONARY)
            if len(offsets) - 1 > MAX_TOKENS:
                raise InvalidColumn(Defect.TOKEN_TOO_LARGE)
            if offsets[0] != 0:
                raise InvalidColumn(Defect.FIRST_OFFSET_NOT_ZERO)
            for a, b in zip(offsets, offsets[1:]):
                if b < a:
                    raise InvalidColumn(Defect.DECREASING_OFFSETS)
                if b == a:
                    raise InvalidColumn(Defect.EMPTY_TOKEN)
                if b - a > MAX_TOKEN:
                    raise InvalidColumn(Defect.TOKEN_TOO_LARGE)
            if len(data) < offsets[-2] + PADDING:
                raise InvalidColumn(Defect.MISSING_PADDING)
        made = Dictionary([data[a:b] for a, b in zip(offsets, offsets[1:])], check=False)
        if validate == "full":
            made.check_correctness()
        return made

    @property
    def sorted(self) -> bool:
        return all(a < b for a, b in zip(self.tokens, self.tokens[1:]))

    @property
    def complete(self) -> bool:
        return sum(len(t) == 1 for t in set(self.tokens)) == 256

    # -- parts

    @property
    def num_tokens(self) -> int:
        return len(self.tokens)

    @property
    def code_bits(self) -> int:
        return code_bits(len(self.tokens))

    @property
    def logical_len(self) -> int:
        return sum(map(len, self.tokens))

    @property
    def offsets(self) -> list[int]:
        out = [0]
        for t in self.tokens:
            out.append(out[-1] + len(t))
        return out

    @property
    def payload(self) -> bytes:
        return b"".join(self.tokens)

    @property
    def padded(self) -> bytes:
        """The payload with read padding: 16 bytes from the last token's start on."""
        data = self.payload
        return data + bytes(max(0, self.offsets[-2] + PADDING - len(data)))

    def token(self, code: int) -> bytes:
        if not 0 <= code < len(self.tokens):
            raise InvalidColumn(Defect.CODE_OUT_OF_RANGE)
        return self.tokens[code]

    def token_len(self, code: int) -> int:
        return len(self.token(code))

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(self.tokens)], "code int, token binary")

    def __eq__(self, other) -> bool:
        return isinstance(other, Dictionary) and self.tokens == other.tokens

    def __hash__(self) -> int:
        return hash(self.tokens)

    # -- lookups by content; they need a sorted dictionary

    def prefix_range(self, prefix: bytes) -> TokenRange:
        """Codes of the tokens that start with prefix."""
        if len(prefix) > MAX_TOKEN:
            return EMPTY_RANGE
        stop = after(prefix)
        lo, hi = bisect_left(self.tokens, prefix), len(self.tokens) if stop is None else bisect_left(self.tokens, stop)
        return TokenRange(lo, hi - 1) if lo < hi else EMPTY_RANGE

    def narrow(self, within: TokenRange, place: int, byte: int) -> TokenRange:
        """The codes of `within`, whose tokens agree in their first `place` bytes, that have `byte` at that place."""
        if within.empty:
            return EMPTY_RANGE
        stem = self.tokens[within.last][:place] + bytes([byte])
        found = self.prefix_range(stem)
        lo, hi = max(found.begin, within.begin), min(found.last, within.last)
        return TokenRange(lo, hi) if lo <= hi else EMPTY_RANGE

    def longest_prefix(self, data: bytes) -> tuple[int | None, TokenRange]:
        """(code of the longest token that data starts with, codes of the tokens that start with all of data)."""
        best = None
        for n in range(1, min(MAX_TOKEN, len(data)) + 1):
            i = bisect_left(self.tokens, data[:n])
            if i < len(self.tokens) and self.tokens[i] == data[:n]:
                best = i
            elif i >= len(self.tokens) or not self.tokens[i].startswith(data[:n]):
                break
        return best, self.prefix_range(data)

    def tokenize(self, text: bytes) -> list[int]:
        """Greedy codes of one text: the longest token at each place; what no token starts is skipped by byte as code 0."""
        index = {t: i for i, t in enumerate(self.tokens)} if len(text) > 64 else None
        out, at = [], 0
        while at < len(text):
            window = text[at : at + MAX_TOKEN]
            if index is None:
                code = self.longest_prefix(window)[0]
            else:
                code = next((index[window[:n]] for n in range(len(window), 0, -1) if window[:n] in index), None)
            out.append(0 if code is None else code)
            at += 1 if code is None else len(self.tokens[code])
        return out
