"""Training parameters, checked when they are made."""
from __future__ import annotations

from dataclasses import dataclass

from stringloom.errors import InvalidArg

MAX_TOKEN = 16
MAX_TOKENS = 1 << 16


@dataclass(frozen=True)
class MaxDictBits:
    value: int

    def __post_init__(self):
        if not isinstance(self.value, int) or isinstance(self.value, bool) or not 9 <= self.value <= 16:
            raise InvalidArg("the dictionary's bits must be from 9 to 16")

    @property
    def capacity(self) -> int:
        return 1 << self.value


@dataclass(frozen=True)
class Threshold:
    """The share of the input's bytes that training may read."""

    value: float

    def __post_init__(self):
        if not (isinstance(self.value, (int, float)) and 0.0 < self.value <= 1.0):
            raise InvalidArg("the share of bytes to train on must be above 0 and at most 1")


@dataclass(frozen=True)
class Config:
    """max_dict_bits, threshold, seed (None: a random one); max_sample_bytes bounds what the one training task reads.

    fixed_threshold merges a pair when it was seen so often, without a budget, instead of adapting (for tests and ablations).
    """

    max_dict_bits: MaxDictBits = MaxDictBits(12)
    threshold: Threshold = Threshold(0.15)
    seed: int | None = 42
    max_sample_bytes: int = 4_000_000
    fixed_threshold: int | None = None

    def __post_init__(self):
        if isinstance(self.max_dict_bits, int):
            object.__setattr__(self, "max_dict_bits", MaxDictBits(self.max_dict_bits))
        if isinstance(self.threshold, (int, float)):
            object.__setattr__(self, "threshold", Threshold(self.threshold))
        if self.max_sample_bytes < 1:
            raise InvalidArg("max_sample_bytes must be positive")
        if self.fixed_threshold is not None and not 1 <= self.fixed_threshold <= 255:
            raise InvalidArg("a fixed threshold must be from 1 to 255")


DEFAULT_CONFIG = Config()
