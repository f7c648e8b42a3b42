"""Greedy longest-prefix matching on the workers."""
from __future__ import annotations

import numpy as np

from stringloom.config import MAX_TOKEN
from stringloom.functions.dictionary import Dictionary

try:
    import ahocorasick
except ImportError:  # an optional accelerator; the plain matcher gives the same codes
    ahocorasick = None


class Matcher:
    """Codes of whole rows under one dictionary, as big-endian 16-bit units."""

    def __init__(self, dictionary: Dictionary, accelerate: bool = True):
        self.tokens = dictionary.tokens
        self.single = dictionary.num_tokens == 256 and dictionary.complete
        self.index = {t: i.to_bytes(2, "big") for i, t in enumerate(dictionary.tokens)}
        # the longest token for each pair of first bytes bounds how far to look
        self.reach: dict[bytes, int] = {}
        for t in dictionary.tokens:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 0), len(t))
        self.automaton = None
        if accelerate and ahocorasick is not None and not self.single and dictionary.complete:
            self.automaton = ahocorasick.Automaton()
            for t, unit in self.index.items():
                self.automaton.add_word(t.decode("latin-1"), unit)
            self.automaton.make_automaton()

    def packed(self, row: bytes) -> bytes:
        if self.single:
            return np.frombuffer(row, np.uint8).astype(">u2").tobytes()
        if self.automaton is not None:
            return b"".join([unit for _, unit in self.automaton.iter_long(row.decode("latin-1"))])
        out, at, index, reach = [], 0, self.index, self.reach
        while at < len(row):
            for n in range(min(reach.get(row[at : at + 2], 1), MAX_TOKEN, len(row) - at), 0, -1):
                unit = index.get(row[at : at + n])
                if unit is not None:
                    out.append(unit)
                    at += n
                    break
            else:  # no token starts here: only with an incomplete dictionary
                out.append(b"\0\0")
                at += 1
        return b"".join(out)

    def codes(self, row: bytes) -> list[int]:
        return np.frombuffer(self.packed(row), ">u2").tolist()
