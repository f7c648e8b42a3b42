"""Substring search as an automaton over codes: exact for any tokenization of the rows."""
from __future__ import annotations

import numpy as np

from stringloom.errors import PatternTooLong
from stringloom.functions.dictionary import Dictionary

MAX_PATTERN = 255


class Automaton:
    """States are lengths of the matched part of the pattern; the full length accepts and stays."""

    def __init__(self, pattern: bytes, dictionary: Dictionary):
        if len(pattern) > MAX_PATTERN:
            raise PatternTooLong(len(pattern), MAX_PATTERN)
        self.pattern, self.states, self.n = pattern, len(pattern) + 1, dictionary.num_tokens
        step = self._bytes(pattern)
        width = max(map(len, dictionary.tokens))
        data = np.zeros((self.n, width), np.uint8)
        for i, t in enumerate(dictionary.tokens):
            data[i, : len(t)] = np.frombuffer(t, np.uint8)
        length = np.array([len(t) for t in dictionary.tokens])
        #: next state, by state and code
        self.next = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None], self.n, axis=1)
        for place in range(width):
            live = length > place
            self.next[:, live] = step[self.next[:, live], data[live, place]]

    @staticmethod
    def _bytes(pattern: bytes) -> np.ndarray:
        """Next state by state and byte."""
        m = len(pattern)
        table = np.zeros((m + 1, 256), np.uint8)
        border = 0  # the state after the pattern without its first byte
        for state in range(m):
            table[state] = table[border] if state else 0
            table[state, pattern[state]] = state + 1
            if state:
                border = int(table[border, pattern[state]])
        table[m] = m
        return table

    def accepts(self, codes: list[int]) -> bool:
        state = 0
        for c in codes:
            if state == self.states - 1:
                break
            state = int(self.next[state, c]) if 0 <= c < self.n else 0
        return state == self.states - 1

    @property
    def live(self) -> np.ndarray:
        """Codes after which something of the pattern may be matched (from some state short of the end); all others start over."""
        return (self.next[:-1] != 0).any(axis=0)

    def rows(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each of the rows that begin at `at` among the codes holds the pattern; a code outside the dictionary starts over.

        All stretches of live codes, of all rows, run side by side: as a stretch begins in the first state, they don't depend on each other.
        """
        last, n_rows = self.states - 1, len(at) - 1
        if not last:
            return np.ones(n_rows, bool)
        out = np.zeros(n_rows, bool)
        table = np.append(self.live, False)
        inside = np.where((codes >= 0) & (codes < self.n), codes, self.n)
        place = np.flatnonzero(table[inside])
        if not len(place):
            return out
        row = np.searchsorted(at[1:], place, "right")
        begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])]))
        length = np.diff(np.append(begin, len(place)))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        row, symbols = row[begin], inside[place]
        state = np.zeros(len(begin), np.uint8)
        for step in range(int(length[0])):
            k = int(np.searchsorted(-length, -step, "left"))  # stretches longer than `step` come first
            state[:k] = self.next[state[:k], symbols[begin[:k] + step]]
        out[row[state == last]] = True
        return out
