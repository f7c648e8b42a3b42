"""Learning a dictionary: a random sample of rows, then rounds of merging the most frequent neighbours of the whole sample at once.

Spark draws rows (not values, so a frequent value has its share) and counts equal ones; one task reads at most the budget of them, in
order of a seeded hash, and works on arrays: every round counts all pairs of neighbours, takes the most frequent ones and merges them
wherever no better pair is in the way. Between rounds the sample is parsed again as encoding will parse it (longest token first), and
tokens that this parse does not use make room for others.
"""
from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.config import DEFAULT_CONFIG, MAX_TOKEN, Config
from stringloom.functions.dictionary import Dictionary
from stringloom.operators.matcher import Matcher

#: The dictionary grows by this factor in a round at most; it is parsed again (and thinned) so many times.
GROWTH, PARSES = 1.5, 1
#: Fewest occurrences that make a pair a token, unless the configuration fixes them.
LEAST = 2
#: Symbols up to whose square pairs are counted in a table.
DENSE = 2048


class _Sample:
    """The sample as one array of symbols: ends of rows are marked, and a row that stands for several weighs as much."""

    def __init__(self, rows: list[bytes], copies: list[int]):
        self.rows, self.copies, self.plain = rows, copies, max(copies, default=1) == 1
        self.names: list[bytes] = [bytes([b]) for b in range(256)]
        self.number = {name: i for i, name in enumerate(self.names)}
        self.set([np.frombuffer(r, np.uint8).astype(np.int64) for r in rows])

    def set(self, rows: list[np.ndarray]) -> None:
        size = np.array([len(r) for r in rows], np.int64)
        self.symbols = np.concatenate([*rows, np.zeros(0, np.int64)])
        self.last = np.zeros(len(self.symbols), bool)
        self.last[np.cumsum(size)[size > 0] - 1] = True
        self.weight = None if self.plain else np.repeat(np.array(self.copies, np.int64), size)

    def parse(self, tokens: set[bytes]) -> None:
        matcher = Matcher(Dictionary.of(tokens))
        names = np.array([self.number[t] for t in matcher.tokens], np.int64)
        self.set([names[np.frombuffer(matcher.packed(r), ">u2")] for r in self.rows])

    def used(self) -> np.ndarray:
        return np.bincount(self.symbols, self.weight, len(self.names))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs, occurrences, each place's pair by its index or the number of pairs if it has none): of neighbours in a row
        that are not too long together."""
        n = len(self.names)
        size = np.array([len(x) for x in self.names], np.int8)[self.symbols]
        fits = np.flatnonzero(~self.last[:-1] & (size[:-1] + size[1:] <= MAX_TOKEN))
        pair = self.symbols[fits] * n + self.symbols[fits + 1]
        weight = None if self.plain else self.weight[fits]
        if n <= DENSE:
            table = np.bincount(pair, weight, n * n)
            names = np.flatnonzero(table)
            count = table[names]
            index = np.zeros(n * n, np.int32)
            index[names] = np.arange(len(names))
            at = index[pair]
        else:
            names, at = np.unique(pair, return_inverse=True)
            count = np.bincount(at, weight, len(names))
        out = np.full(max(0, len(self.symbols) - 1), len(names), np.int32)
        out[fits] = at
        return names, count, out

    def merge(self, room: int, need: int) -> int:
        """Makes at most `room` pairs symbols, the most frequent first; gives the number of new ones."""
        if len(self.symbols) < 2:
            return 0
        n = len(self.names)
        names, count, at = self.pairs()
        good = np.flatnonzero(count >= need)
        best = good[np.lexsort((names[good], -count[good]))][:room]
        if not len(best):
            return 0
        worst = len(best)
        rank = np.full(len(names) + 1, worst, np.int32)
        rank[best] = np.arange(worst)
        ranks = rank[at]
        # a pair is merged where both neighbouring pairs are worse; of a run of equal pairs every other one
        here = ranks < worst
        here[1:] &= ranks[:-1] >= ranks[1:]
        here[:-1] &= ranks[1:] >= ranks[:-1]
        place = np.flatnonzero(here)
        start = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (ranks[place[1:]] != ranks[place[:-1]])])
        since = np.arange(len(place)) - np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        place = place[since % 2 == 0]
        taken = np.bincount(ranks[place], None if self.plain else self.weight[place], worst)
        place = place[taken[ranks[place]] >= need]
        to = np.full(worst, -1, np.int64)
        made = 0
        for r in np.flatnonzero(taken >= need).tolist():
            a, b = divmod(int(names[best[r]]), n)
            name = self.names[a] + self.names[b]
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
                made += 1
            to[r] = self.number[name]
        self.symbols[place] = to[ranks[place]]
        self.last[place] = self.last[place + 1]
        keep = np.ones(len(self.symbols), bool)
        keep[place + 1] = False
        self.symbols, self.last = self.symbols[keep], self.last[keep]
        if not self.plain:
            self.weight = self.weight[keep]
        return made


def learn(rows: Iterable[bytes], config: Config = DEFAULT_CONFIG, budget: int | None = None, copies: Iterable[int] | None = None) -> Dictionary:
    """The dictionary of rows; copies: how many rows each stands for; budget: bytes to read (the row that exceeds it is cut).

    The order of the rows matters only where the budget ends.
    """
    read, kept, times = 0, [], []
    for row, m in zip(rows, copies) if copies is not None else ((r, 1) for r in rows):
        if budget is not None and read + len(row) > budget:
            row = row[: budget - read]
        read += len(row)
        if row:
            kept.append(row)
            times.append(m)
        if budget is not None and read >= budget:
            break
    capacity, need = config.max_dict_bits.capacity, config.fixed_threshold or LEAST
    sample = _Sample(kept, times)
    tokens: set[bytes] = set()
    for parse in range(PARSES + 1):
        while (room := capacity - 256 - len(tokens)) > 0:
            before = len(sample.names)
            if not sample.merge(min(room, max(64, int((GROWTH - 1) * (256 + len(tokens))))), need):
                break
            tokens.update(sample.names[before:])
        if parse == PARSES or not tokens:
            break
        sample.parse(tokens)
        used = sample.used()
        kept_tokens = {t for t in tokens if used[sample.number[t]] >= need}
        if len(kept_tokens) < len(tokens):
            tokens = kept_tokens
            sample.names = [x for x in sample.names if len(x) == 1 or x in tokens]
            sample.number = {name: i for i, name in enumerate(sample.names)}
            sample.parse(tokens)
    return Dictionary.of(tokens)


def sample(df: DataFrame, column: str, config: Config = DEFAULT_CONFIG) -> tuple[DataFrame, int | None]:
    """(distinct values v of the rows to learn from with their copies m and a seeded order h, bytes to read or None for all)."""
    seed = config.seed if config.seed is not None else random.getrandbits(31)
    values = df.select(F.col(column).cast("binary").alias("v")).where(F.col("v").isNotNull())
    budget = None
    if config.fixed_threshold is None:
        total = values.agg(F.sum(F.octet_length("v"))).first()[0] or 0
        budget = min(int(total * config.threshold.value), config.max_sample_bytes)
        # twice the budget and some rows more: enough to reach the budget, and bounded whatever the table's size
        share = 2 * budget / max(1, total) + 65_536 / max(1, total)
        if share < 1:
            values = values.sample(fraction=share, seed=seed)
        values = values.select(F.substring("v", 1, max(1, budget)).alias("v"))
    return values.groupBy("v").agg(F.count("*").alias("m")).withColumn("h", F.xxhash64(F.lit(seed), "v")), budget


def fit(df: DataFrame, column: str, config: Config = DEFAULT_CONFIG) -> Dictionary:
    """The dictionary of a column; deterministic for a seed and a table's partitions (for any partitions if all rows are read). Nulls are passed over.

    Learning is the work of one task on bounded bytes; only the tokens reach the driver.
    """
    chosen, budget = sample(df, column, config)

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        values, copies = [], []
        read = 0
        for v, m in rows():
            values.append(v)
            copies.append(m)
            read += len(v)
            if budget is not None and read >= budget:
                break
        made = learn(values, config, budget, copies)
        yield pa.RecordBatch.from_arrays([pa.array(made.tokens, pa.binary())], names=["token"])

    one = chosen.repartition(1).sortWithinPartitions("h", "v").select("v", "m")
    return Dictionary(sorted(bytes(r["token"]) for r in one.mapInArrow(run, "token binary").collect())) if budget != 0 else Dictionary.of()
