"""Operator 9: benchmark decontamination by SimHash over item-sized windows.

Windows: for each benchmark item, every run of as many words of the document as the item has that holds at least one shingle of an item
of that length, at whatever place (a window without a common shingle has similarity 0). A document of fewer words than the item is one
window as a whole. A shingle is a run of five words (lower-cased, split at white space); an item of fewer words is one shingle as a
whole; an item without words matches nothing.

Candidates: a window's 128-bit SimHash (rolling sums of its shingles' signs, weighted by the square root of their weight, so that the
expected share of equal bits follows a cosine that is never below the similarity when no shingle repeats) is looked up among the items
of its length in multi-index Hamming blocks: eight blocks of 16 bits. If the whole distance is at most RADIUS, some block's distance is
at most that block's share of it; the index holds every item under all values within half of that share and the window asks for all
values within the other half, so every item within the radius is found, and only those go on. At similarity 0.8 exactly the distance
is 26.2 +- 4.6 on average, RADIUS is 2.9 of these deviations above it (99.8 %), and two unrelated texts are 64 +- 5.7 apart.

Verification: 2 * common / (window + item) (Dice) over the shingles, with their counts, at least 0.8. A shingle of the item weighs
1 + ln(items / items that hold it), any other shingle 1 + ln(items). Weights are counted over the whole benchmark, in whole numbers, so
results depend neither on the order of sums nor on BLOCK_ITEMS.

Documents stay where they are: no shuffle. The benchmark is worked on in blocks of BLOCK_ITEMS items and BLOCK_BYTES bytes at most (one
longer item is a block of its own), each broadcast for a pass of its own, so a benchmark of any size is covered. For fingerprints,
holders of shared shingles go along as a table of at most SHARED entries (the most holders of each hash value).

Defined results: null or empty documents match nothing; an empty document table gives no rows; very long texts are windows like any
other, worked on one text at a time; repeated rows are judged each, repeated items too; of equally similar windows the first is reported;
an empty benchmark finds nothing; other columns are ignored.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common
from stringloom.llm.words import Words, mix, run_hash, slices

SHINGLE, PERCENT, RADIUS = 5, 80, 39
THRESHOLD = PERCENT / 100
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 8_000_000
#: Entries of the table of shared shingles' holders, by hash.
SHARED = 1 << 20
PARTS = 8
#: Weights are whole multiples of 1 / UNIT.
UNIT = 1 << 16
#: Places whose signs are summed at once, and windows looked up at once.
PLACES, ASKED = 1 << 16, 2048
_SIEVE = 1 << 22
_PROBE = 1 << 20
_VALUES = np.arange(1 << 16, dtype=np.uint16)


def ball(radius: int) -> np.ndarray:
    """All 16-bit values with at most so many ones."""
    return _VALUES[np.bitwise_count(_VALUES) <= radius]


def block_radii(radius: int) -> list[int]:
    """The radius of each block: if every block were further off, the whole distance would exceed `radius`."""
    share, rest = divmod(radius, PARTS)
    return [share] * (rest + 1) + [share - 1] * (PARTS - rest - 1)


def weigh(items: int, holders) -> np.ndarray:
    return np.rint(UNIT * (1 + np.log(np.maximum(1, items) / np.asarray(holders, np.float64)))).astype(np.int64)


def _sign_sums(hashes: np.ndarray, weights: np.ndarray, part: int) -> np.ndarray:
    """Running sums of the signs of the 16 bits of one block, before each place and after the last."""
    source = hashes if part < PARTS // 2 else mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    bits = (source[:, None] >> (np.uint64(16 * (part % (PARTS // 2))) + np.arange(16, dtype=np.uint64))) & np.uint64(1)
    out = np.zeros((len(hashes) + 1, 16), np.int64)
    np.cumsum((bits.astype(np.int64) * 2 - 1) * weights[:, None], axis=0, out=out[1:])
    return out


def fingerprints(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(runs, PARTS) of 16 bits: the SimHash of each run [begin, end) of places."""
    out = np.zeros((len(begin), PARTS), np.uint16)
    power = (np.uint16(1) << np.arange(16, dtype=np.uint16)).astype(np.int64)
    for part in range(PARTS):
        sums = _sign_sums(hashes, weights, part)
        out[:, part] = ((sums[end] - sums[begin] > 0) * power).sum(axis=1)
    return out


class Items:
    """A block of benchmark items: places of their shingles by length, weights, fingerprints and Hamming blocks.

    shingles: hashes of each item's runs of min(5, words) words, in order; holders: items of the whole benchmark that hold each;
    shared: (entries, holders) of the table of shared shingles; n_items: items with words in the whole benchmark.
    """

    def __init__(self, ids: list[int], lengths: list[int], shingles: list[np.ndarray], holders: list[np.ndarray], n_items: int, shared=None, radius: int = RADIUS):
        self.ids, self.radius, self.n_items = ids, radius, n_items
        self.length = np.asarray(lengths, np.int64)
        self.most = int(weigh(n_items, [1])[0]) if n_items else UNIT
        self.holders = np.ones(SHARED, np.int32)
        if shared is not None:
            self.holders[shared[0]] = shared[1]
        #: words of the items, ascending; an item's group is the place of its number of words
        self.sizes = np.unique(self.length[self.length > 0])
        self.group = np.searchsorted(self.sizes, self.length)
        self.weight = [dict(zip(h.tolist(), weigh(n_items, c).tolist())) for h, c in zip(shingles, holders)]
        self.bags: list[dict[int, int]] = []
        for h in shingles:
            names, counts = np.unique(h, return_counts=True)
            self.bags.append(dict(zip(names.tolist(), counts.tolist())))
        self.mass = [sum(c * w[h] for h, c in bag.items()) for bag, w in zip(self.bags, self.weight)]
        #: words of a shingle -> (its hashes, where each one's groups begin, groups)
        self.by_words: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sieve: dict[int, np.ndarray] = {}
        for k in {min(SHINGLE, n) for n in self.length.tolist() if n}:
            mine = [i for i, n in enumerate(self.length.tolist()) if n and min(SHINGLE, n) == k]
            pairs = np.unique(np.stack([np.concatenate([shingles[i] for i in mine]), np.concatenate([np.full(len(shingles[i]), self.group[i], np.uint64) for i in mine])], 1), axis=0)
            names, first = np.unique(pairs[:, 0], return_index=True)
            self.by_words[k] = names, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
            self.sieve[k] = np.zeros(_SIEVE, bool)
            self.sieve[k][names & np.uint64(_SIEVE - 1)] = True
        real = [i for i, n in enumerate(self.length.tolist()) if n]
        self.prints = np.zeros((len(ids), PARTS), np.uint16)
        for i in real:
            self.prints[i] = fingerprints(shingles[i], self.print_weights(shingles[i]), np.array([0]), np.array([len(shingles[i])]))[0]
        self._index(np.array(real, np.int64))

    def print_weights(self, hashes: np.ndarray) -> np.ndarray:
        return np.rint(64 * np.sqrt(weigh(self.n_items, self.holders[hashes & np.uint64(SHARED - 1)]) / UNIT)).astype(np.int64)

    def _index(self, real: np.ndarray) -> None:
        """For each block: the items under every value within half of the block's radius, sorted by group and value."""
        self.blocks = []
        for part, radius in enumerate(block_radii(self.radius)):
            if radius < 0:
                self.blocks.append(None)
                continue
            near = ball(radius // 2)
            key = (self.group[real].astype(np.int64)[:, None] << 16 | (self.prints[real, part][:, None] ^ near[None])).reshape(-1)
            order = np.argsort(key, kind="stable")
            there = np.zeros(_PROBE, bool)
            there[self._probe(key)] = True
            self.blocks.append((key[order], np.repeat(real, len(near))[order], ball(radius - radius // 2), there))

    @staticmethod
    def _probe(key: np.ndarray) -> np.ndarray:
        return (key + (key >> 16) * 0x9E37) & (_PROBE - 1)

    def in_blocks(self, prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of equal group of which some block is near enough."""
        found = [np.zeros(0, np.int64)]
        n = len(self.ids)
        for block, value in zip(self.blocks, prints.T):
            if block is None:
                continue
            keys, items, masks, there = block
            for lo in range(0, len(group), ASKED):
                asked = (group[lo : lo + ASKED, None] << 16) | (value[lo : lo + ASKED, None] ^ masks[None]).astype(np.int64)
                row, column = np.nonzero(there[self._probe(asked)])
                key = asked[row, column]
                first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                count = last - first
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                found.append(np.unique((np.repeat(row, count) + lo) * n + items[at]))
        both = np.unique(np.concatenate(found))
        return both // max(1, n), both % max(1, n)

    def near(self, prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all items of the window's group within the radius."""
        window, item = self.in_blocks(prints, group)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64).sum(axis=1)
        keep = distance <= self.radius
        return window[keep], item[keep], distance[keep]


def shingles_of(text: str) -> tuple[int, np.ndarray]:
    """(words, hashes of the runs of five words, or of all words if there are fewer, in order)."""
    words = Words(pa.array([text], pa.string()))
    n = len(words.hash)
    return n, mix(run_hash(words.hash, min(SHINGLE, n))) if n else np.zeros(0, np.uint64)


def items_of(ids: list[int], texts: list[str], radius: int = RADIUS) -> Items:
    """Items of a benchmark that is one block."""
    made = [shingles_of(t or "") for t in texts]
    every = np.concatenate([np.unique(h) for _, h in made] or [np.zeros(0, np.uint64)])
    names, counts = np.unique(every, return_counts=True)
    holders = [counts[np.searchsorted(names, h)] for _, h in made]
    return Items(ids, [n for n, _ in made], [h for _, h in made], holders, sum(n > 0 for n, _ in made), _table(names, counts), radius)


def _table(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, most holders) of the shingles that several items hold."""
    shared = counts > 1
    table = np.zeros(SHARED, np.int64)
    np.maximum.at(table, (names[shared] & np.uint64(SHARED - 1)).astype(np.int64), counts[shared])
    at = np.flatnonzero(table)
    return at, table[at]


def _windows(words: Words, items: Items, k: int, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, group) of all windows that hold a shingle of an item of their group; at, h: the texts' runs of k words."""
    names, first, groups = items.by_words[k]
    hit = np.flatnonzero(items.sieve[k][h & np.uint64(_SIEVE - 1)])
    place = np.minimum(np.searchsorted(names, h[hit]), len(names) - 1)
    real = names[place] == h[hit]
    hit, place = hit[real], place[real]
    count = first[place + 1] - first[place]
    group = groups[np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    word = at[np.repeat(hit, count)]
    doc = words.doc[word]
    lo, hi, n = words.first[doc], words.first[doc + 1], items.sizes[group]
    short = hi - lo < n
    begin = np.where(short, lo, np.maximum(lo, word + k - n))
    end = np.where(short, lo, np.minimum(word, hi - n))
    # overlapping ranges of starts become one before they are written out
    wide = np.int64(len(words.hash) + 1)
    order = np.argsort(group * wide + begin, kind="stable")
    group, begin, end = group[order], begin[order], end[order]
    reach = np.maximum.accumulate(group * wide + end) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = (group * wide + begin)[1:] > reach[:-1]
    cut = np.flatnonzero(new)
    if not len(cut):
        return begin, begin, group
    last = np.maximum.reduceat(end, cut)
    count = last - begin[cut] + 1
    start = np.repeat(begin[cut] - np.cumsum(count) + count, count) + np.arange(count.sum())
    group = np.repeat(group[cut], count)
    doc = words.doc[start]
    size = np.minimum(items.sizes[group], words.first[doc + 1] - words.first[doc])
    return start, size, group


def _prints(items: Items, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of places, of which only those inside some run are summed, some PLACES at a time."""
    inside = np.cumsum(np.bincount(begin, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1))[: len(h)] > 0
    narrow = np.concatenate([[0], np.cumsum(inside)])
    h, begin, end = h[inside], narrow[begin], narrow[end]
    weights = items.print_weights(h)
    out = np.zeros((len(begin), PARTS), np.uint16)
    order = np.argsort(begin, kind="stable")
    lo = 0
    while lo < len(order):
        base = begin[order[lo]]
        hi = max(lo + 1, int(np.searchsorted(begin[order], base + PLACES // 2, "right")))
        mine = order[lo:hi]
        top = end[mine].max()
        out[mine] = fingerprints(h[base:top], weights[base:top], begin[mine] - base, end[mine] - base)
        lo = hi
    return out


def _similar(items: Items, item: int, h: np.ndarray, begin: list[int], end: list[int]):
    """(common, whole) weights, as whole numbers, of each of the ascending runs of places with an item, by moving along them."""
    bag, weight, most, mass = items.bags[item], items.weight[item], items.most, items.mass[item]
    base = begin[0]
    names = h[base : max(end)].tolist()
    counts: dict[int, int] = {}
    both = total = 0
    lo = hi = base
    for a, b in zip(begin, end):
        if a >= hi:
            counts, both, total, lo, hi = {}, 0, 0, a, a
        while hi < b:
            x = names[hi - base]
            hi += 1
            if x in bag:
                w, c = weight[x], counts.get(x, 0) + 1
                counts[x] = c
                total += w
                both += w if c <= bag[x] else 0
            else:
                total += most
        while lo < a:
            x = names[lo - base]
            lo += 1
            if x in bag:
                w, c = weight[x], counts[x]
                counts[x] = c - 1
                total -= w
                both -= w if c <= bag[x] else 0
            else:
                total -= most
        yield both, total + mass


def leaks(texts: pa.Array, items: Items) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item's place, similarity, first word, words, distance of fingerprints) of the best window for each row and item."""
    words = Words(texts)
    out = []
    for k in sorted(items.by_words):
        at, h = words.shingles(k)
        start, size, group = _windows(words, items, k, at, h)
        if not len(start):
            continue
        begin, end = np.searchsorted(at, start), np.searchsorted(at, start + size - k, "right")
        prints = _prints(items, h, begin, end)
        window, item, distance = items.near(prints, group)
        doc = words.doc[start[window]]
        order = np.lexsort((start[window], item, doc))
        window, item, distance, doc = window[order], item[order], distance[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else np.zeros(0, np.int64)
        for lo, hi in zip(new, [*new[1:], len(doc)]):
            mine = window[lo:hi]
            best = None
            for j, (both, whole) in enumerate(_similar(items, int(item[lo]), h, begin[mine].tolist(), end[mine].tolist())):
                if 200 * both >= PERCENT * whole and (best is None or both * best[1] > best[0] * whole):
                    best = both, whole, lo + j
            if best is not None:
                w = window[best[2]]
                out.append((int(doc[lo]), int(item[lo]), 2 * best[0] / best[1], int(start[w] - words.first[doc[lo]]), int(size[w]), int(distance[best[2]])))
    return out


SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long, hamming int"


def _find(block):
    @common.freeing
    def run(batches):
        items = Items(*block.value)
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            doc_ids = batch.column(batch.schema.names.index("doc_id"))
            rows = [(lo + row, *rest) for lo, hi in slices(column) for row, *rest in leaks(column.slice(lo, hi - lo), items)]
            take = doc_ids.take(pa.array([r[0] for r in rows], pa.int64()))
            cols = [take, pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4)), pa.array([r[5] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "similarity", "first_word", "n_words", "hamming"])

    return run


def _drop(block):
    @common.freeing
    def run(batches):
        items = Items(*block.value)
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in slices(column):
                for row, *_ in leaks(column.slice(lo, hi - lo), items):
                    keep[lo + row] = False
            yield batch.filter(pa.array(keep))

    return run


@common.freeing
def _shingled(batches):
    for batch in batches:
        made = [shingles_of(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([h.view(np.int64) for _, h in made], pa.list_(pa.int64()))], names=["item_id", "n", "h"]
        )


def _blocks(benchmark: DataFrame):
    """Broadcasts of bounded blocks of the benchmark; every item with words is in one. Holders are counted over all items first."""
    spark = benchmark.sparkSession
    made = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_shingled, "item_id long, n long, h array<long>").where("n > 0")
    made = common.stage(made.withColumn("row", F.monotonically_increasing_id()), "items")
    sets = made.select("row", F.explode(F.array_distinct("h")).alias("s"))
    counts = sets.groupBy("s").agg(F.count("*").alias("c"))
    counts = common.stage(counts.where("c > 1"), "holders")
    entry = F.col("s").bitwiseAND(F.lit(SHARED - 1)).cast("int")
    table = counts.groupBy(entry.alias("e")).agg(F.max("c").alias("c")).toPandas()  # at most SHARED rows
    shared = table["e"].to_numpy(np.int64), table["c"].to_numpy(np.int64)
    held = sets.join(counts, "s").groupBy("row").agg(F.collect_list(F.struct("s", "c")).alias("held"))  # of one item's shingles
    n_items = made.count()
    block: list[tuple] = []
    size = 0

    def give():
        ids, lengths, shingles, holders = (list(x) for x in zip(*block))
        return spark.sparkContext.broadcast((ids, lengths, shingles, holders, n_items, shared))

    for row in made.join(held, "row", "left").orderBy("item_id", "row").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + 8 * len(row["h"]) > BLOCK_BYTES):
            yield give()
            block, size = [], 0
        h = np.array(row["h"], np.int64)
        of = {r["s"]: r["c"] for r in row["held"] or ()}
        block.append((row["item_id"], row["n"], h.view(np.uint64), np.array([of.get(s, 1) for s in h.tolist()], np.int64)))
        size += 8 * len(h)
    if block:
        yield give()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item of which it holds a window."""
    docs = docs.select("doc_id", "text")
    found = None
    for block in _blocks(benchmark):
        part = docs.mapInArrow(_find(block), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all columns, without the documents that hold an item."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_drop(block), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
