"""Operator 8: an Elias-Fano n-gram trie, built and queried where the data are.

Tokens: words (A-Z lower-cased, runs of anything but ASCII white space), then one end token. Training texts: crc32(doc_id as text) mod 10 is not 0.

Model: P(w | v) = max(c(v w) - D, 0) / C(v) + L(v) * U(w), U(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), for pairs seen at least min_pair times:
the query keeps every pair (min_pair = 1), train() alone those seen MIN_PAIR times unless told otherwise;
L(v) is what the discounted pairs of v leave over, so the probabilities of a context sum to 1 (up to quantising). The context of the first
word is a begin token, seen once a text. Unknown contexts: L = 1.

Trie, as files of the shared folder that workers map into memory:
  level 1: the words' 64-bit hashes in ascending order in Elias-Fano form (low bits as a plain array, high bits as a bit vector with
           counts of zeros per 64 bits); a word's id is its place. Beside it the counts.
  level 2: a word's followers, as ids, made ascending over the whole level by adding the context's place times the number of ids: pointers
           to a context's first follower and the followers themselves are both in Elias-Fano form; for each follower a byte, the
           quantised logarithm of max(c - D, 0) / C; for each context a byte, the quantised logarithm of L.
A pair is looked up by successor search among the context's followers, for all pairs of a batch of texts at once.

Building: word counts are merged per hash range and pair counts per range of (context, follower), both counted in the task first and
sent as sorted arrays; ranges are cut so that they hold equally many tokens, also within one context, so a hot word is the work of many
tasks. No count, word or pair passes through the driver: only each shard's size and its outermost contexts do. Every shard is a file that its task
writes under another name and renames, so a task may run again. What is gathered and stored grows with the corpus; the files are
mapped, not loaded, so a worker needs memory only for the pages it uses.

Defined results: null and empty texts have the end token alone; rows are scored each, repeated or not, and each training row counts;
a null doc_id counts as empty text; without training texts N = V = 0 and every token scores log10(1).
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common
from stringloom.llm.files import get, pack, put, unpack
from stringloom.llm.words import Words, mix, slices

FOLDS, DISCOUNT, MIN_PAIR, ALPHA = 10, 0.5, 2, 0.1
#: Tokens of a shard, on average: the number of shards follows the corpus.
SHARD_WORDS, SHARD_PAIRS = 8_000_000, 8_000_000
#: Distinct keys that a task gathers before it sends them.
HELD = 3_000_000
END = int(mix(np.array([0xE0D], np.uint64))[0])
#: The byte b stands for 10 ** (-b / STEP).
STEP = 28.0
#: L is at least this (its byte is four times as fine and ends a little below).
LEAST = 0.01


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """Ascending unsigned 64-bit values; find(): places of values, or -1."""

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, min(32, (top // max(1, n)).bit_length()))
        while n and (top >> low) > 4 * n + 64:
            low += 1
        # bucket h's members stand as ones before the h-th zero
        high = (values >> np.uint64(low)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view("<u8")
        zeros = np.zeros(len(words) + 1, np.uint32)
        np.cumsum(64 - np.bitwise_count(words).astype(np.int64), out=zeros[1:])
        dtype = "<u8" if low > 32 else "<u4" if low > 16 else "<u2"
        mask = np.uint64((1 << low) - 1)
        return {prefix + "low": (values & mask).astype(dtype), prefix + "high": words, prefix + "zeros": zeros, prefix + "meta": np.array([low, n, int(high[-1]) if n else -1], "<i8")}

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.low, self.high, self.zeros = (arrays[prefix + x] for x in ("low", "high", "zeros"))
        self.bits, self.n, self.last = (int(x) for x in arrays[prefix + "meta"])

    def _before(self, h: np.ndarray) -> np.ndarray:
        """Members of buckets below h."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        k = h[some] - 1  # the k-th zero closes bucket k
        w = np.searchsorted(self.zeros, k, "right") - 1
        inside = k - self.zeros[w].astype(np.int64)
        word = ~np.asarray(self.high[w])
        at = np.zeros(len(k), np.int64)
        left = inside
        for width in (32, 16, 8, 4, 2, 1):  # the place of the inside-th zero of the word
            part = word & np.uint64((1 << width) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            go = left >= c
            left = np.where(go, left - c, left)
            at += np.where(go, width, 0)
            word = np.where(go, word >> np.uint64(width), part)
        out[some] = w * 64 + at - k
        return out

    def value(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: the place of the i-th one among the high bits, less i, is its bucket."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        w = np.searchsorted(ones, i, "right") - 1
        left, word, at = i - ones[w], np.asarray(self.high[w]), np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = word & np.uint64((1 << width) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            go = left >= c
            left = np.where(go, left - c, left)
            at += np.where(go, width, 0)
            word = np.where(go, word >> np.uint64(width), part)
        high = (w * 64 + at - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.low[i].astype(np.uint64)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Places of the values, or -1; begin and stop: the places among which each may stand."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        h = (values >> np.uint64(self.bits)).astype(np.int64)
        can = np.flatnonzero(h <= self.last)
        h, want = h[can], (values[can] & np.uint64((1 << self.bits) - 1))
        lo = self._before(h)
        hi = self._before(h + 1)
        if begin is not None:
            lo, hi = np.maximum(lo, begin[can]), np.minimum(hi, stop[can])
            hi = np.maximum(lo, hi)
        end = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:  # the successor among the bucket's members
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.low[middle].astype(np.uint64) < want[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        hit = lo < end
        hit[hit] = self.low[lo[hit]].astype(np.uint64) == want[hit]
        out[can[hit]] = lo[hit]
        return out


# ---------------------------------------------------------------- counting


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, whether it begins a text) of all tokens, an end token after each text."""
    words = Words(texts)
    n = words.n
    hashes = np.full(len(words.hash) + n, END, np.uint64)
    at = np.arange(len(words.hash)) + words.doc
    hashes[at] = words.hash
    doc = np.empty(len(hashes), np.int64)
    doc[at] = words.doc
    ends = words.first[1:] + np.arange(n)
    doc[ends] = np.arange(n)
    begins = np.zeros(len(hashes), bool)
    begins[words.first[:-1] + np.arange(n)] = True
    return hashes, doc, begins


def _held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in ids.to_pylist()], bool)


class Counter:
    """Counts 64-bit keys; give() empties it."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.n += len(keys)

    def give(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        self.parts, self.n = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[new], np.add.reduceat(counts, new) if len(new) else counts


SENT = "shard long, data binary"


def _send(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray):
    """Rows (shard, sorted keys and counts): distances of keys and counts, compressed."""
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    shards, data = [], []
    for lo, hi in zip(cuts, [*cuts[1:], len(shard)]):
        k = keys[lo:hi]
        gap = np.diff(k, prepend=np.uint64(0))
        wide = np.flatnonzero(gap >> np.uint64(40))  # distances of more than five bytes (the first, as a rule) go apart
        short = gap.copy()
        short[wide] = 0
        five = short.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
        data.append(pack({"five": np.frombuffer(five, np.uint8), "wide": wide, "far": gap[wide], "c": np.frombuffer(zlib.compress(counts[lo:hi].astype("<i8").tobytes(), 1), np.uint8)}, n=int(hi - lo)))
        shards.append(int(shard[lo]))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(data, pa.binary())], names=["shard", "data"])


def _received(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, head = unpack(np.frombuffer(data, np.uint8))
    n = head["n"]
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :5] = a["five"].reshape(5, n).T
    gap = gap.reshape(-1).view("<u8").copy()
    gap[a["wide"]] = a["far"]
    return np.cumsum(gap, dtype=np.uint64), np.frombuffer(zlib.decompress(a["c"].tobytes()), "<i8")


def _count(keys_of, shard_of):
    """mapInArrow: doc_id and text to the counted keys of training texts, by shard."""

    @common.freeing
    def run(batches):
        counter = Counter()
        for batch in batches:
            names = batch.schema.names
            ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
            train = pa.array(~_held_out(ids))
            texts = texts.filter(train)
            for lo, hi in slices(texts):
                counter.add(keys_of(texts.slice(lo, hi - lo)))
                if counter.n > HELD:
                    keys, counts = counter.give()
                    counter.add(keys, counts)
                    if counter.n > HELD // 2:
                        keys, counts = counter.give()
                        yield _send(keys, counts, shard_of(keys))
        keys, counts = counter.give()
        if len(keys):
            yield _send(keys, counts, shard_of(keys))

    return run


def _merge(build, schema_names):
    """mapInArrow over rows sorted by shard: merge each shard's arrays and hand them to build(shard, keys, counts), which gives a row."""

    @common.freeing
    def run(batches):
        counter, now = Counter(), None
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and shard != now:
                    yield _row(build(now, *counter.give()), schema_names)
                now = shard
                counter.add(*_received(data.as_py()))
                if len(counter.parts) > 12:
                    counter.add(*counter.give())
        if now is not None:
            yield _row(build(now, *counter.give()), schema_names)

    return run


def _row(values, names):
    return pa.RecordBatch.from_arrays([pa.array([v], pa.float64() if isinstance(v, float) else pa.int64()) for v in values], names=names)


# ---------------------------------------------------------------- model


class Vocabulary:
    """Level 1: shards in hash order; first[i]: the id of shard i's first word."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return {"folder": self.folder, "sizes": self.sizes}

    def __setstate__(self, state):
        self.__init__(**state)

    def shard(self, s: int):
        if s not in self._open:
            a, _ = unpack(get(f"{self.folder}/words-{s}"))
            self._open[s] = (EliasFano(a, "h"), a["c"], a["before"])
        return self._open[s]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens of words with smaller ids) of sorted hashes."""
        ids, counts, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        n = len(self.sizes)
        shard = hash_shard(hashes, n)
        cuts = np.searchsorted(shard, np.arange(n + 1))
        for s in range(n):
            lo, hi = cuts[s], cuts[s + 1]
            if hi > lo and self.sizes[s]:
                words, c, b = self.shard(s)
                at = words.find(hashes[lo:hi] - shard_start(s, n))
                hit = np.flatnonzero(at >= 0)
                ids[lo + hit] = at[hit] + self.first[s]
                counts[lo + hit] = c[at[hit]]
                before[lo + hit] = b[at[hit]]
        return ids, counts, before


def hash_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def shard_start(s: int, n: int) -> np.uint64:
    return np.uint64(-(-(s << 32) // n) << 32)


def pair_shard(ctx: np.ndarray, word: np.ndarray, before: np.ndarray, count: np.ndarray, n_words: int, total: int, n: int) -> np.ndarray:
    """The range of a pair: the place, among all tokens in order of their ids, where the context's share for that follower stands."""
    place = before + count * (word / max(1, n_words))
    return np.minimum(n - 1, (place * (n / max(1, total))).astype(np.int64))


class Model:
    def __init__(self, folder: str, vocabulary: Vocabulary, total: int, texts: int, pair_shards: int, shard_totals: list[int], min_pair: int = MIN_PAIR):
        self.folder, self.vocabulary, self.total, self.texts, self.pair_shards, self.min_pair = folder, vocabulary, total, texts, pair_shards, min_pair
        #: tokens of words in earlier hash shards
        self.shard_totals = shard_totals
        self.n_words = int(vocabulary.first[-1])
        self.left: dict[int, float] = {}  # L of each pair shard's first and last context: only they can reach into other shards
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def ids(self, hashes: np.ndarray):
        """(id or -1, count, tokens before) of tokens' hashes; the begin token has the id n_words."""
        names, at = np.unique(hashes, return_inverse=True)
        ids, counts, before = self.vocabulary.look_up(names)
        before = before + np.asarray(self.shard_totals, np.int64)[hash_shard(names, len(self.vocabulary.sizes))]
        return ids[at], counts[at], before[at]

    def pairs_of(self, texts: pa.Array):
        """Per token: text, id, count, and its context's id, count and tokens before."""
        hashes, doc, begins = _tokens(texts)
        ids, counts, before = self.ids(hashes)
        ctx, c_ctx, b_ctx = np.empty_like(ids), np.empty_like(counts), np.empty_like(before)
        ctx[1:], c_ctx[1:], b_ctx[1:] = ids[:-1], counts[:-1], before[:-1]
        ctx[begins], c_ctx[begins], b_ctx[begins] = self.n_words, self.texts, self.total
        return doc, ids, counts, ctx, c_ctx, b_ctx

    def shard_of(self, ctx, word, c_ctx, b_ctx):
        return pair_shard(ctx, word, b_ctx, c_ctx, self.n_words, self.total + self.texts, self.pair_shards)

    def shard(self, s: int):
        if s not in self._open:
            try:
                a, _ = unpack(get(f"{self.folder}/pairs-{s}"))
                self._open[s] = (EliasFano(a, "ctx"), EliasFano(a, "ptr"), EliasFano(a, "key"), a["p"], a["left"])
            except FileNotFoundError:
                self._open[s] = None
        return self._open[s]

    def log10(self, texts: pa.Array):
        """(tokens, known tokens, base log10, model log10) of each text."""
        doc, counts, base, score = self.tokens_log10(texts)
        n = len(texts)
        return np.bincount(doc, minlength=n), np.bincount(doc[counts > 0], minlength=n), np.bincount(doc, base, n), np.bincount(doc, score, n)

    def tokens_log10(self, texts: pa.Array):
        """(text, count, base log10, model log10) of each token, the ends included."""
        doc, ids, counts, ctx, c_ctx, b_ctx = self.pairs_of(texts)
        u = (counts + ALPHA) / (self.total + ALPHA * (self.n_words + 1))
        left, seen = np.ones(len(ids)), np.zeros(len(ids))
        can = np.flatnonzero(ctx >= 0)
        if len(can) and self.pair_shards:
            width = np.uint64(self.n_words + 1)
            key = ctx[can].astype(np.uint64) * width + np.maximum(ids[can], 0).astype(np.uint64)
            shard = self.shard_of(ctx[can], np.maximum(ids[can], 0), c_ctx[can], b_ctx[can])
            order = np.lexsort((key, shard))
            s_sorted, k_sorted = shard[order], key[order]
            cuts = np.searchsorted(s_sorted, np.arange(self.pair_shards + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[s] : cuts[s + 1]]
                level = self.shard(s)
                if level is None:
                    continue
                contexts, pointers, followers, p, l = level
                keys = k_sorted[cuts[s] : cuts[s + 1]]
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
                back = np.cumsum(new) - 1
                keys = keys[new]
                c = keys // width
                cnew = np.concatenate([[True], c[1:] != c[:-1]])
                names = contexts.find(c[cnew])
                known = np.flatnonzero(names >= 0)
                first, last = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                first[known], last[known] = pointers.value(names[known]), pointers.value(names[known] + 1)
                of = np.cumsum(cnew) - 1
                place, first, last = names[of], first[of], last[of]
                has = np.flatnonzero(place >= 0)
                lv, sv = np.ones(len(keys)), np.zeros(len(keys))
                lv[has] = 10.0 ** (-l[place[has]].astype(float) / (4 * STEP))
                found = followers.find((place[has].astype(np.uint64)) * width + keys[has] % width, first[has], last[has])
                ok = found >= 0
                sv[has[ok]] = 10.0 ** (-p[found[ok]].astype(float) / STEP)
                left[can[at]], seen[can[at]] = lv[back], sv[back]
            seen[ids < 0] = 0
            if self.left:
                many = np.fromiter(self.left, np.int64, len(self.left))
                value = np.fromiter(self.left.values(), float, len(self.left))
                order = np.argsort(many)
                many, value = many[order], value[order]
                at = np.minimum(np.searchsorted(many, ctx), len(many) - 1)
                hit = many[at] == ctx
                left[hit] = value[at[hit]]
        return doc, counts, np.log10(u), np.log10(seen + left * u)


def _write_words(folder: str, n_shards: int):
    def build(shard, keys, counts):
        before = np.cumsum(counts) - counts
        arrays = EliasFano.build(keys - shard_start(shard, n_shards), "h") | {"c": counts.astype("<u4") if counts.max() < 2**32 else counts, "before": before}
        put(f"{folder}/words-{shard}", pack(arrays))
        return shard, len(keys), int(counts.sum())

    return build


def quantise(x: np.ndarray, step: float) -> np.ndarray:
    """Rounded down in value, so that a context's probabilities never sum to more than 1."""
    return np.clip(np.ceil(-np.log10(np.maximum(x, 1e-300)) * step - 1e-9), 0, 255).astype(np.uint8)


def _write_pairs(folder: str, model: Model, counts_of):
    """Level 2 of one range. Its first and last context may go on in the next range: what they leave over is put together later."""

    def build(shard, keys, counts):
        keep = counts >= model.min_pair
        keys, counts = keys[keep], counts[keep]
        width = np.uint64(model.n_words + 1)
        if not len(keys):
            return shard, 0, -1, 0.0, -1, 0.0
        ctx = (keys // width).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        names = ctx[begin]
        total = counts_of(names).astype(np.float64)
        place = np.cumsum(np.concatenate([[False], ctx[1:] != ctx[:-1]]))
        share = (counts - DISCOUNT) / total[place]
        bytes_ = quantise(share, STEP)
        used = np.add.reduceat(10.0 ** (-bytes_.astype(float) / STEP), begin)  # of the quantised values: L gets all that they leave
        full = used > 1 - LEAST  # L's byte ends at LEAST: one step less for each follower makes room
        bytes_ = np.minimum(255, bytes_ + full[place]).astype(np.uint8)
        used = np.add.reduceat(10.0 ** (-bytes_.astype(float) / STEP), begin)
        arrays = EliasFano.build(names.astype(np.uint64), "ctx") | EliasFano.build(place.astype(np.uint64) * width + keys % width, "key")
        arrays |= EliasFano.build(np.append(begin, len(keys)).astype(np.uint64), "ptr")
        arrays |= {"p": bytes_, "left": quantise(np.clip(1 - used, LEAST, 1), 4 * STEP)}
        put(f"{folder}/pairs-{shard}", pack(arrays))
        return shard, len(keys), int(names[0]), float(used[0]), int(names[-1]), float(used[-1])

    return build


class _Counts:
    """Counts of context ids, from the vocabulary's files."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        v = self.model.vocabulary
        out = np.full(len(ids), self.model.texts, np.int64)
        shard = np.searchsorted(v.first, ids, "right") - 1
        for s in np.unique(shard):
            if s < len(v.sizes):
                at = np.flatnonzero(shard == s)
                out[at] = v.shard(int(s))[1][ids[at] - v.first[s]]
        return out


def _pair_keys(model: Model):
    width = np.uint64(model.n_words + 1)

    def keys(texts):
        _, ids, counts, ctx, c_ctx, _ = model.pairs_of(texts)
        can = (c_ctx >= model.min_pair) & (counts >= model.min_pair)  # others can't be seen often enough together
        return ctx[can].astype(np.uint64) * width + ids[can].astype(np.uint64)

    return keys


def _pair_shards(model: Model):
    width = np.uint64(model.n_words + 1)

    def shard(keys):
        ctx, word = (keys // width).astype(np.int64), (keys % width).astype(np.int64)
        names, at = np.unique(ctx, return_inverse=True)
        c, b = _Counts(model)(names), _before(model, names)
        return model.shard_of(ctx, word, c[at], b[at])

    return shard


def _before(model: Model, ids: np.ndarray) -> np.ndarray:
    v = model.vocabulary
    out = np.full(len(ids), model.total, np.int64)
    shard = np.searchsorted(v.first, ids, "right") - 1
    for s in np.unique(shard):
        if s < len(v.sizes):
            at = np.flatnonzero(shard == s)
            out[at] = v.shard(int(s))[2][ids[at] - v.first[s]] + model.shard_totals[s]
    return out


def _word_keys(texts):
    return _tokens(texts)[0]


def train(docs: DataFrame, folder: str, min_pair: int = MIN_PAIR) -> Model:
    """Build the trie of docs (doc_id, text) in folder, of the pairs seen at least min_pair times."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((common.crc_of_id() % FOLDS != 0).cast("long")).alias("texts")).first()
    tokens = (size["bytes"] or 0) // 5  # a guess, for the number of shards alone
    n_words = max(1, -(-tokens // SHARD_WORDS))
    n_pairs = max(1, -(-tokens // SHARD_PAIRS))

    def merged(counted, n, build, names, types):
        parts = counted.repartitionByRange(min(n, 4 * common.partitions(spark)), "shard") if n > 1 else counted.coalesce(1)
        rows = parts.sortWithinPartitions("shard").mapInArrow(_merge(build, names), types)
        return {r["shard"]: r for r in common.stage(rows, "shards").toLocalIterator()}

    counted = common.stage(docs.mapInArrow(_count(_word_keys, lambda k: hash_shard(k, n_words)), SENT), "words")
    rows = merged(counted, n_words, _write_words(folder, n_words), ["shard", "n", "total"], "shard long, n long, total long")
    sizes = [rows[s]["n"] if s in rows else 0 for s in range(n_words)]
    totals = np.concatenate([[0], np.cumsum([rows[s]["total"] if s in rows else 0 for s in range(n_words)])]).astype(np.int64).tolist()
    vocabulary = Vocabulary(folder, sizes)
    model = Model(folder, vocabulary, totals[-1], int(size["texts"] or 0), n_pairs, totals[:-1], min_pair)
    counted = common.stage(docs.mapInArrow(_count(_pair_keys(model), _pair_shards(model)), SENT), "pair-counts")
    names = ["shard", "n", "first", "first_used", "last", "last_used"]
    rows = merged(counted, n_pairs, _write_pairs(folder, model, _Counts(model)), names, "shard long, n long, first long, first_used double, last long, last_used double")
    used: dict[int, list[float]] = {}
    for r in rows.values():
        for end in {("first", "first_used"), ("last", "last_used")} if r["first"] != r["last"] else {("first", "first_used")}:
            if r["n"]:
                used.setdefault(r[end[0]], []).append(r[end[1]])
    # also with pairs in one shard alone: the context's range may reach into a shard that holds none of them
    model.left = {c: max(LEAST, 1 - sum(u)) for c, u in used.items()}
    return model


def _score(model: Model):
    @common.freeing
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
            for lo, hi in slices(texts):
                n, known, base, score = model.log10(texts.slice(lo, hi - lo))
                part = ids.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(_held_out(part)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(hi - lo, model.total, np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    folder = f"{common.shared_dir(spark)}/{spark.sparkContext.applicationId}/lm-{uuid.uuid4().hex[:12]}"
    return score(docs, train(docs, folder, min_pair=1))
