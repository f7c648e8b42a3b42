"""Operator 10: byte-level BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling hash of the last eight bytes has its top bits clear, so equal passages get equal chunks wherever
they stand. A chunk is split at its first and last agreement points into head, core and tail. Cores are looked up by digest and encoded
once; the joins (tail of one chunk plus head of the next, or several chunks without an agreement point) are encoded again, growing
until both ends are agreement points.

An agreement point is a place after a character that isn't white space, before a single blank that another such character follows. The
tokenizer's splitter ends a piece there whatever stands around it, and special strings hold no blank, so the ids of a text are exactly
those of the stretches between agreement points, one after the other.

Cores and joins that stand more than once in the corpus are encoded once, in the whole cluster: the digests of all are counted (they alone
travel), the row with the least id that holds a shared one encodes it, and the ids go to files of the shared folder, by digest,
which all workers map into memory. What stands once is encoded where it is. Texts are never shuffled. Words, too, are remembered by a worker
(bounded in number), so that even new stretches seldom reach the library.

Defined results: null text counts as empty (0 ids, empty text back); repeated rows give a row each; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common
from stringloom.llm.files import get, pack, put, unpack
from stringloom.llm.words import slices

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A chunk ends on average after 2 ** CHUNK_BITS bytes.
CHUNK_BITS = 9
#: Pieces (words with their blank) whose ids a worker remembers: up to twice as many, the older half only until the next change.
MEMORY_PIECES = 150_000
#: Bytes of text worked on at once; a longer text is worked on alone.
PART_BYTES = 1 << 18
#: Stretches in a file of the store, about.
SHARD_STRETCHES = 500_000
_ODD = re.compile(r"\s\s|\s\Z|\x00")
#: A point or comma after something else than a letter or digit: it may belong to a longer run.
_PUNCTUATION = re.compile(r"[\W_][.,]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the content-defined chunks, in bytes; none inside a UTF-8 character."""
    n = len(data)
    if n <= 8:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    window = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(n - 7,), strides=(1,))
    ends = np.flatnonzero((window * _MULTIPLIER) >> np.uint64(64 - bits) == 0) + 8
    ends = ends[ends < n]
    return [int(e) for e in ends[(raw[ends] & 0xC0) != 0x80]] + [n]


class ChunkEncoder:
    """Encodes and decodes whole texts; ids are little-endian unsigned 32-bit."""

    def __init__(self, path: str = TOKENIZER, bits: int = CHUNK_BITS):
        self.path, self.bits = path, bits
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.reused = self.encoded = 0

    @cached_property
    def tokenizer(self):
        """Loaded when first asked for: cutting texts needs none."""
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], store: Store | None = None) -> list[bytes]:
        """The ids of whole texts: cut all, take what the store holds, encode the rest in one call, then put the parts together."""
        plans = [self.plan(t.encode()) for t in texts]
        ids = self.stretches({key: data for plan in plans for key, data in plan}, store)
        return [b"".join([ids[key] for key, _ in plan]) for plan in plans]

    def stretches(self, of: dict[bytes, bytes], store: Store | None = None) -> dict[bytes, bytes]:
        """The ids of stretches by digest."""
        out = store.ids(list(of)) if store is not None else {}
        self.reused += len(out)
        wanted: set[str] = set()
        parts: dict[bytes, list[str]] = {}
        for key, data in of.items():
            if key not in out:
                parts[key] = pieces = _pieces(data.decode())
                wanted.update(pieces)
        self.encoded += len(parts)
        if len(self.pieces) > MEMORY_PIECES:  # what was not asked for since the last time is forgotten
            self.older, self.pieces = self.pieces, {}
        new = []
        for piece in wanted.difference(self.pieces):
            ids = self.older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.pieces[piece] = ids
        self.pieces.update(zip(new, self.library(new)))
        for key, pieces in parts.items():
            out[key] = b"".join(map(self.pieces.__getitem__, pieces))
        return out

    def plan(self, data: bytes) -> list[tuple[bytes, bytes]]:
        """(digest, bytes) of the stretches that make up a text: cores, and joins that are encoded again as a whole."""
        out, open_, start = [], 0, 0  # open_: where the stretch that isn't settled yet begins
        for end in chunk_ends(data, self.bits):
            points = _agreement(data, start, end)
            start = end
            if points is None:
                continue
            first, last = points
            if first > open_:
                out.append(data[open_:first])
            if last > first:
                out.append(data[first:last])
            open_ = last
        if open_ < len(data):
            out.append(data[open_:])
        return [(hashlib.blake2b(x, digest_size=16).digest(), x) for x in out]

    def decode(self, all_ids: list[bytes]) -> list[str]:
        """Tokens stand for bytes, so the text is the tokens' bytes in order (special tokens: their strings); all texts are gathered at once."""
        if self.table is None:
            tokens = token_bytes(self.tokenizer)
            size = np.array([len(t) for t in tokens])
            self.table = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
        data, start, size = self.table
        ids = np.frombuffer(b"".join(all_ids), "<u4")
        lengths = size[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        body = data[np.arange(total) + np.repeat(start[ids] - ends + lengths, lengths)].tobytes()
        edge = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in all_ids)])].tolist()
        return [body[a:b].decode(errors="replace") for a, b in zip(edge[:-1], edge[1:])]


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    table = [b""] * (max([*tokenizer.get_vocab().values(), *special]) + 1)
    for token, i in tokenizer.get_vocab().items():
        table[i] = special[i] if i in special else bytes(of_char[c] for c in token)
    return table


def _pieces(text: str) -> list[str]:
    """A stretch cut where the splitter surely ends a piece: before a blank, around a line feed, between a letter or digit and a point or comma.

    That holds while no two white-space characters meet; a stretch with such runs stays whole, as does one that ends in white space.
    """
    if _ODD.search(text):
        return [text]
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    if not _PUNCTUATION.search(text):
        cut = cut.replace(".", "\0.").replace(",", "\0,")
    return cut.split("\0")


#: In bytes: only ASCII neighbours are taken, so that no byte of a longer white-space character is mistaken.
_POINT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_LAST = re.compile(rb".*[!-~](?= [!-~])", re.S)


def _agreement(data: bytes, start: int, end: int) -> tuple[int, int] | None:
    """The first and the last agreement point whose neighbours lie in data[start:end]."""
    part = data[start:end]
    first = _POINT.search(part)
    if first is None:
        return None
    return start + first.start(), start + _LAST.match(part).end()


class Store:
    """What the files of the shared folder hold: shared stretches (with the row that encodes them) and, once encoded, their ids."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self._open: dict[str, dict] = {}

    def __getstate__(self):
        return {"folder": self.folder, "shards": self.shards, "_open": {}}

    def _file(self, kind: str, shard: int) -> dict | None:
        name = f"{kind}-{shard}"
        if name not in self._open:
            try:
                self._open[name] = unpack(get(f"{self.folder}/{name}"))[0]
            except FileNotFoundError:
                self._open[name] = None
        return self._open[name]

    def _find(self, kind: str, keys: list[bytes]):
        """(place in keys, file, place in the file) of the keys that are held."""
        if not keys:
            return
        k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        order = np.argsort(k[:, 0], kind="stable")
        shard = _shard(k[order, 0], self.shards)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            held = self._file(kind, s)
            if held is None or not len(held["k1"]):
                continue
            at = order[cuts[s] : cuts[s + 1]]
            place = np.minimum(np.searchsorted(held["k1"], k[at, 0]), len(held["k1"]) - 1)
            hit = (held["k1"][place] == k[at, 0]) & (held["k2"][place] == k[at, 1])
            yield from zip(at[hit].tolist(), [held] * int(hit.sum()), place[hit].tolist())

    def ids(self, keys: list[bytes]) -> dict[bytes, bytes]:
        return {keys[i]: held["data"][held["at"][p] : held["at"][p + 1]].tobytes() for i, held, p in self._find("ids", keys)}

    def owners(self, keys: list[bytes]) -> dict[bytes, int]:
        return {keys[i]: int(held["owner"][p]) for i, held, p in self._find("shared", keys)}


def _shard(k1: np.ndarray, n: int) -> np.ndarray:
    return (((k1 >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _rows(batch):
    """(ids with null as -1, texts with null as empty) of a batch, a part of at most PART_BYTES (or one row) at a time, and where the part begins."""
    names = batch.schema.names
    ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
    for lo, hi in slices(texts, PART_BYTES):
        yield lo, [-1 if i is None else i for i in ids.slice(lo, hi - lo).to_pylist()], [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


SENT = "shard long, data binary"


def _by_shard(k: np.ndarray, more: dict[str, np.ndarray], n: int):
    """A batch (shard, packed arrays) of rows that are ordered by k[:, 0]."""
    shard = _shard(k[:, 0], n)
    cuts = [*np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist(), len(shard)] if len(shard) else [0]
    data = [pack({"k1": k[a:b, 0], "k2": k[a:b, 1], **{c: x[a:b] for c, x in more.items()}}) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a in cuts[:-1]], pa.int64()), pa.array(data, pa.binary())], names=["shard", "data"])


def _merged(k: np.ndarray, owner: np.ndarray, count: np.ndarray):
    """Equal keys as one: least owner, summed count; ordered by key."""
    order = np.lexsort((owner, k[:, 1], k[:, 0]))
    k, owner, count = k[order], owner[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])) if len(k) else np.zeros(0, np.int64)
    return k[new], owner[new], np.add.reduceat(count, new) if len(new) else count


def _count(path: str, bits: int, shards: int):
    """Batches of texts to the digests of their stretches: counts and least rows, by shard."""

    @common.freeing
    def run(batches):
        worker = ChunkEncoder(path, bits)
        keys, owners, n = [], [], 0

        def give():
            k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            k, owner, count = _merged(k, np.array(owners, np.int64), np.ones(len(owners), np.int64))
            keys.clear()
            owners.clear()
            return _by_shard(k, {"owner": owner, "count": count}, shards)

        for batch in batches:
            for _, ids, texts in _rows(batch):
                for i, text in zip(ids, texts):
                    plan = worker.plan(text.encode())
                    keys += [key for key, _ in plan]
                    owners += [i] * len(plan)
                if len(keys) > 1_000_000:
                    yield give()
        if keys:
            yield give()

    return run


def _keep_shared(folder: str):
    """Rows in order of their shard: the stretches that stand more than once go to the shard's file."""

    def write(shard, parts):
        k = np.concatenate([np.stack([p["k1"], p["k2"]], 1) for p in parts])
        k, owner, count = _merged(k, np.concatenate([p["owner"] for p in parts]), np.concatenate([p["count"] for p in parts]))
        many = count > 1
        put(f"{folder}/shared-{shard}", pack({"k1": k[many, 0], "k2": k[many, 1], "owner": owner[many]}))
        return int(many.sum())

    return _each_shard(write)


def _keep_ids(folder: str):
    """Rows in order of their shard: the encoded stretches go to the shard's file."""

    def write(shard, parts):
        k = np.concatenate([np.stack([p["k1"], p["k2"]], 1) for p in parts])
        sizes = np.concatenate([p["size"] for p in parts])
        data = np.concatenate([p["ids"] for p in parts])
        start = np.cumsum(sizes) - sizes
        order = np.lexsort((k[:, 1], k[:, 0]))
        k = k[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])  # rows with one id may both have encoded it
        order, k = order[new], k[new]
        at = np.concatenate([[0], np.cumsum(sizes[order])])
        body = np.concatenate([data[start[i] : start[i] + sizes[i]] for i in order]) if len(order) else data
        put(f"{folder}/ids-{shard}", pack({"k1": k[:, 0], "k2": k[:, 1], "at": at, "data": body}))
        return len(k)

    return _each_shard(write)


def _each_shard(write):
    @common.freeing
    def run(batches):
        parts, now = [], None
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and shard != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([write(now, parts)], pa.int64())], names=["shard", "n"])
                    parts = []
                now = shard
                parts.append(unpack(np.frombuffer(data.as_py(), np.uint8))[0])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([write(now, parts)], pa.int64())], names=["shard", "n"])

    return run


def _encode_shared(path: str, bits: int, store: Store):
    """Batches of texts to the ids of the shared stretches that their rows are the ones to encode, by shard."""

    @common.freeing
    def run(batches):
        worker = ChunkEncoder(path, bits)
        for batch in batches:
            for _, ids, texts in _rows(batch):
                mine: dict[bytes, bytes] = {}
                of: dict[bytes, tuple[int, bytes]] = {}
                for i, text in zip(ids, texts):
                    for key, data in worker.plan(text.encode()):
                        if key not in of or of[key][0] > i:
                            of[key] = (i, data)
                for key, owner in store.owners(list(of)).items():
                    if of[key][0] == owner:
                        mine[key] = of[key][1]
                if not mine:
                    continue
                done = worker.stretches(mine)
                keys = sorted(done, key=lambda x: int.from_bytes(x[:8], "little"))
                k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
                shard = _shard(k[:, 0], store.shards)
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero(shard == s)
                    body = [done[keys[j]] for j in at]
                    data = pack({"k1": k[at, 0], "k2": k[at, 1], "size": np.array([len(x) for x in body], np.int64), "ids": np.frombuffer(b"".join(body), np.uint8)})
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([data], pa.binary())], names=["shard", "data"])

    return run


def _encode(path: str, bits: int, store: Store | None):
    @common.freeing
    def run(batches):
        worker = ChunkEncoder(path, bits)
        for batch in batches:
            ids_column = batch.column(batch.schema.names.index("doc_id"))
            for lo, ids, texts in _rows(batch):
                coded = worker.encode(texts, store)
                yield pa.RecordBatch.from_arrays([ids_column.slice(lo, len(ids)), pa.array(coded, pa.binary()), pa.array(worker.decode(coded), pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def build_store(docs: DataFrame, tokenizer: str = TOKENIZER, bits: int = CHUNK_BITS) -> Store:
    """Encode every stretch that docs (doc_id, text) hold more than once, each one time, into files of the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-(2 * size >> bits) // SHARD_STRETCHES))
    folder = f"{common.shared_dir(spark)}/{spark.sparkContext.applicationId}/chunks-{uuid.uuid4().hex[:12]}"
    store = Store(folder, shards)

    def kept(parts, write):
        parts = parts.repartitionByRange(min(shards, 4 * common.partitions(spark)), "shard") if shards > 1 else parts.repartition(1)
        common.stage(parts.sortWithinPartitions("shard").mapInArrow(write, "shard long, n long"), "chunk-shards")

    kept(common.stage(docs.mapInArrow(_count(tokenizer, bits, shards), SENT), "chunk-digests"), _keep_shared(folder))
    kept(common.stage(docs.mapInArrow(_encode_shared(tokenizer, bits, store), SENT), "chunk-ids"), _keep_ids(folder))
    return store


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id and text to doc_id, ids (little-endian unsigned 32-bit) and decoded."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(tokenizer, bits, build_store(docs, tokenizer, bits)), "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(common.documents(spark, sf_dir)))
