"""Operator 2: MinHash near-duplicates by fast similarity sketching.

A document's set are its distinct shingles (runs of `shingle` words; a shorter text is one shingle; no words: empty, linked with nothing).

Sketch: in round i < t every element falls into one hashed bin with the value (i, hash); from round t on, round t + j puts all elements
into bin j. A bin keeps its least value, and a document leaves the rounds when all its bins are full, which the last t rounds guarantee.
So a large set needs one or two rounds over its elements, and the agreement of two sketches is concentrated around the sets' similarity.

Links: BANDS bands of ROWS bins make keys. At similarity 0.8 a pair shares no key with probability (1 - 0.8**6)**32 = 6e-5.
Documents with the same set are one class. Within a key every class is first paired with the key's least class (a star, linear in the key's
members); pairs are confirmed on the full sets. Keys whose classes are not all in one component by then are decided in full: with at most
FEW classes by pairs between components (a constant number for each member); with more, the classes outside the hub's component
are compared with all of the key in blocks, by the counts of common elements of a whole block at once, and a block gives a forest of the
components it joins, not its pairs. So every pair that shares a key is decided, and no key is gathered in one task or emitted as pairs.

Sets travel only for pairs to confirm. Joins on classes and keys are plain equi-joins (skewed keys are split at run time), counts and
minima combine before the shuffle, and every intermediate table is written to the shared folder.

Classes are known by their set, never by a doc_id, so an id that stands on several texts is compared by each of them.

Defined results: null and empty texts have n_shingles 0 and are a component of their own; rows with the same doc_id are one node, linked
by all its texts; a row without a doc_id has a null component and is kept; a very long text is worked on alone, as a whole; an empty table
gives no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common
from stringloom.llm.words import Words, mix, run_hash, slices

BANDS, ROWS, PERCENT = 32, 6, 80
BINS = BANDS * ROWS
#: Classes of a key that are compared as pairs; classes of a block beyond.
FEW, BLOCK = 16, 256
#: Classes in pairs up to which their ids are sent to every worker to pick the texts; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 500_000
_ROUND = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_COLUMN = mix(np.arange(7, BINS + 7, dtype=np.uint64))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, ordered by both."""
    words = Words(texts)
    at, h = words.shingles(k)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = [mix(run_hash(words.hash[words.first[i] : words.first[i + 1]], int(count[i])))[0] for i in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(whole, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sketches(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """n x BINS values; rows of empty sets are meaningless."""
    top = np.uint64(2**64 - 1)
    out = np.full((n, BINS), top, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * BINS):
        if not len(doc):
            break
        x = mix(h ^ _ROUND[i])
        if i < BINS:
            bins = doc * BINS + (((x >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
        else:
            bins = doc * BINS + (i - BINS)
        value = (np.uint64(i) << np.uint64(48)) | ((x & np.uint64(0xFFFFFFFF)) << np.uint64(16)) | (h & np.uint64(0xFFFF))
        np.minimum.at(flat, bins, value)
        if i >= 0:
            open_ = (out == top).any(axis=1)
            keep = open_[doc]
            if not keep.all():
                doc, h = doc[keep], h[keep]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sketch), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sketch), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + sketch[:, j])
        keys[:, b] = x
    return keys


SIGNED = "doc_id long, hash long, n_shingles long, d1 long, d2 long, bands array<long>"


def _sign(k: int):
    @common.freeing
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, ids, hashes = (batch.column(names.index(c)) for c in ("text", "doc_id", "hash"))
            for lo, hi in slices(texts):
                m = hi - lo
                doc, h = shingle_sets(texts.slice(lo, m), k)
                n = np.bincount(doc, minlength=m).astype(np.int64)
                d = []
                for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDE)):
                    s = np.zeros(m + 1, np.uint64)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt))])
                    edges = np.concatenate([[0], np.cumsum(n)])
                    s = total[edges[1:]] - total[edges[:-1]]
                    d.append(pa.array(s.view(np.int64)))
                keys = band_keys(sketches(m, doc, h)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, m * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, m), hashes.slice(lo, m), pa.array(n), *d, bands], names=["doc_id", "hash", "n_shingles", "d1", "d2", "bands"])

    return run


def _confirm(k: int, percent: int):
    """Batches of (a, b, ta, tb) to those pairs whose sets are similar enough; sets of repeated texts are remembered within a batch run."""

    @common.freeing
    def run(batches):
        held: dict[int, np.ndarray] = {}

        def set_of(i: int, text: str) -> np.ndarray:
            got = held.get(i)
            if got is None:
                if sum_held[0] > 40_000_000:
                    held.clear()
                    sum_held[0] = 0
                got = held[i] = shingle_sets(pa.array([text], pa.string()), k)[1]
                sum_held[0] += got.nbytes
            return got

        sum_held = [0]
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = set_of(a[i], batch.column(2)[i].as_py()), set_of(b[i], batch.column(3)[i].as_py())
                both = np.concatenate([x, y])
                both.sort()
                common_ = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common_ >= percent * (len(x) + len(y) - common_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))
    return common.stage(rows.mapInArrow(_sign(shingle), SIGNED), "signed")


def _grouped(docs: DataFrame, signed: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, found): a row for each distinct set (d1, d2, cid, rep, hash), and cid -> component, the least cid linked with it.

    A class is known by its set alone, so ids that stand on several texts do no harm; rep and hash name its least document and that
    document's text.
    """
    real = signed.where("doc_id is not null and n_shingles > 0")
    # one class for each set: the copies' keys are merged before the shuffle
    first = F.min(F.struct("doc_id", "hash")).alias("first")
    classes = real.groupBy("d1", "d2").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = classes.select("d1", "d2", F.col("first.doc_id").alias("rep"), F.col("first.hash").alias("hash"), "n", "bands")
    classes = common.stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", "n", F.explode("bands").alias("key"))
    star = members.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    live = common.stage(members.join(star, "key"), "members")  # keys that more than one class has
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = live.select(F.col("cid").alias("a"), F.col("hub.cid").alias("b"), "n", F.col("hub.n").alias("m")).where(f"a <> b and {fits}").select("a", "b").distinct()
    pairs = common.stage(pairs, "pairs")
    texts = _texts(docs, classes, live)
    links = common.stage(_confirmed(pairs, texts, shingle, percent), "links")
    found = common.components(links)
    # keys that are not settled: their classes lie in different components
    placed = live.select("cid", "n", "key").join(found, F.col("cid") == F.col("node"), "left").select("cid", "n", "key", F.coalesce("component", "cid").alias("c"))
    unsettled = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by("c", "cid").alias("hub"), F.count("*").alias("size")).where("lo < hi")
    left = common.stage(placed.join(unsettled.select("key", "hub", "size"), "key"), "unsettled")
    few = left.where(F.col("size") <= FEW).select("key", F.col("cid").alias("a"), "n", "c")
    other = few.select("key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("c").alias("cb"))
    rest = few.join(other, "key").where(f"a < b and c <> cb and {fits}").select("a", "b").distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = common.stage(rest.join(done, ["a", "b"], "left_anti"), "rest")
    more = common.stage(_confirmed(rest, texts, shingle, percent), "links")
    more = more.unionByName(common.stage(_by_blocks(left.where(F.col("size") > FEW), texts, shingle, percent), "links"))
    found = common.components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return classes.drop("bands", "n"), found


def _component_of(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes with c, their component."""
    return classes.join(found, F.col("cid") == F.col("node"), "left").drop("node").withColumn("c", F.coalesce("component", "cid")).drop("component")


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text). Rows of one doc_id are one node, with the links of all its texts."""
    signed = _signed(docs, shingle)
    classes, found = _grouped(docs, signed, shingle, percent)
    classes = common.stage(_component_of(classes, found), "placed")
    narrow = signed.select("doc_id", "n_shingles", "d1", "d2")
    of = common.stage(narrow.join(classes.select("d1", "d2", "c"), ["d1", "d2"], "left").select("doc_id", "n_shingles", "c"), "rows")
    # an id on texts of several components joins them
    joins = of.where("doc_id is not null and c is not null").groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    joins = common.stage(joins.select("doc_id", "lo"), "joins")
    label = classes.groupBy("c").agg(F.min("rep").alias("component_id"))
    if not joins.isEmpty():
        bridges = of.where("c is not null").join(joins, "doc_id").select(F.col("lo").alias("a"), F.col("c").alias("b")).where("a <> b").distinct()
        joined = common.components(bridges)
        label = label.join(joined, F.col("c") == F.col("node"), "left").withColumn("g", F.coalesce("component", "c")).select("c", "g", "component_id")
        label = label.join(label.groupBy("g").agg(F.min("component_id").alias("least")), "g").select("c", F.col("least").alias("component_id"))
    # most components are one class: only the labels that differ from the row's own id travel
    out = of.join(common.stage(label, "labels"), "c", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _texts(docs: DataFrame, classes: DataFrame, live: DataFrame) -> DataFrame:
    """(cid, text) of the classes that share a key with another: the text of the class's least document, told from the id's other texts by its hash."""
    ids = live.select("cid").distinct().join(classes.select("cid", "rep", F.col("hash").alias("of")), "cid")
    ids = common.stage(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep").where(F.xxhash64("text") == F.col("of"))
    return common.stage(rows.groupBy("cid").agg(F.first("text").alias("text")), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    a = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirm(shingle, percent), "a long, b long")


def _by_blocks(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links across components in keys with many classes; members: cid, n, key, c, hub (the component of the key's least class), size.

    A group (key, i, j) is block i of the classes outside the hub's component against block j of all classes.
    """
    spark = members.sparkSession
    outside = members.where("c <> hub").groupBy("key").agg(F.count("*").alias("strays"))
    rows = members.join(outside, "key").withColumn("bs", F.ceil(F.col("strays") / BLOCK).cast("int")).withColumn("ba", F.ceil(F.col("size") / BLOCK).cast("int"))
    h = F.xxhash64("cid", F.lit(3))
    stray = rows.where("c <> hub").select("key", F.pmod(h, F.col("bs")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ba") - 1)).alias("j"), F.lit(0).alias("side"), "cid", "c")
    every = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("i"), F.pmod(h, F.col("ba")).cast("int").alias("j"), F.lit(1).alias("side"), "cid", "c")
    grouped = stray.unionByName(every).join(texts, "cid").select("key", "i", "j", "side", "cid", "c", "text")
    grouped = grouped.repartition(common.partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(_compare_blocks(shingle, percent), "a long, b long").distinct()


def common_counts(doc: np.ndarray, h: np.ndarray, n: int, side: np.ndarray) -> np.ndarray:
    """Common elements of each text of side 0 with each of side 1; elements that one text alone has don't matter."""
    names, at, times = np.unique(h, return_inverse=True, return_counts=True)
    keep = times[at] > 1
    doc, at = doc[keep], at[keep]
    place = np.cumsum(times > 1) - 1
    at = place[at]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    row = np.cumsum(side == 0) - 1, np.cumsum(side == 1) - 1
    out = np.zeros((int((side == 0).sum()), int((side == 1).sum())), np.float32)
    step = 16_384
    total = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, total, step):
        a, b = np.searchsorted(at, [lo, lo + step])
        parts = []
        for s in (0, 1):
            mine = side[doc[a:b]] == s
            m = np.zeros((out.shape[s], min(step, total - lo)), np.float32)
            m[row[s][doc[a:b][mine]], at[a:b][mine] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _compare_blocks(k: int, percent: int):
    def links(held):
        side = np.concatenate([x[0] for x in held])
        rep = np.concatenate([x[1] for x in held])
        comp = np.concatenate([x[2] for x in held])
        if not (side == 0).any() or not (side == 1).any():
            return [], []
        texts = pa.chunked_array([x[3] for x in held]).combine_chunks()
        docs, hashes = [], []
        for lo, hi in slices(texts):
            d, h = shingle_sets(texts.slice(lo, hi - lo), k)
            docs.append(d + lo)
            hashes.append(h)
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        size = np.bincount(doc, minlength=len(side))
        both = common_counts(doc, h, len(side), side).astype(np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = 100 * both >= percent * (size[left][:, None] + size[right][None] - both)
        i, j = np.nonzero(near & (comp[left][:, None] != comp[right][None]))
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in zip(left[i].tolist(), right[j].tolist()):
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(rep[x]), int(rep[y])))
        return [o[0] for o in out], [o[1] for o in out]

    @common.freeing
    def run(batches):
        held, key = [], None

        def flush():
            a, b = links(held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                here = tuple(keys[lo].tolist())
                if here != key and held:
                    yield flush()
                    held = []
                key = here
                held.append(tuple(batch.column(i).slice(lo, hi - lo) if i == 6 else batch.column(i).slice(lo, hi - lo).to_numpy() for i in (3, 4, 5, 6)))
        if held:
            yield flush()

    return run


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs, with all columns, with one row of each group of near duplicates: of its least document.

    Here rows are grouped by their texts alone: rows of one doc_id whose texts are unlike both stay. Rows without a doc_id or without words stay.
    """
    signed = _signed(docs, shingle)
    classes, found = _grouped(docs, signed, shingle, percent)
    placed = _component_of(classes, found)
    kept = placed.groupBy("c").agg(F.min(F.struct("rep", "hash")).alias("first")).select(F.col("first.rep").alias("__kept_id"), F.col("first.hash").alias("__kept_hash"))
    # the rows that go, as most stay: documents with words that are not their component's first
    real = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "hash")
    real = real.groupBy("doc_id", "hash").agg(F.count("*").alias("times"))
    out = real.join(common.stage(kept, "kept"), (F.col("doc_id") == F.col("__kept_id")) & (F.col("hash") == F.col("__kept_hash")), "left")
    out = common.stage(out.select("doc_id", "hash", "times", F.col("__kept_id").isNotNull().alias("stays")), "decided")
    here = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    gone = out.where("not stays").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, here, "left_anti")
    repeated = out.where("stays and times > 1").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, here, "left_anti").unionByName(once)
