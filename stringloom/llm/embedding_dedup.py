"""Operator 7: embedding near-dedup by a forest of random-projection trees.

Vectors of one label (and length) are compared. A tree splits unit vectors along random directions, at the median of a sample; a vector
near a split goes to both sides, so that near pairs rarely part. Above stands one tree for each label, which cuts it into cells that a
task holds in memory (REFIT rows and CELL_BYTES at most); within a cell TREES trees go on down to leaves of LEAF rows, whose vectors are
compared in double precision. Only cells are written to disk: a row is sent once for each of its cells (about 1.1 a level of the upper
tree, UPPER_COPIES at most by the sample), with its vector as it came (float or double); the leaves of the trees below, many more, never
leave a worker's memory.

The upper tree is grown on SAMPLE rows (or SAMPLE_BYTES) of all labels, then on a sample of every cell that is still too large, until
none is or its rows are too dense to part. It is thresholds and seeds of directions, one node a cell, and goes to all workers; beyond
NODES nodes no more are added. A cell that stays too large is cut into blocks: files in the shared folder, written once, of which every
pair is a task, so a large cell is many tasks' work and never one. Every row is indexed.

A pair of several leaves is counted in the first of its common leaves alone, and in the first of its common cells, which is read off the
rows' own lists of cells. A cell gives a count of links for each row and a forest of the components it joins, never its pairs.

Equal vectors of a label are one class, known by a digest of the vector; a class of m vectors has m - 1 links inside, and each link to
another class counts with that class's size. A pair is found if some leaf holds both; at cosine >= 0.98 recall is measured in the tests
(at least 0.9 asked).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing;
rows with the same vec_id are one node, with the links of all its vectors, and are not each other's link; a row without vec_id has a null
component and is kept; vectors of different lengths are never compared; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import contextlib
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common
from stringloom.llm.files import get, pack, put, unpack
from stringloom.llm.words import mix

COSINE, TREES, SAMPLE, LEAF, SPILL, BLOCK, SEED = 0.98, 4, 50_000, 256, 0.035, 512, 11
#: Bytes of vectors that upper trees are grown on; a cell of more than REFIT rows (or CELL_BYTES) is split again, on REFIT_SAMPLE of them.
SAMPLE_BYTES, REFIT, REFIT_SAMPLE, LEVELS = 64_000_000, 65_536, 4_096, 6
#: Bytes of a cell's vectors in double precision; nodes of the upper trees.
CELL_BYTES, NODES = 1 << 25, 100_000
#: The most spill times the square root of the dimension, with which projections narrow (near pairs' differences, too).
NARROW_SPILL = 0.16
#: Times that rows may be in an upper tree (on disk) and in a tree within a cell, by its sample; what can't be parted so is compared whole.
UPPER_COPIES, INNER_COPIES = 3.0, 16.0


def unit(lists: list) -> list:
    """Each list as a unit vector in double precision, or None if it can't be compared."""
    out = []
    for v in lists:
        if v is None or not len(v):
            out.append(None)
            continue
        x = np.array([np.nan if c is None else c for c in v], np.float64)
        n = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
        if n and np.isfinite(n):
            out.append(x / n)
        else:
            big = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0  # squares may overflow or vanish
            out.append(None if not big else (x / big) / np.sqrt((x / big) @ (x / big)))
    return out


def _units(column: pa.Array) -> list:
    """unit() of an Arrow column of lists, many rows at once where they are alike."""
    flat, n = column.flatten(), len(column)
    dim = len(flat) // n if n else 0
    if n and dim and not column.null_count and not flat.null_count and (np.diff(column.offsets.to_numpy()) == dim).all():
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        good = np.isfinite(norm) & (norm > 1e-100)
        return [x[i] / norm[i] if good[i] else unit([x[i]])[0] for i in range(n)]
    return unit(column.to_pylist())


class Tree:
    """Nodes of a tree in arrays: seed of the direction, threshold, children (negative: leaf).

    rows: those of the sample by leaf. copies: how often a row is there, on the way to each leaf; no split takes that beyond most.
    """

    def __init__(self, sample: np.ndarray, seed: int, leaf: int = LEAF, spill: float = SPILL, most: float = INNER_COPIES, copies: float = 1.0):
        self.leaf, self.seed, self.dim, self.spill = leaf, seed, sample.shape[1], spill
        self.at: list[float] = []
        self.child: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.most, self.copies = most, []
        self._known: dict[int, np.ndarray] = {}
        self.root = self._grow(sample, np.arange(len(sample)), 0, copies)

    def direction(self, node: int) -> np.ndarray:
        if node not in self._known:
            if len(self._known) * self.dim > 1 << 19:
                self._known.clear()
            x = np.random.default_rng((self.seed, node)).normal(size=self.dim)
            self._known[node] = x / np.linalg.norm(x)
        return self._known[node]

    def _grow(self, x, rows, depth, copies) -> int:
        if len(rows) <= self.leaf or depth > 40:
            return self._leaf(rows, copies)
        node = len(self.at)
        p = x[rows] @ self.direction(node).astype(x.dtype)
        at = float(np.median(p))
        left, right = rows[p <= at + self.spill], rows[p > at - self.spill]
        below = copies * (len(left) + len(right)) / len(rows)
        if below > self.most or max(len(left), len(right)) > 0.95 * len(rows):  # so dense that the spill takes too many along: blocks do the rest
            return self._leaf(rows, copies)
        self.at.append(at)
        self.child.append([0, 0])
        self.child[node] = [self._grow(x, left, depth + 1, below), self._grow(x, right, depth + 1, below)]
        return node

    def _leaf(self, rows, copies) -> int:
        self.rows.append(rows)
        self.copies.append(copies)
        return -len(self.rows)

    def light(self) -> Tree:
        """Without what only growing needs."""
        self.rows, self.copies, self._known = [], [], {}
        return self

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row of x reaches."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node, np.int64))
                continue
            p = x[at] @ self.direction(node)
            todo.append((self.child[node][0], at[p <= self.at[node] + self.spill]))
            todo.append((self.child[node][1], at[p > self.at[node] - self.spill]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _prepare(kind: str, whole: bool):
    """Rows to vec_id, label, h and, if whole, v: the vector's bytes, as floats or (kind <f8) its unit vector; h is their digest."""

    @common.freeing
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("embedding"))
            vectors = _units(column)
            if kind == "<f4":
                flat = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())])
                data = [None if v is None else (flat[ends[i] : ends[i + 1]].astype("<f4") + np.float32(0)).tobytes() for i, v in enumerate(vectors)]
            else:
                data = [None if v is None else (v + 0.0).tobytes() for v in vectors]
            keys = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            out = [batch.column(names.index("vec_id")), batch.column(names.index("label")), pa.array(keys, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(out[: 3 + whole], names=["vec_id", "label", "h", "v"][: 3 + whole])

    return run


def _matrix(data: list[bytes], kind: str = "<f8", n: int | None = None) -> np.ndarray:
    """Unit vectors in double precision; n: how many, if not as many as data."""
    x = np.frombuffer(b"".join(data), kind).reshape(len(data) if n is None else n, -1)
    if kind == "<f8":
        return x
    x = x.astype(np.float64)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _below(above: int, tree: int, leaf: np.ndarray) -> np.ndarray:
    """The number of a leaf of a tree that parts the cell `above`: a hash, so that levels need no common counter."""
    return mix(mix(np.full(len(leaf), above, np.int64).view(np.uint64) ^ np.uint64(tree + 1)) + leaf.astype(np.uint64)).view(np.int64)


def _cells_of(x: np.ndarray, first: np.ndarray, trees: dict[int, list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of vectors of one length for every cell that they reach from their first ones."""
    done, rows, cells = [], np.arange(len(x)), first
    while len(rows):
        known = np.unique(cells)
        split = np.array([c for c in known.tolist() if c in trees], np.int64)
        more = np.isin(cells, split)
        done.append((rows[~more], cells[~more]))
        next_ = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for c in split.tolist():
            at = rows[cells == c]
            for t, tree in enumerate(trees[c]):
                below, leaf = tree.leaves_of(x[at])
                next_.append((at[below], _below(c, t, leaf)))
        rows, cells = np.concatenate([r for r, _ in next_]), np.concatenate([c for _, c in next_])
    return np.concatenate([r for r, _ in done]), np.concatenate([c for _, c in done])


def _each_cell(trees: dict[int, list[Tree]], kind: str):
    """For batches (cid, first cell, v, ...): places in the batch and their cells."""

    def places(batch):
        first, data = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        sizes = np.array([len(d) for d in data])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            rows, cells = _cells_of(_matrix([data[i] for i in at], kind), first[at], trees)
            yield at[rows], cells

    return places


def _number(trees: dict[int, list[Tree]], kind: str):
    """Batches (cid, first cell, v) to rows and bytes by cell."""

    @common.freeing
    def run(batches):
        counts: dict[int, int] = {}
        for batch in batches:
            for _, cells in _each_cell(trees, kind)(batch):
                for c, n in zip(*(a.tolist() for a in np.unique(cells, return_counts=True))):
                    counts[c] = counts.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["cell", "n"])

    return run


def _sampled(trees: dict[int, list[Tree]], kind: str, wanted: dict[int, float], seed: int):
    """Batches (cid, first cell, v) to (cell, v) of samples: the share of a cell's rows that is wanted, by a hash of the vector."""

    @common.freeing
    def run(batches):
        for batch in batches:
            chance = np.array([zlib.crc32(v, seed) for v in batch.column(2).to_pylist()]) / 2.0**32
            for rows, cells in _each_cell(trees, kind)(batch):
                some = np.flatnonzero(chance[rows] < np.array([wanted.get(c, 0.0) for c in cells.tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array(cells[some], pa.int64()), batch.column(2).take(pa.array(rows[some]))], names=["cell", "v"])

    return run


def _most(dim: int) -> int:
    """Rows of a cell."""
    return max(1, min(REFIT, CELL_BYTES // (8 * dim)))


def _upper(rows: DataFrame, trees: int, seed: int, kind: str, firsts: dict[int, tuple[int, int]]) -> tuple[dict[int, list[Tree]], dict[int, int]]:
    """The trees by the cell that they part, and the blocks of the cells that stay too large.

    rows: cid, first cell, v; firsts: rows and length of the first cells that are too large.
    """
    grown: dict[int, list[Tree]] = {}
    dims, large, dense, nodes = {c: d for c, (_, d) in firsts.items()}, {c: n for c, (n, _) in firsts.items()}, set(), 0
    copies = dict.fromkeys(firsts, 1.0)
    rows = rows.select("cid", "first", "v").where(F.col("first").isin(list(firsts)))
    for level in range(LEVELS):
        todo = [c for c in sorted(large, key=lambda c: (-large[c], c)) if c not in dense]
        if not todo or nodes >= NODES:
            break
        sample = min(SAMPLE, max(1_000, SAMPLE_BYTES // (8 * max(dims[c] for c in todo))))
        todo = todo[: max(1, sample // 64)]
        total = sum(large[c] for c in todo)
        wanted = {c: max(64 / large[c], (sample if level == 0 else min(sample, REFIT_SAMPLE * len(todo))) / total) for c in todo}
        held: dict[int, list[bytes]] = {}
        for r in rows.mapInArrow(_sampled(grown, kind, wanted, seed + level), "cell long, v binary").toLocalIterator():
            held.setdefault(r["cell"], []).append(bytes(r["v"]))
        for c in todo:
            x, dim = _matrix(sorted(held.get(c, [])), kind) if c in held else np.zeros((0, 1)), dims[c]
            least = max(8, int(0.7 * _most(dim) * len(x) / large[c]))
            made = [Tree(x, ((seed + level) * 1000 + t) ^ (c & 0xFFFFFFFF), least, min(SPILL, NARROW_SPILL / dim**0.5), UPPER_COPIES, copies[c]) for t in range(trees if c in firsts else 1)]
            if not any(t.at for t in made):
                dense.add(c)
                continue
            grown[c] = made
            for t, tree in enumerate(made):
                nodes += len(tree.at)
                below = _below(c, t, np.arange(1, len(tree.rows) + 1)).tolist()
                dims |= dict.fromkeys(below, dim)
                copies |= dict(zip(below, tree.copies))
                tree.light()
        counted = rows.mapInArrow(_number(grown, kind), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        large = {r["cell"]: r["n"] for r in counted.where(F.col("n") > min(map(_most, set(dims.values())))).collect() if r["n"] > _most(dims[r["cell"]])}
    return grown, {c: -(-n // _most(dims[c])) for c, n in large.items()}


def _placed(trees: dict[int, list[Tree]], kind: str, blocks: dict[int, int], seed: int):
    """Batches (cid, first cell, v, ...) to a row for each cell: cell, block, all cells of the row, cid, v, ..."""

    @common.freeing
    def run(batches):
        for batch in batches:
            for rows, cells in _each_cell(trees, kind)(batch):
                order = np.lexsort((cells, rows))
                rows, cells = rows[order], cells[order]
                start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                size = np.diff([*start, len(rows)])
                # the list of cells of a row, for each of its cells
                many = np.repeat(size, size)
                where = np.repeat(start, size)
                ends = np.cumsum(many)
                lists = cells[np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(where, many)]
                lists = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(lists, pa.int64()))
                at = pa.array(rows)
                block = np.zeros(len(rows), np.int64)
                if blocks:
                    many_of = np.array([blocks.get(c, 1) for c in cells.tolist()], np.uint64)
                    block = (mix(batch.column(0).to_numpy()[rows].astype(np.uint64) + np.uint64(seed)) % many_of).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int64()), pa.array(block, pa.int64()), lists, *(batch.column(i).take(at) for i in (0, 2, *range(3, batch.num_columns)))],
                    names=["cell", "block", "cells", "cid", "v", *batch.schema.names[3:]],
                )

    return run


def _rows_of(classes: DataFrame) -> DataFrame:
    """cid, first (a number for each label and length: the cell to begin with), v, and size and marked where there are any."""
    label = [F.col("label")] if "label" in classes.columns else []
    return classes.select("cid", F.xxhash64(*label, F.octet_length("v")).alias("first"), "v", *(c for c in ("size", "marked") if c in classes.columns))


def _forest(classes: DataFrame, trees: int, seed: int, kind: str = "<f8") -> tuple[DataFrame, dict[int, list[Tree]], dict[int, int]]:
    """The rows of classes, the upper trees and the blocks of cells that stay too large."""
    rows, width = _rows_of(classes), int(kind[2:])
    sizes = rows.groupBy("first").agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("size"))
    sizes = sizes.where(F.col("n") > F.greatest(F.lit(1), F.least(F.lit(REFIT), F.floor(F.lit(CELL_BYTES * width // 8) / F.col("size"))))).orderBy(F.desc("n"), "first").limit(NODES)
    return rows, *_upper(rows, trees, seed, kind, {r["first"]: (r["n"], r["size"] // width) for r in sizes.collect()})


def _leaves(classes: DataFrame, trees: int, seed: int) -> DataFrame:
    """(cid, leaf) for every cell of every upper tree that a class reaches; classes: cid, v."""
    rows, grown, _ = _forest(classes, trees, seed)
    out = rows.mapInArrow(_placed(grown, "<f8", {}, seed), "cell long, block long, cells array<long>, cid long, v binary")
    return common.stage(out.select("cid", F.col("cell").alias("leaf")), "leaves")


def _spans(linked: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the components that a table of links joins: (row, column) of one link for each join."""
    n, m = linked.shape
    label = np.arange(n + m)
    out = []
    for r in np.flatnonzero(linked.any(axis=1)).tolist():
        columns = np.flatnonzero(linked[r])
        there = label[n + columns]
        new = there != label[r]
        if not new.any():
            continue
        names, first = np.unique(there[new], return_index=True)
        out += [(r, int(c)) for c in columns[new][first]]
        label[np.isin(label, names)] = label[r]
    return out


def _leaves_by_row(leaves: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of the leaves (by number) of n rows: values, and where each list begins (and the last ends)."""
    leaf, row = np.repeat(np.arange(len(leaves)), [len(r) for r in leaves]), np.concatenate(leaves)
    order = np.argsort(row, kind="stable")
    return leaf[order], np.searchsorted(row[order], np.arange(n + 1))


def _common(values: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, below: int) -> np.ndarray | None:
    """Which of rows a and b have a common value less than below, in lists values[start[i]:start[i + 1]]; None if no row has one."""

    def table(rows):
        size = start[rows + 1] - start[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start[rows], size)
        keep = values[at] < below
        return np.repeat(np.arange(len(rows)), size)[keep], values[at][keep]

    (ra, va), (rb, vb) = table(a), table(b)
    names = np.intersect1d(va, vb)
    if not len(names):
        return None
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(names), 4_096):
        part = names[lo : lo + 4_096]
        tables = []
        for r, v, n in ((ra, va, len(a)), (rb, vb, len(b))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            t = np.zeros((n, len(part)), np.float32)
            t[r[hit], at[hit]] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out > 0


class _Joins:
    """Components of rows, and the links that made them."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.made: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def add(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.made.append((a, b))


def _links(x: np.ndarray, cid, size, marked, block, cells: tuple[np.ndarray, np.ndarray], cell: int, how: tuple):
    """The links of a cell's rows; if they are of two blocks, only those between them. Gives a batch (a, b, n), as _compare says."""
    cosine, trees, seed, least, width = how
    n, narrow = len(x), x.astype(np.float32)
    two = bool((block != block[0]).any())
    leaves, spill = [], min(SPILL, NARROW_SPILL / x.shape[1] ** 0.5)
    for t in range(trees):
        grown = Tree(narrow, seed * 1000 + t, least, spill).rows
        leaves = grown if len(grown) == 1 else leaves + grown
        if len(grown) == 1:  # it holds all rows, and so all pairs
            break
    held = _leaves_by_row(leaves, n)
    joins, counts, both = _Joins(n), np.zeros(n, np.int64), ([], [])
    for k, leaf in enumerate(leaves):
        left, right = (leaf[block[leaf] == block[0]], leaf[block[leaf] != block[0]]) if two else (leaf, leaf)
        for lo in range(0, len(left), width):
            for at in range(0 if two else lo, len(right), width):
                a, b = left[lo : lo + width], right[at : at + width]
                near = narrow[a] @ narrow[b].T >= cosine - 1e-4  # then in double precision what may be a link
                if not two:
                    near &= a[:, None] < b[None]
                if not near.any():
                    continue
                a, b = a[near.any(axis=1)], b[near.any(axis=0)]
                linked = x[a] @ x[b].T >= cosine
                if not two:
                    linked &= a[:, None] < b[None]
                a, b, linked = a[linked.any(axis=1)], b[linked.any(axis=0)], linked[linked.any(axis=1)][:, linked.any(axis=0)]
                for lists, before in ((held, k), (cells, cell)):
                    if linked.any() and (seen := _common(*lists, a, b, before)) is not None:
                        linked &= ~seen
                if not linked.any():
                    continue
                apart = linked & (np.array([joins.top(i) for i in a.tolist()])[:, None] != np.array([joins.top(i) for i in b.tolist()])[None])
                for r, c in _spans(apart) if apart.any() else ():
                    joins.add(int(a[r]), int(b[c]))
                np.add.at(counts, a, linked @ size[b])
                np.add.at(counts, b, size[a] @ linked)
                if marked[a].any() or marked[b].any():
                    i, j = np.nonzero(linked & (marked[a][:, None] | marked[b][None]))
                    both[0].extend(cid[a[i]].tolist() + cid[b[j]].tolist())
                    both[1].extend(cid[b[j]].tolist() + cid[a[i]].tolist())
    some = np.flatnonzero(counts)
    out_a = [*(int(cid[a]) for a, _ in joins.made), *both[0], *cid[some].tolist()]
    out_b = [*(int(cid[b]) for _, b in joins.made), *both[1], *[None] * len(some)]
    out_n = [*[None] * len(joins.made), *[0] * len(both[0]), *counts[some].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_a, out_b, out_n)], names=["a", "b", "n"])


def _lists(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists as values and where each begins (and the last ends)."""
    return np.concatenate(cells), np.concatenate([[0], np.cumsum([len(c) for c in cells])])


def _cells(run_cell):
    """Rows (cell, block, cells, cid, v, size, marked) sorted by cell and block, to what run_cell gives of a group's columns."""

    @common.freeing
    def run(batches):
        held, key = [], None

        def flush():
            cid, size, marked = (np.concatenate([h[i] for h in held]) for i in range(3))
            return run_cell(*key, cid, size, marked, [v for h in held for v in h[3]], _lists([c for h in held for c in h[4]]))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1)], 1)
            if not len(keys):
                continue
            cid, size, marked = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5, 6))
            v, offsets, flat = batch.column(4).to_pylist(), batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            lists = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                here = tuple(keys[lo].tolist())
                if here != key and held:
                    yield flush()
                    held = []
                key = here
                held.append((cid[lo:hi], size[lo:hi], marked[lo:hi], v[lo:hi], lists[lo:hi]))
        if held:
            yield flush()

    return run


def _compare(how: tuple, kind: str):
    """Rows of cells to counts and links; how: cosine, trees, seed, rows of a leaf, rows compared at once.

    A row (a, null, n): class a has links to n vectors here that no earlier cell of both counts. A row (a, b, null) is a link of the
    cell's forest. A row (a, b, 0) is a link, to be counted, of which a class holds a vec_id that stands on several vectors.
    """

    def group(cell, block, cid, size, marked, v, cells):
        return _links(_matrix(v, kind), cid, size, marked, np.zeros(len(cid), np.int64), cells, cell, how)

    return _cells(group)


def _keep_block(folder: str, kind: str):
    """Rows of cells that are too large for a task to files, one for each block."""

    def group(cell, block, cid, size, marked, v, cells):
        x = np.frombuffer(b"".join(v), np.uint8)
        put(f"{folder}/{cell}-{block}", pack({"v": x, "cid": cid, "size": size, "marked": marked.astype(np.uint8), "cells": cells[0], "lengths": np.diff(cells[1])}))
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([block], pa.int64())], names=["cell", "block"])

    return _cells(group)


def _compare_blocks(folder: str, how: tuple, kind: str):
    """Rows (cell, i, j) to what _compare gives, of block i and block j."""

    @common.freeing
    def run(batches):
        for batch in batches:
            for cell, i, j in zip(*(batch.column(k).to_pylist() for k in range(3))):
                parts = [unpack(get(f"{folder}/{cell}-{b}"))[0] for b in dict.fromkeys((i, j))]
                cid, size, marked, values, lengths = (np.concatenate([p[c] for p in parts]) for c in ("cid", "size", "marked", "cells", "lengths"))
                block = np.repeat(np.arange(len(parts)), [len(p["cid"]) for p in parts])
                x = _matrix([p["v"].tobytes() for p in parts], kind, len(cid))
                yield _links(x, cid, size, marked.astype(bool), block, (values, np.concatenate([[0], np.cumsum(lengths)])), cell, how)

    return run


def _found(classes: DataFrame, cosine: float, trees: int, seed: int, kind: str) -> DataFrame:
    """a, b, n as _compare says; classes: cid, label, v, size, marked."""
    spark = classes.sparkSession
    rows, grown, blocks = _forest(classes, 1, seed, kind)
    placed = rows.mapInArrow(_placed(grown, kind, blocks, seed), "cell long, block long, cells array<long>, cid long, v binary, size long, marked boolean")
    key, links, how = ["cell", "block"], "a long, b long, n long", (cosine, trees, seed, LEAF, BLOCK)
    dealt = lambda df: df.repartition(common.partitions(spark), *key).sortWithinPartitions(*key)
    whole = placed.where(~F.col("cell").isin(list(blocks))) if blocks else placed
    found = common.stage(dealt(whole).mapInArrow(_compare(how, kind), links), "vector-links")
    if not blocks:
        return found
    folder = f"{common.shared_dir(spark)}/{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex[:12]}"
    kept = common.stage(dealt(placed.where(F.col("cell").isin(list(blocks)))).mapInArrow(_keep_block(folder, kind), "cell long, block long"), "cell-blocks")
    pairs = kept.select("cell", F.col("block").alias("i")).join(kept.select("cell", F.col("block").alias("j")), "cell").where("i <= j").select("cell", "i", "j")
    pairs = pairs.repartition(max(common.partitions(spark), min(10_000, sum(b * (b + 1) // 2 for b in blocks.values()))), "cell", "i", "j")
    return found.unionByName(common.stage(pairs.mapInArrow(_compare_blocks(folder, how, kind), links), "block-links"))


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """Meanwhile a query's shuffle files go when it ends (else when the driver happens to collect its garbage)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    with _shuffles_go(vectors.sparkSession):
        return _near_vectors(vectors, cosine, trees, seed)


def _near_vectors(vectors: DataFrame, cosine: float, trees: int, seed: int) -> DataFrame:
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    # vectors travel twice, once to their class and once to its cells; all else goes by a digest
    rows = common.stage(given.mapInArrow(_prepare(kind, False), "vec_id long, label long, h binary"), "vectors")
    usable = "h is not null and label is not null and vec_id is not null"
    real = rows.where(usable).dropDuplicates(["vec_id", "label", "h"])
    # ids that stand on several vectors are counted by themselves: a class's size is that of its other ids
    several = common.stage(real.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id"), "several")
    any_several = not several.isEmpty()
    if any_several:
        real = real.join(several.withColumn("many", F.lit(True)), "vec_id", "left")
    many = F.coalesce("many", F.lit(False)) if any_several else F.lit(False)
    real = real.withColumn("many", many)
    classes = real.groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.sum((~F.col("many")).cast("long")).alias("size"), F.max("many").alias("marked"))
    data = given.mapInArrow(_prepare(kind, True), "vec_id long, label long, h binary, v binary").where(usable).groupBy("label", "h").agg(F.first("v").alias("v"))
    classes = common.stage(classes.join(data, ["label", "h"]).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = _found(classes, cosine, trees, seed, kind)
    joined = common.components(found.where("b is not null").select("a", "b"))
    outside = found.where("b is null").groupBy("a").agg(F.sum("n").alias("outside"))
    classes = classes.select("label", "h", "cid", "rep", "size").join(outside, F.col("cid") == F.col("a"), "left").drop("a")
    classes = classes.join(joined, F.col("cid") == F.col("node"), "left").drop("node").withColumn("c", F.coalesce("component", "cid")).drop("component")
    classes = common.stage(classes.withColumn("n", F.col("size") + F.coalesce("outside", F.lit(0))).drop("outside", "size"), "counted")
    label = classes.groupBy("c").agg(F.min("rep").alias("least"))
    out = rows.join(classes.select("label", "h", "cid", "c", "n"), ["label", "h"], "left").drop("label", "h")
    if any_several:
        out, label = _with_several(out, label, real, several, found, classes, rows)
    else:
        out = out.withColumn("n_links", F.col("n") - 1)
    out = out.join(label, "c", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def _with_several(out: DataFrame, label: DataFrame, real: DataFrame, several: DataFrame, found: DataFrame, classes: DataFrame, rows: DataFrame):
    """Counts and components where ids stand on several vectors: such an id counts once for whoever is linked with any of its vectors."""
    holds = real.where("many").join(classes.select("label", "h", "cid", "c"), ["label", "h"]).select("vec_id", "cid", "c")
    holds = common.stage(holds, "several-classes")
    own = holds.select("cid").distinct()
    near = found.where("b is not null and n is not null").select("a", "b")  # links of marked classes, both ways
    near = common.stage(near.unionByName(own.select(F.col("cid").alias("a"), F.col("cid").alias("b"))).distinct(), "several-links")
    # for a class: the ids of the kind that it or its neighbours hold
    seen = near.join(holds.select(F.col("cid").alias("b"), "vec_id"), "b").groupBy("a").agg(F.countDistinct("vec_id").alias("ids"))
    out = out.join(seen, F.col("cid") == F.col("a"), "left").drop("a")
    # for an id: the classes of its closed neighbourhood, each once
    size = real.where("not many").join(classes.select("label", "h", "cid"), ["label", "h"]).groupBy("cid").agg(F.count("*").alias("size"))
    around = holds.select(F.col("cid").alias("a"), F.col("vec_id").alias("id")).join(near, "a").select("id", "b").distinct()
    ones = around.join(size, F.col("b") == F.col("cid"), "left").groupBy("id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("ones"))
    others = around.join(holds.select(F.col("cid").alias("b"), "vec_id"), "b").groupBy("id").agg(F.countDistinct("vec_id").alias("others"))
    totals = ones.join(others, "id").select("id", (F.col("ones") + F.col("others") - 1).alias("total"))
    out = out.join(totals, F.col("vec_id") == F.col("id"), "left").drop("id")
    # a copy of such an id that links with nothing keeps the id's count, too
    out = out.withColumn("n_links", F.coalesce("total", F.col("n") + F.coalesce("ids", F.lit(0)) - 1)).drop("total", "ids")
    lo = holds.groupBy("vec_id").agg(F.min("c").alias("lo"))
    joined = common.components(holds.join(lo, "vec_id").select(F.col("lo").alias("a"), F.col("c").alias("b")).where("a <> b").distinct())
    label = label.join(joined, F.col("c") == F.col("node"), "left").withColumn("g", F.coalesce("component", "c")).select("c", "g", "least")
    label = label.join(label.groupBy("g").agg(F.min("least").alias("l")), "g").select("c", F.col("l").alias("least"))
    return out, label


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
