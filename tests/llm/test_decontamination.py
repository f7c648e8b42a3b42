import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stringloom.llm import decontamination as d

rng = random.Random(8)


def words(n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


ITEMS = [" ".join(words(n)) for n in (20, 40, 40, 3, 1, 80)] + ["", None]
# items that share a phrase with others
PHRASE = words(12)
ITEMS += [" ".join(PHRASE + words(20)) for _ in range(6)]


def split(text):
    return (text or "").lower().split()


def runs(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else []


def brute(text, items):
    """Every window of every item's size, and short documents as a whole, by exact similarity on plain words."""
    sets = [runs(split(t), min(5, len(split(t)))) for t in items]
    n_items = sum(bool(s) for s in sets)
    holders = Counter(s for x in sets for s in set(x))
    w, found = split(text), {}
    for i, item in enumerate(items):
        n = len(split(item))
        if not n or not w:
            continue
        k = min(5, n)
        weight = lambda s, mine=Counter(sets[i]): 1 + math.log(n_items / (holders[s] if s in mine else 1))
        mine = Counter(sets[i])
        whole = sum(c * weight(s) for s, c in mine.items())
        best = 0.0
        for start in range(max(1, len(w) - n + 1)):
            bag = Counter(runs(w[start : start + n], k))
            both = sum(min(c, bag[s]) * weight(s) for s, c in mine.items())
            best = max(best, 2 * both / (whole + sum(c * weight(s) for s, c in bag.items())))
        if best >= 0.8:
            found[i] = round(best, 3)
    return found


def documents():
    out = [None, "", "  ", " ".join(words(100))]
    for item in [*ITEMS[:6], *ITEMS[8:10]]:
        w = item.split()
        out.append(" ".join(words(30) + w + words(30)))
        out.append(item.upper().replace(" ", "\n\t"))
        if len(w) > 10:
            for edits in (1, 2, 4):
                x = list(w)
                for _ in range(edits):
                    x[rng.randrange(len(x))] = "zzzzz"
                out.append(" ".join(words(10) + x + words(5)))
                y = list(w)
                for _ in range(edits):
                    y.insert(rng.randrange(len(y)), "yyyyy")
                    del y[rng.randrange(len(y))]
                out.append(" ".join(words(10) + y + words(5)))
            h = len(w) // 2
            out.append(" ".join(w[:h]))
            out.append(" ".join(words(7) + w[h:] + w[:h] + words(9)))  # halves change places
            out.append(" ".join(words(7) + w[:h] + words(3) + w[h:] + words(9)))
            out += [" ".join(w[:-1]), " ".join(w[1:]), " ".join(w[:-2] + ["q"])]
    out.append(" ".join(words(20) + ITEMS[1].split() + ITEMS[2].split()))
    out.append(" ".join(PHRASE * 4))
    out.append("lorem ipsum " * 30_000 + ITEMS[2])  # a very long text
    return out


DOCS = documents()


def test_against_all_windows():
    items = d.items_of(list(range(len(ITEMS))), ITEMS)
    got = {}
    for row, item, similarity, *_ in d.leaks(pa.array(DOCS, pa.string()), items):
        got.setdefault(row, {})[item] = round(similarity, 3)
    for i, text in enumerate(DOCS[:-1]):
        assert got.get(i, {}) == brute(text, ITEMS), text
    assert got[len(DOCS) - 1] == {2: 1.0}
    assert any(v < 1 for x in got.values() for v in x.values())


def test_swapped_halves_are_one_leak():
    w = ITEMS[5].split()
    items = d.items_of([0], [ITEMS[5]])
    found = d.leaks(pa.array([" ".join(words(10) + w[40:] + w[:40] + words(10))]), items)
    assert len(found) == 1 and found[0][2] > 0.94


@pytest.mark.parametrize("radius", [5, 16, 39])
def test_hamming_blocks_find_all_within_the_radius(radius):
    items = d.items_of([0, 1], [ITEMS[1], ITEMS[2]], radius=radius)
    prints = []
    for _ in range(300):
        q = items.prints[0].copy()
        for b in rng.sample(range(128), rng.randint(0, radius + 4)):
            q[b // 16] ^= np.uint16(1 << (b % 16))
        prints.append(q)
    prints = np.array(prints)
    distance = np.bitwise_count(prints ^ items.prints[0]).sum(axis=1)
    window, item, _ = items.near(prints, np.full(len(prints), items.group[0]))
    assert sorted(window[item == 0].tolist()) == np.flatnonzero(distance <= radius).tolist()


def test_tables_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(DOCS)] + [(4, DOCS[0], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10 + i, t) for i, t in enumerate(ITEMS)], "item_id long, text string")
    every = []
    for block in (5_000, 3, 1):
        monkeypatch.setattr(d, "BLOCK_ITEMS", block)
        every.append(sorted(map(tuple, d.find_leaks(docs, bench).collect())))
    assert every[0] == every[1] == every[2]
    items = d.items_of(list(range(len(ITEMS))), ITEMS)
    assert {(r[0], r[1] - 10, round(r[2], 9)) for r in every[0]} == {(row, i, round(s, 9)) for row, i, s, *_ in d.leaks(pa.array(DOCS, pa.string()), items)}
    left = d.drop_leaks(docs, bench)
    bad = {r[0] for r in every[0]}
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([i for i in range(len(DOCS)) if i not in bad] + [4])
    assert d.find_leaks(docs, bench.limit(0)).count() == 0 and d.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    assert d.find_leaks(docs.limit(0), bench).count() == 0 and d.drop_leaks(docs.limit(0), bench).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r["item_id"]: " ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in d.op9_decontamination(spark, sf).collect()}
    assert {(i, j) for i, t in texts.items() for j, b in bench.items() if b in t} <= found and found


def test_whole_documents_shorter_than_the_item():
    items = d.items_of(list(range(len(ITEMS))), ITEMS)
    w = [x.split() for x in ITEMS[:3]]
    docs = [" ".join(x) for x in (w[1][:-1], w[2][1:], w[0][:-2], w[1][:30], w[1][:24], w[2][3:20] + w[2][21:], w[1][:39] + ["zzzzz"], w[1][:4], w[0][:1])]
    got = {}
    for row, item, similarity, first, n, _ in d.leaks(pa.array(docs, pa.string()), items):
        got.setdefault(row, {})[item] = round(similarity, 3)
        assert (first, n) == (0, len(docs[row].split()))
    for i, text in enumerate(docs):
        assert got.get(i, {}) == brute(text, ITEMS), text
    assert got[0][1] > 0.98 and got[1][2] > 0.98 and 4 not in got
