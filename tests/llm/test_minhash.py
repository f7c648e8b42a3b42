import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stringloom.llm import minhash
from stringloom.llm.words import Words, slices

lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(lower)) if w]
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(set_of(t, k))
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            for g in s:
                holders[g].add(i)
    for i in ids:
        for s in sets[i]:
            near = {j for g in s for j in holders[g]} - {i}
            for j in near:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in sets[j]):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    rows = []
    for b in range(6):
        base = [word() for _ in range(60)]
        for _ in range(n // 6):
            t = list(base)
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += ["", None, " \t ", "one", "ONE", "one two", "One\ttwo", "one two one two", rows[0], rows[0], "x " * 20_000]
    return list(enumerate(rows))


@pytest.mark.parametrize(("few", "block"), [(16, 256), (1, 4)])
def test_against_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    for k in (2, 5):
        want = brute(rows, k)
        got = minhash.near_duplicates(df, k).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["n_shingles"] == len(set_of(rows[r["doc_id"]][1], k))
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b  c"), (3, None), (3, "q")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect() if r["doc_id"] is not None)
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (False, 3, 3, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_one_id_on_several_texts(spark, order):
    word = random.Random(4)
    base = [["".join(word.choice("abcdefgh") for _ in range(4)) for _ in range(60)] for _ in range(4)]
    near = lambda w, n: " ".join([*w[:n], "zzzz", *w[n + 1 :]])
    a, b, c, x = (" ".join(w) for w in base)
    rows = [(1, a), (1, b), (2, near(base[0], 9)), (3, near(base[1], 30)), (5, x), (5, c), (9, near(base[2], 3)), (4, near(base[3], 50)), (1, a), (8, ""), (8, c)][::order]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == (want[r["doc_id"]] if r["n_shingles"] else r["doc_id"]) for r in got)
    assert want[2] == want[3] == 1 and want[9] == want[4] == want[8] == 4
    left = sorted(map(tuple, minhash.drop_near_duplicates(df).collect()))
    # by texts alone: a (with 2) under id 1, b (with 3) under id 1, x (with 4) under id 4, c (with 5, 8, 9) under id 5; the row without words
    assert left == sorted([(1, a), (1, b), (4, near(base[3], 50)), (5, c), (8, "")])


def test_texts_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = corpus(7, 60)
    want = brute(rows, 5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_sketch_fills_and_estimates():
    rng = random.Random(9)
    doc, hashes = [], []
    common = [rng.getrandbits(64) for _ in range(900)]
    for d, n in enumerate((1, 2, 1000)):
        hashes += [rng.getrandbits(64) for _ in range(n)] if n < 1000 else common + [rng.getrandbits(64) for _ in range(100)]
        doc += [d] * n
    hashes += common + [rng.getrandbits(64) for _ in range(100)]
    doc += [3] * 1000
    s = minhash.sketches(4, np.array(doc), np.array(hashes, np.uint64))
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[2] == s[3]).mean() - 900 / 1100) < 0.12


def test_words():
    texts = pa.array(["", "  ", None, "a", "A b\tC\x0bd", "é Éx", " a  b ", "abc abd abc"])
    w = Words(texts)
    assert [w.word(i).decode() for i in range(len(w.starts))] == ["a", "a", "b", "c", "d", "é", "Éx", "a", "b", "abc", "abd", "abc"]
    assert w.first.tolist() == [0, 0, 0, 0, 1, 5, 7, 9, 12] and w.hash[9] == w.hash[11] != w.hash[10]
    assert list(slices(texts, 4))[-1] == (7, 8)
    assert Counter(d for lo, hi in slices(texts, 4) for d in range(lo, hi)) == Counter(range(8))


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 2)
    assert {r["doc_id"]: r["component_id"] for r in minhash.op2_minhash(spark, sf).collect()} == want


def test_dropping_keeps_one_of_each_group(spark):
    rows = corpus(5, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(0, rows[0][1], "x")], "doc_id long, text string, _id string")
    want = brute(rows, 5)
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, c in want.items() if i == c)
    extra = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert minhash.drop_near_duplicates(extra).count() == 4
