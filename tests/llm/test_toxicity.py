import itertools
import zlib

import numpy as np
import pyarrow as pa

from stringloom.llm import toxicity as t


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    f = t.Field()
    f.start, f.trans = -0.7, np.array([[0.0, -1.1], [0.6, 2.0]])
    lengths = [0, 1, 2, 5, 0, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e = rng.normal(size=first[-1]) * 2
    got = f.marginals(e, first)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        total, hot = 0.0, np.zeros(b - a)
        for ys in itertools.product((0, 1), repeat=b - a):
            s = f.start * ys[0] + sum(e[a + i] * y for i, y in enumerate(ys)) + sum(f.trans[p, q] for p, q in zip(ys, ys[1:]))
            total += np.exp(s)
            hot += np.exp(s) * np.array(ys)
        assert np.allclose(got[a:b], hot / total, atol=1e-6)


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(10, 60)))
        y = int(i % 6 == 0)
        if y:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["Vilewort,", "nastyx", "nastyz", "grimble."])))
        texts.append(" ".join(words))
        labels.append(y)
    return texts, labels


def test_learns_spans_and_documents():
    texts, labels = made_up(600, 1)
    field = t.train(texts, labels)
    other, truth = made_up(200, 9)
    scores, places = t.judge(pa.array(other), field)
    assert ((scores >= 0.5) == np.array(truth)).mean() > 0.97
    marked = {other[i][int(a) : int(b)].lower().strip(",.") for i, p in enumerate(places) for a, b in (x.split(":") for x in p.split(",") if x)}
    assert marked == {"vilewort", "nastyx", "nastyz", "grimble"}
    empty, spans = t.judge(pa.array(["", None, "  ", "é nastyx é " + "word " * 30_000]), field)
    assert (empty[:3] < 0.5).all() and spans[:3] == ["", "", ""] and "2:8" in spans[3]


def test_one_kind_of_label_or_none():
    for texts, labels in (([], []), (["a"], [1]), (["a", "b"], [0, 0])):
        assert (t.judge(pa.array(["a b", ""]), t.train(texts, labels))[0] < 0.5).all()


def test_query(spark, sf):
    rows = t.op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in t.op6_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic = [p for y, p in held if y]
    clean = [p for y, p in held if not y]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.03


def test_tables(spark):
    texts, labels = made_up(300, 4)
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(None, None, 1), (3, texts[3], 1)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    left = t.drop_toxic(docs, marks)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert not kept & {i for i, y in enumerate(labels) if y} and len(kept) > 240
    assert t.drop_toxic(docs, marks.limit(0)).count() == docs.count() and t.drop_toxic(docs.limit(0), marks).count() == 0
