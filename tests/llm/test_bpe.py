import hashlib
import random

import numpy as np

from stringloom.llm import bpe

ODD = ["", " ", "  a b", "a  b", "a\n b c", "x <|endoftext|> y", "<|endoftext|>", " don't  stop", "é à ü ñ b 　 c", "a\x00b c", "tab\t x", "1 2 3 " * 500, "日本 語 " * 100, "a" * 5000, " " * 3000, "\n \n a b c" * 300, "a.b, c.. d ,e"]


def test_equals_the_library_and_round_trips():
    for bits in (3, 9):
        w = bpe.ChunkEncoder(bits=bits)
        ids = w.encode(ODD)
        assert ids == w.library(ODD)
        assert w.decode(ids) == [w.tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids] == ODD


def test_random_texts():
    rng = random.Random(4)
    parts = ["a", "b", " ", " ", "\n", "é", "<|endoftext|>", "'s", "1", ".", ",", "_", "\x1c", "\x85", "\u200b", "日", "the quick"]
    w = bpe.ChunkEncoder(bits=3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    assert w.encode(texts) == w.library(texts)


def test_shared_passages_are_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SHARD_STRETCHES", 20)
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    texts = ["one start " + passage, "quite another beginning " + passage + " and end", passage + " " + passage]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (7, "alone here"), (0, texts[0])], "doc_id long, text string").repartition(3)
    store = bpe.build_store(df)
    assert store.shards > 1
    w = bpe.ChunkEncoder()
    for t in texts:
        before = w.encoded
        assert w.encode([t], store) == w.library([t])
        assert w.encoded - before <= 6
    assert w.reused > 60
    shared = [store._file("ids", s) for s in range(store.shards)]
    assert sum(len(x["k1"]) for x in shared if x) == len({key for t in texts for key, _ in w.plan(t.encode())} & {k for k in _shared(w, texts)})


def _shared(w, texts):
    from collections import Counter

    seen = Counter(key for t in [*texts, texts[0]] for key, _ in w.plan(t.encode()))
    return [k for k, n in seen.items() if n > 1]


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in bpe.op10_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = bpe.ChunkEncoder().library([d["text"] or "" for d in docs])
    for d, x in zip(docs, ids):
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "x y", 6), (3, "w " * 60_000, 7)], "doc_id long, text string, ids int")
    got = bpe.digests(bpe.encode(df)).collect()
    assert sorted(r["n_tokens"] for r in got)[:2] == [0, 0] and len(got) == 4
    assert bpe.digests(bpe.encode(df.limit(0))).count() == 0
