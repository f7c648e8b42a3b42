import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stringloom.llm import lm

lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)) + ["</s>"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (10, 1000, 2**40, 2**63):
        values = np.unique(rng.integers(0, top, 700, dtype=np.uint64))
        made = lm.EliasFano(lm.EliasFano.build(values, "x"), "x")
        asked = np.concatenate([values, rng.integers(0, top, 700, dtype=np.uint64)])
        place = {int(v): i for i, v in enumerate(values)}
        assert (made.value(np.arange(len(values))) == values).all()
        assert made.find(asked, np.zeros(len(asked), int), np.full(len(asked), 3)).tolist() == [place.get(int(v), -1) if place.get(int(v), 9) < 3 else -1 for v in asked]
        assert made.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
    empty = lm.EliasFano(lm.EliasFano.build(np.zeros(0, np.uint64), "x"), "x")
    assert empty.find(np.array([3], np.uint64)).tolist() == [-1]


def test_sent_arrays_come_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.integers(1, 10**10, len(keys))
    batch = lm._send(keys, counts, lm.hash_shard(keys, 3))
    parts = [lm._received(x.as_py()) for x in batch.column(1)]
    assert (np.concatenate([p[0] for p in parts]) == keys).all() and (np.concatenate([p[1] for p in parts]) == counts).all()


def corpus(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return rows + [(1000, None), (1001, ""), (None, "The the of"), (5, "the of the of " * 5000), (5, "a")]


@pytest.mark.parametrize("shard", [8_000_000, 20_000])
def test_scores_by_brute_force(spark, sf, monkeypatch, tmp_path, shard):
    monkeypatch.setattr(lm, "SHARD_WORDS", shard)
    monkeypatch.setattr(lm, "SHARD_PAIRS", shard)
    rows = corpus(spark, sf)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    model = lm.train(df, "file://" + str(tmp_path))
    got = lm.score(df, model).collect()
    words, pairs, starts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            x = tokens(t)
            starts += 1
            words.update(x)
            pairs.update(zip(["<s>", *x], x))
    n, v = sum(words.values()), len(words)
    of = Counter(words)
    of["<s>"] = starts
    used = defaultdict(float)

    def share(a, w):
        c = pairs[a, w]
        return 10 ** (-math.ceil(-math.log10((c - 0.5) / of[a]) * lm.STEP - 1e-9) / lm.STEP) if c >= 2 else 0.0

    for a, w in pairs:
        used[a] += share(a, w)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        known = sum(words[w] > 0 for w in x)
        score = 0.0
        for a, w in zip(["<s>", *x], x):
            left = 1.0 if not used[a] else max(0.01, 1 - used[a])
            score += math.log10(share(a, w) + left * (words[w] + 0.1) / (n + 0.1 * (v + 1)))
        near = [r for r in by[i] if (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(x), known, n, held(i)) and abs(r["base_score"] - base) <= 1e-9 * abs(base)]
        assert near
        assert any(abs(r["score"] - score) <= 0.02 * abs(score) + 1e-6 for r in near)


def test_probabilities_of_a_context_sum_to_one(spark, tmp_path):
    """Over all words, the end and an unseen word: exactly what the rounding down of stored values takes away is missing, and no more."""
    import pyarrow as pa

    train_ids = [i for i in range(3000) if not held(i)]
    names = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(names, 12))) for i in train_ids[:150]] + [(train_ids[200 + i], f"rare{i} w1 w2") for i in range(30)] + [(train_ids[300], "hot " * 400)]
    model = lm.train(spark.createDataFrame(rows, "doc_id long, text string"), "file://" + str(tmp_path), min_pair=1)
    every = sorted({w for _, t in rows for w in t.split()})

    def after(context, word):
        """P(word | context): of the token after the context, the end if there is no word."""
        doc, _, _, p = model.tokens_log10(pa.array([f"{context} {w}" for w in word]))
        return [10 ** p[doc == i][len(context.split())] for i in range(len(word))]

    for context in ("", *names[:6], "rare3", "hot", "w1", "neverseen"):
        total = sum(after(context, ["", "unheardof", *every]))
        assert 0.975 < total <= 1 + 1e-9, (context, total)


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.train(df, "file://" + str(tmp_path / "a"))).count() == 0
    only_held = next(i for i in range(100) if held(i))
    df = spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")
    r = lm.score(df, lm.train(df, "file://" + str(tmp_path / "b"))).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def test_beats_single_words_on_held_out_texts(spark):
    rows = lm.op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_query_keeps_pairs_seen_once(spark, tmp_path):
    train_ids, held_id = [i for i in range(100) if not held(i)], next(i for i in range(100) if held(i))
    rows = [(train_ids[0], "a b c"), (train_ids[1], "a d c"), (train_ids[2], "e f"), (held_id, "e f a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in lm.op8_lm_scoring(spark, str(tmp_path)).collect()}
    words, pairs, of = Counter(), Counter(), Counter()
    for i, t in rows[:3]:
        x = tokens(t)
        words.update(x)
        pairs.update(zip(["<s>", *x], x))
        of.update(["<s>", *x[:-1]])
    n, v = sum(words.values()), len(words)
    share = {p: (c - 0.5) / of[p[0]] for p, c in pairs.items()}
    for i, t in rows:
        x = tokens(t)
        want = 0.0
        for a, w in zip(["<s>", *x], x):
            left = 1 - sum(s for (b, _), s in share.items() if b == a)
            want += math.log10(share.get((a, w), 0.0) + left * (words[w] + 0.1) / (n + 0.1 * (v + 1)))
        assert got[i]["score"] == pytest.approx(want, abs=0.04 * len(x))


def test_left_over_weight_does_not_depend_on_shards(spark, monkeypatch, tmp_path):
    train_ids, held_ids = [i for i in range(3000) if not held(i)], [i for i in range(9000) if held(i)]
    names = [f"w{i}" for i in range(25)]
    rows = [(train_ids[i], f"{a} {names[(7 * i + 3) % 25]} " * 4) for i, a in enumerate(names)]
    rows += [(held_ids[i], f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for shard in (8_000_000, 40):
        monkeypatch.setattr(lm, "SHARD_PAIRS", shard)
        model = lm.train(df, f"file://{tmp_path}/{shard}", min_pair=1)
        scores.append({r["doc_id"]: (r["score"], r["n_tokens"]) for r in lm.score(df, model).collect()})
    assert model.pair_shards > 10
    for i, (score, n) in scores[0].items():
        assert abs(scores[1][i][0] - score) <= 0.04 * n
