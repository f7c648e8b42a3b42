import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.api import Codec
from stringloom.config import Config
from stringloom.errors import FrequencyIndexMismatch, IndexDefect, InvalidFrequencyIndex, MissingByteToken, PatternTooLong
from stringloom.functions.dictionary import Dictionary, TokenRange
from stringloom.operators import frequency, predicates
from stringloom.operators.codec import encode, pack
from stringloom.plans.automaton import Automaton
from stringloom.plans.cover import Cover, Scan
from stringloom.sources import tables

ALPHABET = b"abc\0\xff"


def some(rng, most, alphabet=ALPHABET):
    return bytes(rng.choice(alphabet) for _ in range(rng.randint(0, most)))


def test_prefix_ranges_by_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        d = Dictionary.of({some(rng, 6) + b"ab" for _ in range(12)})
        for _ in range(30):
            needle, row = some(rng, 8), some(rng, 12)
            if rng.random() < 0.5:
                row = needle + row
            q = predicates.PrefixQuery(needle, d)
            codes = d.tokenize(row)
            want = row.startswith(needle)
            assert q.matches(codes) is want
            p = pack(codes)
            assert any(lo <= p and (hi is None or p < hi) for lo, hi in q.bounds()) is want


def test_upper_bound_carries():
    assert predicates._above([5, 0xFFFF, 0xFFFF]) == pack([6])
    assert predicates._above([0xFFFF]) is None


def every_tokenization(text, tokens):
    if not text:
        yield []
    for i, t in enumerate(tokens):
        if text.startswith(t):
            for rest in every_tokenization(text[len(t) :], tokens):
                yield [i, *rest]


def test_automaton_takes_any_tokenization():
    d = Dictionary([b"a", b"aa", b"ab", b"aba", b"abab", b"b", b"ba", b"bab"], check=False)
    texts = [bytes(t) for n in range(7) for t in __import__("itertools").product(b"ab", repeat=n)]
    for pattern in [t for t in texts if len(t) <= 4]:
        m = Automaton(pattern, d)
        for text in texts[:: 3 if len(pattern) > 2 else 1]:
            for codes in every_tokenization(text, d.tokens):
                assert m.accepts(codes) is (pattern in text)


def valid_cut(plan):
    cut = {id(e) for e in plan.cut}
    seen, todo = {0}, [0]
    while todo:
        at = todo.pop()
        for e in plan.edges:
            if e.start == at and id(e) not in cut and e.end not in seen:
                seen.add(e.end)
                todo.append(e.end)
    return len(plan.pattern) not in seen


def test_cover_is_sound_and_a_cut():
    rng = random.Random(5)
    for _ in range(250):
        d = Dictionary.of({some(rng, 5, b"abc") + b"ab" for _ in range(10)})
        rows = [some(rng, 30, b"abc") for _ in range(20)]
        codes = [d.tokenize(r) for r in rows]
        counts = [0] * d.num_tokens
        for c in codes:
            for x in c:
                counts[x] += 1
        index = frequency.FrequencyIndex.of_counts(counts)
        pattern = some(rng, 9, b"abc") or b"a"
        for prefix in (index.cumulative, [0] * (d.num_tokens + 1), None):
            plan = Scan(pattern, d, prefix)
            assert plan.whole or valid_cut(plan)
            table = predicates.admits(plan.cover, d.num_tokens)
            for r, c in zip(rows, codes):
                assert pattern not in r or table[c].any()
        plan = Scan(pattern, d, index.cumulative)
        assert plan.expected_hits(index.cumulative) == sum(x in plan.cover for c in codes for x in c)


def test_cover_of_runs():
    c = Cover.of([(7, 8), (0, 0), (3, 3), (6, 7), (1, 1), (8, 8)])
    assert c.points == [3] and c.ranges == [(0, 1), (6, 8)] and 7 in c and 2 not in c


def test_pattern_lengths_and_mismatch():
    d = Dictionary.of()
    assert Automaton(b"x" * 255, d).states == 256
    with pytest.raises(PatternTooLong) as e:
        Automaton(b"x" * 256, d)
    assert (e.value.length, e.value.max) == (256, 255)
    assert Scan(b"ab" * 32767 + b"c", d, None).cover is not None
    with pytest.raises(PatternTooLong):
        Scan(b"x" * 65536, d, None)
    with pytest.raises(FrequencyIndexMismatch):
        Scan(b"", d, [0, 1])
    with pytest.raises(MissingByteToken):
        Scan(b"zz", Dictionary([b"a", b"b"], check=False), None)


def test_frequency_index():
    f = frequency.FrequencyIndex.of_counts([2, 0, 3, 1, 0])
    assert f.cumulative == [0, 2, 2, 5, 6, 6] and f.frequency(2) == 3 and f.total == 6
    assert f.range_frequency(TokenRange(1, 3)) == 4 and f.range_frequency(TokenRange(1, 0)) == 0
    for bad, defect in (([], IndexDefect.EMPTY), ([1], IndexDefect.FIRST_NOT_ZERO), ([0, 2, 1], IndexDefect.DECREASING), ([0] * 65538, IndexDefect.TOO_MANY_TOKENS)):
        with pytest.raises(InvalidFrequencyIndex) as e:
            frequency.FrequencyIndex(bad)
        assert e.value.defect is defect
    with pytest.raises(InvalidFrequencyIndex):
        frequency.FrequencyIndex.of_counts([2**32])


def test_frequency_on_tables(spark):
    df = spark.createDataFrame([([2, 0, 2],), ([3, 2, 0],), ([],), (None,)], "codes array<int>")
    d = Dictionary([b"a", b"b", b"c", b"d", b"e"], check=False)
    assert frequency.build(df, d).cumulative == [0, 2, 2, 5, 6, 6]
    rows = sorted(tuple(r) for r in frequency.counts(df, d).collect())
    assert rows == [(0, 2, 0), (1, 0, 2), (2, 3, 2), (3, 1, 5), (4, 0, 6)]
    assert frequency.sampled(df, d, share=1.0).total == 6
    assert frequency.from_table(frequency.counts(df, d)).cumulative == [0, 2, 2, 5, 6, 6]
    assert (frequency.sample_share(10), frequency.sample_share(10_000)) == (1.0, 0.04)
    bad = spark.createDataFrame([([9],)], "codes array<int>")
    with pytest.raises(InvalidFrequencyIndex):
        frequency.build(bad, d)
    assert frequency.sampled(bad, d, share=1.0, strict=False).total == 0


WORDS = ["", "hello world", "world peace", "xabcabcy", "aaaaab", "aabaaabaa", "appappapple", "appapple pie", "an appappappapple", "appappaple", "apple", "abababab", "ababx abab", "apple", "é日本\0x"]


def test_searches_equal_plain_ones(spark):
    df = tables.from_values(spark, WORDS)
    made = Codec.fit(df, "v", Config(threshold=1.0, fixed_threshold=2))
    rows = made.transform(df).cache()
    index = made.frequencies(rows)
    values = [w.encode() for w in WORDS]
    for needle in ["", "a", "ab", "apple", "appapple", "abab", "world", " ", "日", "zzz", "an appappappapple", "aabaaabaa", "\0"]:
        n = needle.encode()
        ids = lambda found: sorted(r["row_id"] for r in found.select("row_id").collect())
        assert ids(made.equal_to(rows, needle)) == [i for i, v in enumerate(values) if v == n]
        assert ids(made.starting_with(rows, needle)) == [i for i, v in enumerate(values) if v.startswith(n)]
        want = [i for i, v in enumerate(values) if n in v]
        assert ids(made.containing(rows, needle)) == want
        assert ids(made.containing_with_scan(rows, needle, index)) == want
        assert ids(made.containing_with_scan(rows, needle)) == want
        assert ids(made.containing_with_scan(rows, needle, made.sampled_frequencies(rows))) == want if needle in ("a", "apple", "") else True


def test_long_pattern(spark):
    long = "abcdefghijklmnop" * 20
    df = tables.from_values(spark, [long + "x", long[:-1], "y" + long, ""])
    made = Codec.fit(df, "v", Config(threshold=1.0))
    assert sorted(r["row_id"] for r in made.containing_with_scan(made.transform(df), long).collect()) == [0, 2]


def test_pushdown(spark, sf, tmp_path):
    df = tables.table(spark, sf, "pages").select("page_id", "url")
    made = Codec.fit(df, "url")
    made.transform(df).sortWithinPartitions("packed").write.parquet(str(tmp_path / "enc"))
    stored = spark.read.parquet(str(tmp_path / "enc"))
    for found in (made.equal_to(stored, "http://x"), made.starting_with(stored, "https://m.")):
        plan = found.select("page_id")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "packed" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_bad_codes_match_nothing(spark):
    d = Dictionary.of([b"ab"])
    df = spark.createDataFrame([(0, [97, 9999, 99]), (1, [97, 99])], "k int, codes array<int>")
    assert [r["k"] for r in df.where(predicates.contains(F.col("codes"), "ab", d)).collect()] == [1]
    assert encode(df.select("k", F.lit("ab").alias("s")), "s", d).first()["codes"] == [d.tokens.index(b"ab")]


def test_vectorised_rows_equal_plain_ones():
    """The automaton and the verifier on arrays, against the values; rows next to each other must not leak into one another."""
    rng = random.Random(11)
    for _ in range(150):
        d = Dictionary.of({some(rng, 6, b"abc") + b"ab" for _ in range(10)})
        rows = [some(rng, 40, b"abc") for _ in range(15)] + [b"", b"ab" * 30]
        codes = [d.tokenize(r) for r in rows]
        flat = np.array([c for x in codes for c in x], np.int32)
        at = np.cumsum([0, *map(len, codes)])
        for pattern in (some(rng, 7, b"abc"), b"ab" * rng.randint(1, 20), rows[3][2:9]):
            want = [pattern in r for r in rows]
            assert Automaton(pattern, d).rows(flat, at).tolist() == want
            if pattern:
                plan = Scan(pattern, d, None)
                for cover in {id(w.cover): w.cover for w in plan.ways}.values():
                    assert predicates._verified(pattern, d, cover)(flat, at).tolist() == want
    d = Dictionary.of([b"ab"])
    a, b, ab = (d.tokens.index(t) for t in (b"a", b"b", b"ab"))
    flat = np.array([a, 9999, b, a, b, ab], np.int32)
    for f in (Automaton(b"ab", d).rows, predicates._verified(b"ab", d, None)):
        assert f(flat, np.array([0, 3, 5, 6])).tolist() == [False, True, True]


def test_every_way_to_scan_finds_the_same(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    made = Codec.fit(docs, "text", Config(max_sample_bytes=100_000))
    rows = made.transform(docs).cache()
    index = made.frequencies(rows)
    for pattern in ("thing", "e", "of the", "ciónes", "QQzz", " ".join(["the"] * 90)):
        want = {r[0] for r in docs.where(F.contains("text", F.lit(pattern))).select("doc_id").collect()}
        plan = made.plan(pattern, index)
        assert [w.cost for w in plan.ways] == sorted(w.cost for w in plan.ways) and plan.way.kind in plan.explain()
        for kind in {w.kind for w in plan.ways}:
            got = predicates.contains_scan(rows, pattern, made.dictionary, index.cumulative, way=kind)
            assert {r[0] for r in got.select("doc_id").collect()} == want, (pattern, kind)
    assert made.plan("QQzz", index).way.kind == "native" and made.plan("e", index).way.kind in ("decode", "automaton")
    with pytest.raises(ValueError):
        predicates.contains_scan(rows, " ".join(["the"] * 90), made.dictionary, way="automaton")


def test_wide_rows_travel_in_batches_of_bounded_bytes(spark):
    """Workers get a few megabytes at a time, not 10,000 rows; the rows found are the same."""
    text = F.concat(F.repeat(F.lit("abc"), 3000), F.when(F.col("id") % 7 == 0, "z").otherwise(""))
    df = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 50 > 0, text).alias("v"))
    made = Codec("v", Dictionary.of())
    rows = made.transform(df, drop=True, codes=False)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    for frame in (df, rows, made.decode(rows)):
        got = frame.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 1500 and max(r["size"] for r in got) <= tables.BATCH_BYTES + 30_000
    want = [i for i in range(1500) if i % 50 and i % 7 == 0]
    assert sorted(r["id"] for r in made.containing(rows, "z").select("id").collect()) == want
    assert sorted(r["id"] for r in made.containing_with_scan(rows, "z").select("id").collect()) == want
