import random

import pytest
from pyspark.sql import functions as F

from stringloom import catalog
from stringloom.api import Codec, payload
from stringloom.config import Config
from stringloom.errors import Defect, InvalidColumn, OutputTooSmall
from stringloom.functions.dictionary import Dictionary
from stringloom.operators import codec as ops
from stringloom.operators import train
from stringloom.operators.matcher import Matcher
from stringloom.operators.train import learn
from stringloom.sources import interchange, tables


def corpora():
    rng = random.Random(7)
    yield [b"https://www.example.com/page", b"https://www.example.com/data", b"https://www.test.org/page", b"ftp://files.example.com/x"] * 60
    yield [b"a" * 40] * 50
    yield [b"ab" * 8] * 50
    yield [bytes(rng.randrange(97, 123) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    yield [bytes(rng.randrange(256) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    yield [bytes(rng.randrange(97, 100) for _ in range(rng.randint(0, 100))) for _ in range(150)]
    yield [b"".join(bytes([97 + (i + j) % 26]) for j in range(16)) for i in range(20)]


@pytest.mark.parametrize("bits", range(9, 17))
def test_training_invariants(bits):
    for rows in corpora():
        total = sum(map(len, rows))
        d = learn(rows, Config(max_dict_bits=bits, threshold=1.0), total)
        assert d.sorted and d.complete and d.num_tokens <= 1 << bits
        assert d == learn(rows, Config(max_dict_bits=bits, threshold=1.0), total)
        for accelerate in (True, False):
            m = Matcher(d, accelerate)
            for r in rows[:40]:
                assert m.codes(r) == d.tokenize(r)
                assert ops.decode_bytes(m.codes(r), d) == r


def test_nothing_to_learn():
    assert learn([], Config()).num_tokens == 256
    assert learn([b""], Config()).num_tokens == 256
    assert learn([b"xyxyxyxy"], Config(fixed_threshold=2)).num_tokens > 256


def test_matchers_agree_on_random_dictionaries():
    rng = random.Random(2)
    for _ in range(200):
        d = Dictionary.of({bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(2, 16))) for _ in range(25)})
        text = bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 200)))
        assert Matcher(d, True).codes(text) == Matcher(d, False).codes(text) == d.tokenize(text)


def test_round_trip_with_nulls_and_large_codes(spark):
    full = Dictionary(sorted([*(bytes([b]) for b in range(256)), *(b"\xff" + i.to_bytes(2, "big") for i in range(65536 - 256))]))
    values = [None, b"", b"abc", b"\xff\xfe\xfe", b"\xff\x80\x01z\0"]
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "k int, v binary")
    rows = ops.encode(df, "v", full)
    got = {r["k"]: r for r in ops.decode(rows, full).collect()}
    for i, v in enumerate(values):
        assert (None if got[i]["value"] is None else bytes(got[i]["value"])) == v
        assert (got[i]["codes"] is None) == (v is None)
        if v is not None:
            assert bytes(got[i]["packed"]) == ops.pack(got[i]["codes"])
    assert max(c for r in got.values() if r["codes"] for c in r["codes"]) > 32767
    again = rows.select("k", ops.unpack(F.col("packed")).alias("c"), "codes").collect()
    assert all(r["c"] == r["codes"] for r in again)


def test_fit_is_the_same_for_any_partitioning(spark, sf):
    df = tables.table(spark, sf, "documents")
    a = Codec.fit(df, "text", Config(threshold=1.0))
    b = Codec.fit(df.repartition(7), "text", Config(threshold=1.0))
    assert a == b and a.dictionary.num_tokens > 300
    small = Config(max_sample_bytes=60_000)
    assert Codec.fit(df, "text", small) == Codec.fit(df, "text", small)


def test_the_sample_is_of_rows_and_bounded(spark):
    """60 % of the rows are one value: it is in every sample, about so often, and no seed reads more than its budget."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 5 < 3, F.lit("the hot value of this table")).otherwise(F.concat(F.lit("cold "), F.xxhash64("id").cast("string"))).alias("v"))
    for seed in range(12):
        config = Config(threshold=0.05, seed=seed, max_sample_bytes=100_000)
        chosen, budget = train.sample(rows, "v", config)
        assert budget <= 100_000
        hot, every = chosen.where(F.col("v") == F.lit(b"the hot value of this table")).agg(F.sum("m")).first()[0], chosen.agg(F.sum("m")).first()[0]
        assert abs(hot / every - 0.6) < 0.03 and chosen.agg(F.sum(F.octet_length("v"))).first()[0] < 3 * budget + 200_000
    made = Codec.fit(rows, "v", Config(threshold=0.05, max_dict_bits=9, max_sample_bytes=100_000))
    assert len(made.dictionary.tokenize(b"the hot value of this table")) <= 3
    assert learn([b"ab" * 5000, b"never read" * 9], Config(), 6000) == learn([b"ab" * 3000], Config())


def test_row_access_and_capacity(spark):
    df = tables.from_values(spark, ["apple", "banana", "apricot", "cherry", "apple"])
    made = Codec.fit(df, "v", Config(threshold=1.0))
    rows = made.transform(df)
    assert [r["value"] for r in made.decode_row(rows, "row_id", 2).collect()] == ["apricot"]
    assert payload(made.decode(rows), "row_id") == b"applebananaapricotcherryapple"
    codes = made.dictionary.tokenize(b"banana")
    with pytest.raises(OutputTooSmall):
        ops.decode_bytes(codes, made.dictionary, 5)
    with pytest.raises(InvalidColumn):
        ops.decode_bytes([99999], made.dictionary)


def test_bad_code_is_an_error(spark):
    df = spark.createDataFrame([([1, 400],)], "codes array<int>")
    with pytest.raises(Exception, match=Defect.CODE_OUT_OF_RANGE.value):
        ops.decode(df, Dictionary.of()).collect()


def test_interchange(spark):
    df = tables.from_buffers(spark, b"skipalphabetaunused", [4, 9, 13])
    assert [bytes(r["v"]) for r in df.orderBy("row_id").collect()] == [b"alpha", b"beta"]
    made = Codec.fit(df, "v", Config(threshold=1.0))
    chunks = interchange.export(made.transform(df), made.dictionary, ["row_id"])
    back = interchange.load(chunks, ["row_id"]).orderBy("row_id").collect()
    assert [bytes(r["value"]) for r in back] == [b"alpha", b"beta"]
    c = chunks.first()
    d, rows = interchange.rows_of(c["dict_bytes"], c["dict_offsets"], c["codes"], c["row_offsets"])
    for codes, offsets, defect in ((b"\xff\xff", [0, 1], Defect.CODE_OUT_OF_RANGE), (b"\0\0", [0, 2], Defect.BAD_ROW_OFFSETS), (b"\0\0", [], Defect.BAD_ROW_OFFSETS), (b"\0\0\0\0", [0, 2, 1, 2], Defect.BAD_ROW_OFFSETS)):
        with pytest.raises(InvalidColumn) as e:
            interchange.rows_of(d.padded, d.offsets, codes, offsets)
        assert e.value.defect is defect


def test_sources(spark, sf):
    assert tables.urls(spark, 1000).select("url").distinct().count() > 900
    assert tables.string_column(tables.table(spark, sf, "part")).columns == ["v"]
    with pytest.raises(ValueError):
        tables.from_buffers(spark, b"ab", [0, 3])
    with pytest.raises(ValueError):
        tables.string_column(spark.range(3))


def test_stream(spark, sf, tmp_path):
    from stringloom.streaming.transforms import search_stream

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    made = Codec.fit(docs, "text", Config(max_sample_bytes=60_000))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = search_stream(stream, made, "thing").select("doc_id").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[0] for r in docs.where(F.contains("text", F.lit("thing"))).select("doc_id").collect()}
    assert {r[0] for r in spark.table("found").collect()} == want and want


def test_decoded_length_counts_rows_without_ids_and_with_equal_ones(spark, tmp_path):
    """Each row counts once, for its own language, as in the SQL."""
    rows = [(1, "abc", "en"), (1, "dé", "de"), (None, "xyzw", "en"), (2, None, "fr"), (3, "", None), (3, "four", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["decoded_length"](spark, str(tmp_path)).collect()
    assert {r["lang"]: r["n_bytes"] for r in got} == {"en": 7, "de": 3, "fr": None, None: 4} and len(got) == 4
