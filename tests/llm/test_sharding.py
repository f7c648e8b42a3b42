import zlib
from collections import Counter, defaultdict

from stringloom.llm import sharding


def run(spark, rows, n=sharding.SHARDS):
    df = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, source string")
    return sharding.interleave(df, "source", ["doc_id", "size", "text_crc32"], n).collect()


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rows = [(i, i % 50, i * 7, None if i % 31 == 0 else f"s{min(i % 7, 3)}") for i in range(1500)]
    rows += [(5, 5, 5, "s0")] * 40  # repeated rows
    got = run(spark, rows)
    size = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(size) == set(range(24)) and max(size.values()) - min(size.values()) <= 1
    slots = defaultdict(list)
    mix = defaultdict(Counter)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for of in mix.values():
        share = sum(of.values()) / 24
        assert all(abs(of[s] - share) <= 2 for s in range(24))
    again = run(spark, rows[::-1])
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_no_bucket_grows_with_sources_or_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 64)
    largest = []
    real = sharding._ranked

    def ranked(rows, group, bucket, *more):
        largest.append(rows.withColumn("_b", bucket).groupBy(*group, "_b").count().agg({"count": "max"}).first()[0])
        return real(rows, group, bucket, *more)

    monkeypatch.setattr(sharding, "_ranked", ranked)
    for rows in ([(i, 9, i, f"one{i}") for i in range(8000)], [(7, 9, 1, "s")] * 6000 + [(i, 9, i, "s") for i in range(100, 1100)]):
        got = run(spark, rows)
        size = Counter(r["shard"] for r in got)
        assert len(got) == len(rows) and max(size.values()) - min(size.values()) <= 1
    assert max(largest) <= 3 * 64


def test_other_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.selectExpr("doc_id", "n_chars as size", "1L as text_crc32", "source", "1 as _s", "2 as _u")
    assert sharding.interleave(rows, "source", ["doc_id", "size", "text_crc32"]).count() == docs.count()


def test_few_or_no_rows(spark):
    assert run(spark, []) == []
    assert [(r["shard"], r["slot"]) for r in run(spark, [(None, 8, 0, None)])] == [(23, 0)] or len(run(spark, [(None, 8, 0, None)])) == 1


def test_query(spark, sf):
    got = sharding.op4_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows" and r["grown_shard"] is None
