from stringloom.llm import token_counts as t
from stringloom.llm.common import shared_dir

TEXTS = ["", " ", None, "Hello  world", "a\tb\n\nc", "it's <|endoftext|> fine", "x\u00a0y\u2003z", "\x1cq\x1dr", "ΑΣ ς", "e\u0301 é", "1234 ...!", "日本語 text", "word " * 3000, "x" * 5000, "Hello  world"]


def library(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(t.TOKENIZER)
    made.no_truncation()
    made.no_padding()
    return [len(made.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_words_count_as_whole_texts():
    assert t.WordCounter().counts([x or "" for x in TEXTS]) == library(TEXTS)


def test_cache_is_used_and_grows(spark, tmp_path):
    cache = "file://" + str(tmp_path / "cache")
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id long, text string, digest string")
    got = {r["doc_id"]: r for r in t.token_counts(df, cache).collect()}
    assert [got[i]["n_tokens"] for i in range(len(TEXTS))] == library(TEXTS)
    assert [got[i]["n_bytes"] for i in range(len(TEXTS))] == [len((x or "").encode()) for x in TEXTS]
    held = spark.read.parquet(cache).count()
    more = spark.createDataFrame([(1, "Hello  world", "c"), (2, "something new", "c")], df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    assert t.token_counts(more, cache).count() == 2
    assert spark.read.parquet(cache).count() == held + 1  # the known text was not encoded again
    assert t.token_counts(df.limit(0), cache).count() == 0


def test_query(spark, sf):
    rows = t.op3_token_counts(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, library(texts.values())))
    assert len(rows) == len(texts) and all(r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (want[r["doc_id"]] > 2048) for r in rows)
    assert shared_dir(spark)


def test_a_second_run_meets_the_stored_counts(spark, sf, monkeypatch):
    first = sorted(map(tuple, t.op3_token_counts(spark, sf).collect()))
    asked = []
    real = t._encode

    def counted(path):
        run = real(path)
        seen = spark.sparkContext.accumulator(0)
        asked.append(seen)

        def rows(batches):
            def tally():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return run(tally())

        return rows

    monkeypatch.setattr(t, "_encode", counted)
    assert sorted(map(tuple, t.op3_token_counts(spark, sf).collect())) == first
    assert sum(a.value for a in asked) == 0
