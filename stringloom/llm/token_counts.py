"""Operator 3: token counts through a digest cache.

The normalised content (white space collapsed, ends trimmed: the tokenizer drops white space) and the tokenizer's version each get a
digest. Their pair is joined to the cache table; only distinct contents that the cache lacks are encoded, and their counts are
appended. The texts travel once, to the place where equal digests meet, and equal ones are merged before the shuffle.

Runs may share a cache at the same time: a digest that two of them append counts once. Appends are whole files, so a run that fails leaves
nothing half-written to be read.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated ids give a row each; a very long text is
encoded alone and whole; an empty table gives no rows; other columns are kept.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Distinct words whose counts a worker remembers at once; the memory is emptied when full.
MEMORY = 400_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: White space for which the tokenizer's, Java's and Python's ideas differ: such texts go to the library as they are.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")


def tokenizer_version(path: str = TOKENIZER) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounter:
    """Counts the tokens of whole texts.

    The tokenizer's normaliser and splitter never join what white space separates, so a text has the tokens of its words; each
    distinct word is encoded once while it is remembered.
    """

    def __init__(self, path: str = TOKENIZER):
        import os

        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.seen: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if ODD_SPACE.search(text):
                out += self.whole([text])
                continue
            words = text.split()
            try:
                out.append(sum(map(self.seen.__getitem__, words)))
            except KeyError:
                if len(self.seen) > MEMORY:
                    self.seen = {}
                new = list({w for w in words if w not in self.seen})
                self.seen.update(zip(new, self.whole(new)))
                out.append(sum(map(self.seen.__getitem__, words)))
        return out


def _encode(path: str):
    @common.freeing
    def run(batches):
        counter = WordCounter(path)
        for batch in batches:
            names = batch.schema.names
            digests, texts = batch.column(names.index("digest")), batch.column(names.index("content"))
            yield pa.RecordBatch.from_arrays([digests, pa.array(counter.counts(texts.to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache_path: str, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with n_bytes and n_tokens (which replace columns of that name); counts of contents that the table at cache_path lacks are appended to it first."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    docs = docs.drop("n_bytes", "n_tokens")
    content = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.SPACES, " "))
    keyed = docs.withColumn("__content", content).withColumn("__digest", F.unhex(F.md5(F.col("__content").cast("binary"))))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
        missing = keyed.select(F.col("__digest").alias("digest"), F.col("__content").alias("content")).join(known, "digest", "left_anti")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = keyed.select(F.col("__digest").alias("digest"), F.col("__content").alias("content"))
    distinct = missing.groupBy("digest").agg(F.first("content").alias("content"))
    counted = distinct.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    known = known.select(F.col("digest").alias("__digest"), "n_tokens").dropDuplicates(["__digest"])  # two runs may have appended one digest
    return keyed.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).drop("__content").join(known, "__digest").drop("__digest")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is one table of the shared folder for each version of the tokenizer, which later runs go on with."""
    cache = f"{common.shared_dir(spark)}/token-cache-{tokenizer_version()[:16]}"
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, cache).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
