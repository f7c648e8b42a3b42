"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

toxicity            documents that the field rejects go
near_duplicates     one document of each group stays (five-word shingles, similarity 0.8 or more)
decontamination     documents that hold a benchmark item go
personal_data       spans are replaced by their kind in angle brackets
encoding            texts are encoded; the rows are what operator 10 gives

All stages but the last return the columns of their input.

Defined results: a null or empty text is not toxic, no near duplicate and no leak, has no personal data and no tokens, so its row stays;
rows without a doc_id stay in the near-duplicate stage; of near duplicates (ties and repeated rows too) the least document stays once,
while rows of one doc_id whose texts are unlike both stay; very long texts are worked on whole; an empty table gives no rows; other
columns are carried along, whatever their names (n_chars follows the text where personal data is replaced).
"""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stringloom.llm import bpe, common, decontamination, minhash, pii, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs))


def _in_small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        common.give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _in_small_batches(remove_toxic)),
    ("near_duplicates", _in_small_batches(remove_near_duplicates)),
    ("decontamination", _in_small_batches(remove_benchmark)),
    ("personal_data", _in_small_batches(replace_personal_data)),
    ("encoding", _in_small_batches(encode)),
]

#: SQL has no classifier, sketch or tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return common.stage(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
