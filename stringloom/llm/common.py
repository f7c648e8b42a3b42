"""What the operators of this subpackage share: inputs, staged tables, connected components."""
from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import warnings

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.sources.tables import spread

#: Words as the contracts define them: runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts are wide, and executors hold several batches of them at once, in the JVM and in the workers.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows; queries and the pipeline do so before they work on texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, in small batches, dealt out over the cores if it is a few file splits only."""
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a temporary one of this machine (with a warning) only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark.sparkContext, "_stringloom_dir", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="stringloom-")
            warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables go to {folder}, which a cluster does not share", stacklevel=2)
            spark.sparkContext._stringloom_dir = folder
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freeing(run):
    """A function over Arrow batches that gives its memory back when it ends: workers are used again, and beside others."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def give_back(spark: SparkSession) -> None:
    """Has executors collect their heap's garbage, after which a heap that an earlier stage made grow shrinks again.

    In the check's full run an executor's heap went from 1,539 MB to 194 MB so. A large heap may count twice, too: a process that an
    executor starts shares the JVM's memory until it runs a program of its own (Hadoop's local files start chmod where its native library
    is missing). One task a core, so that most likely each executor gets one; where SQL may not call methods, nothing is done.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    with contextlib.suppress(PySparkException):
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(col="doc_id"):
    """crc32 of an id written as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that is reachable.

    Alternating star contraction: each round links the neighbours of every node to the smallest of them (the larger ones first, then
    the smaller ones), so a long chain halves and a hub sheds its links. Only links travel, a node's neighbours are never gathered in
    one task (a min that combines before the shuffle and a join that splits skewed keys), and each round is a written table.
    """
    spark = edges.sparkSession
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above the node go to the least of its closed neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the lower neighbours of a node and the node itself go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stage(small, "links")
        # a fixed point: every node has one lower neighbour, and that one has none
        marks = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        old = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        links = new
        if (marks["n"], marks["h"]) == (old["n"], old["h"]):
            break
    else:
        raise RuntimeError("components: no fixed point")
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
