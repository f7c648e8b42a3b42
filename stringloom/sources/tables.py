"""Input columns: tables, byte lists and buffers, and a seeded URL generator."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stringloom.errors import InvalidArg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: a worker holds several times as much while it works on one, and an executor has up to two workers a core.
BATCH_BYTES = 2_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a bound of its own: 10,000 rows are too much where values are wide."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


#: Scan partitions up to which a table is dealt out over the cluster's cores.
FEW_PARTITIONS = 8


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if it is read as a few partitions only (a small file of one row group is one task's work otherwise).

    That bounds what is shuffled to a few file splits; tables of more partitions, and streams, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    n = df.rdd.getNumPartitions()
    return df.repartition(cores) if n < cores and n <= FEW_PARTITIONS else df


def string_column(df: DataFrame, column: str | None = None, null_as_empty: bool = True) -> DataFrame:
    """One column as `v`: the named one, or the first string column; NULL as the empty string if asked for."""
    column = column or next((f.name for f in df.schema.fields if isinstance(f.dataType, StringType)), None)
    if column is None:
        raise InvalidArg("the table has no string column")
    v = F.col(column)
    return df.select((F.coalesce(v, F.lit("")) if null_as_empty else v).alias("v"))


def from_values(spark: SparkSession, values: Sequence[bytes | str]) -> DataFrame:
    """(row_id, v) of a list of byte strings, in order."""
    return spark.createDataFrame([(i, bytearray(v.encode() if isinstance(v, str) else v)) for i, v in enumerate(values)], "row_id long, v binary")


def from_buffers(spark: SparkSession, data: bytes, offsets: Sequence[int]) -> DataFrame:
    """(row_id, v): value i is data[offsets[i]:offsets[i + 1]]; the first offset may be above zero."""
    if not len(offsets) or offsets[-1] > len(data) or any(b < a for a, b in zip(offsets, offsets[1:])) or offsets[0] < 0:
        raise InvalidArg("offsets must be ascending and lie within the bytes")
    return from_values(spark, [data[a:b] for a, b in zip(offsets, offsets[1:])])


def urls(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(row_id, url): n seeded synthetic URLs of a few hosts, sections and many pages, generated where they are used."""
    hosts = F.array(*(F.lit(f"{sub}.{name}.example") for sub in ("www", "m", "shop") for name in ("news", "maps", "video")))
    sections = F.array(*map(F.lit, ("search", "item", "user/profile", "cart", "article/2024", "tag", "static/img")))

    def pick(options, salt, size):
        return F.get(options, F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(size)).cast("int"))

    page = F.pmod(F.xxhash64(F.lit(seed), F.lit("page"), "id"), F.lit(65_536))
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("https://"), pick(hosts, "host", 9), F.lit("/"), pick(sections, "section", 7), F.lit("?id="), page.cast("string")).alias("url"))
