"""Shared storage, exact distributed ranks and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where none is named, a local session makes a temporary folder and names it; on a cluster that is an error, as
    executors don't share local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Name a folder that all executors share in spark.checkpoint.dir.")
        path = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long rows: batches that Python workers get hold this many of them at most.

    The setting is read when a plan runs, after the operator has returned it, so it stays for the session; a lower one is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, folder)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else kept; all-ASCII values take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def exact_cumsum(df: DataFrame, by: list[str], bucket: str, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``weight`` over the rows before each row within ``by``, and ``name_total``.

    ``bucket`` is a column, monotone in ``order``, that splits ``by`` into even parts. Rows are sorted inside
    (by, bucket) only and the sums of the buckets before are added, so no group of ``by`` has to fit in one
    task. Neither ``by`` nor ``bucket`` may be null.
    """
    df = df.withColumn("__w", weight.cast("long"))
    sums = df.groupBy(*by, bucket).agg(F.sum("__w").alias("__s"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        bucket,
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"),
        F.sum("__s").over(whole).alias(f"{name}_total"),
    )
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("__in", F.sum("__w").over(inside))
        .join(offsets, [*by, bucket])
        .withColumn(name, F.col("__before") + F.col("__in") - F.col("__w"))
        .drop("__before", "__in", "__w")
    )


def exact_rank(df: DataFrame, by: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the 0-based rank of each row within ``by``, and ``name_total``, the rows of ``by``."""
    return exact_cumsum(df, by, bucket, order, F.lit(1), name)
