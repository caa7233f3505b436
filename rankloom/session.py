"""Session factory and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that the driver's data folders hold, one Parquet file or folder each.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with ANSI mode, adaptive execution and UTC; ``extra`` overrides any setting."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in extra.items()},
    }
    spark = SparkSession.builder.master(master).appName("rankloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors share. A local session without one gets one; a cluster names it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            return None
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="rankloom-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the checkpoint folder from then on: cuts the plan, survives lost executors.

    On a cluster that names no folder the plan is left as it is.
    """
    return df.checkpoint() if checkpoint_folder(df.sparkSession) else df


#: Rows that one task is to hold for a join or a grouping.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows by hash of ``keys``, in a partition for each TASK_ROWS of ``rows``, so that what a task holds doesn't grow with the input.

    Where the session's number of shuffle partitions is enough for that the plan is left as it is.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    folder = checkpoint_folder(spark)
    if folder is None:
        raise RuntimeError("Name a folder that all executors share in spark.checkpoint.dir.")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``TABLES``, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the tables of a data folder."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
