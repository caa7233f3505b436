"""Incremental refresh: new measurement files become rows of the stored long table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.evidence import UNIFIED

LONG_SCHEMA = ", ".join(f"{c} {'double' if c == 'value_raw' else 'string'}" for c in UNIFIED)


def arriving(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Unified rows of Parquet files as they arrive in a folder; rows without entity or feature go."""
    rows = spark.readStream.schema(LONG_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.dropna(subset=["DepMap_ID", "gene_symbol"]).withColumn("gene_symbol", F.upper(F.trim("gene_symbol")))


def refresh(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all files that have arrived since the last refresh to the long table, by source, and stops.

    The checkpoint remembers which files are in; a refresh that fails is repeated from there.
    """
    return arriving(spark, path).writeStream.partitionBy("source").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def running_statistics(rows: DataFrame) -> DataFrame:
    """Count, mean and population deviation of each source and feature, over a stream or a table."""
    return rows.groupBy("source", "gene_symbol").agg(F.count("value_raw").alias("n"), F.avg("value_raw").alias("mean"), F.stddev_pop("value_raw").alias("sd"))
