"""Sinks: ranked CSV, JSON payloads, feature caches, file manifests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.functions.scalar import finite

def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


RUN_ID = re.compile(r"[A-Za-z0-9_-]{1,64}")


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def save_ranked(df: DataFrame, path: str, columns: list[str], order: str = "rank", bom: bool = True, line_sep: str = "\n", overwrite: bool = False) -> bool:
    """A short ranked list as one CSV file, in order; nothing is written, and False returned, if it is empty.

    Existing output is refused unless ``overwrite`` is given.
    """
    if df.limit(1).isEmpty():
        return False
    rows = df.select(*columns, F.col(order).alias("__order")).coalesce(1).sortWithinPartitions("__order").drop("__order")
    first, *rest = columns
    named = rows.withColumnRenamed(first, ("﻿" if bom else "") + first)
    named.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("lineSep", line_sep).csv(path)
    return True


# The columns of an exported ranking, in order.
EXPORTED = {
    "rank": "long", "DepMap_ID": "string", "cellLine": "string", "lineage": "string", "disease": "string", "queryMode": "string", "targetGene": "string", "targetProtein": "string",
    "finalScore": "double", "confidenceScore": "double", "recommendationLevel": "string", "rnaScore": "double", "proteinScore": "double", "biologicalScore": "double",
    "exclusionPenalty": "double", "completenessScore": "double", "sourceSupportScore": "double",
}


def save_export(ranked: DataFrame, path: str) -> bool:
    """The columns EXPORTED of a ranking as one CSV file, as spreadsheets want it; False, and no file, if it is empty."""
    return save_ranked(ranked, path, list(EXPORTED), line_sep="\r\n")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_export`` wrote, with its types; a file with other columns is refused."""
    head = spark.read.option("header", True).csv(path).columns
    if [c.lstrip("\ufeff").rstrip("\r") for c in head] != list(EXPORTED):
        raise ValueError(f"{path} has columns {head}, not those of an exported ranking")
    return spark.read.option("header", True).schema(", ".join(f"`{c}` {t}" for c, t in EXPORTED.items())).csv(path)


def payload(request: Column, rows: DataFrame, columns: list[str], order: str = "rank") -> DataFrame:
    """One JSON document: schemaVersion, query and the results in order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__order"), F.struct(*columns).alias("row"))))
    results = F.transform(listed, lambda x: x["row"])
    doc = F.struct(F.lit("1.0").alias("schemaVersion"), F.first(request).alias("query"), F.count(F.lit(1)).alias("nResults"), results.alias("results"))
    return json_safe(rows).agg(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def cache_features(long: DataFrame, path: str) -> bool:
    """Long rows by feature; only the features at hand are replaced. Nothing is written, and False returned, if no row has a value (value_raw, or any row where there is no such column)."""
    if (long.where("value_raw IS NOT NULL") if "value_raw" in long.columns else long).limit(1).isEmpty():
        return False
    long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gene_symbol").parquet(path)
    return True


def cached_features(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Rows of some features; the others' folders aren't read."""
    return spark.read.parquet(path).where(F.col("gene_symbol").isin(features))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes, SHA-256 and number of lines of each file of a folder."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("lines"))
    return files.join(lines, "name", "left").fillna(0, ["lines"])


def run_path(folder: str, run_id: str) -> str:
    """The place of a saved run; ids that could lead elsewhere are refused."""
    if not RUN_ID.fullmatch(run_id):
        raise ValueError("a run id has letters, digits, '_' and '-' only, 64 at most")
    return f"{folder}/{run_id}"


def save_run(ranked: DataFrame, folder: str, run_id: str) -> None:
    """A ranking under its id, as JSON lines; an id that is there already is refused."""
    json_safe(ranked).write.option("ignoreNullFields", False).json(run_path(folder, run_id))


def load_run(spark: SparkSession, folder: str, run_id: str, schema: StructType | None = None) -> DataFrame:
    """A saved run; with ``schema`` its columns have those types, also where all their values are null."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(run_path(folder, run_id))


def candidate_detail(run: DataFrame, rank: int, context: DataFrame | None = None) -> DataFrame:
    """The row of one rank of a run, with its entity's context if there is one."""
    row = run.where(F.col("rank") == rank)
    return row if context is None else row.join(context, "DepMap_ID", "left")


def save_labels(sheet: DataFrame, path: str) -> None:
    """A review sheet as Parquet, over one that nobody has reviewed; a sheet with a judgement, a verified row, a source or a note is refused."""
    spark = sheet.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        start = {"judgement": "unknown", "verified": "no", "source_url": "", "evidence_summary": "", "review_notes": ""}
        touched = [~text(c).isin(blank, "") for c, blank in start.items() if c in old.columns]
        if touched and not old.where(reduce(lambda a, b: a | b, touched)).limit(1).isEmpty():
            raise ValueError(f"{path} has reviewed labels; write a new version instead")
    sheet.write.mode("overwrite").parquet(path)
