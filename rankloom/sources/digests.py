"""Digests of tables that don't depend on the order of rows or on files, and frozen tables that are checked when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.sinks import exists

#: Hexadecimal digits of a row's hash that are summed.
DIGITS = 15


def row_text(df: DataFrame) -> Column:
    """All columns of a row, by name, each with its length, so that no two different rows give one text."""
    plain = lambda c, t: F.to_json(F.struct(c)) if t.startswith(("array", "map", "struct")) else F.base64(c) if t == "binary" else F.col(f"`{c}`").cast("string")
    cells = [plain(c, t) for c, t in sorted(df.dtypes)]
    return F.concat(*(F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in cells))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n (rows), and digest, a SHA-256 of the names and types of the columns, n, and the sum and the XOR of 60 bits of each row's SHA-256.

    Tasks add up their rows, so nothing but three numbers of each is shuffled. Repeated rows count; other columns than ``columns`` don't.
    """
    df = df.select(*columns) if columns else df
    bits = F.conv(F.substring(F.sha2(row_text(df), 256), 1, DIGITS), 16, 10).cast("long")
    shape = ",".join(f"{c} {t}" for c, t in sorted(df.dtypes))
    sums = df.select(bits.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    return sums.select("n", F.sha2(F.concat_ws("|", F.lit(shape), F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("digest"))


def freeze(df: DataFrame, path: str) -> str:
    """Write a table once, with its digest beside it, and return the digest; the same table again is left as it is, another one refused.

    The digest is that of the rows read back, and is written last, so a broken write leaves a table without a digest, which
    ``frozen`` refuses.
    """
    spark = df.sparkSession
    if exists(spark, f"{path}/digest"):
        kept, now = spark.read.json(f"{path}/digest").first(), table_digest(df).first()
        if (kept["n"], kept["digest"]) != (now["n"], now["digest"]):
            raise ValueError(f"{path} is frozen with other rows; freeze a new version instead")
        return kept["digest"]
    df.write.mode("overwrite").parquet(f"{path}/rows")
    row = table_digest(spark.read.parquet(f"{path}/rows"))
    row.coalesce(1).write.json(f"{path}/digest")
    return spark.read.json(f"{path}/digest").first()["digest"]


def frozen(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a frozen table, after its digest was checked; ValueError if there is none or a cell, row or column has changed."""
    if not exists(spark, f"{path}/digest"):
        raise ValueError(f"{path} has no digest")
    rows, kept = spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/digest").first()
    now = table_digest(rows).first()
    if (kept["n"], kept["digest"]) != (now["n"], now["digest"]):
        raise ValueError(f"{path}: {now['n']} rows with digest {now['digest']}, frozen were {kept['n']} with {kept['digest']}")
    return rows


def changed_files(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """name and change (missing, new or changed) of files whose bytes or SHA-256 differ between a stated manifest and one taken now."""
    a, b = (m.select("name", F.struct("bytes", "sha256").alias(c)) for m, c in ((manifest, "a"), (now, "b")))
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "name", "full").select("name", change.alias("change")).where("change IS NOT NULL")
