"""Readers of measurement files: delimited tables, wide matrices and GCT files, as long tables."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.headers import find_column
from rankloom.functions.scalar import finite

#: Bytes of a table that the driver may decode.
SMALL_FILE = 16 << 20


@dataclass(frozen=True)
class SourceFile:
    """Where a logical file lies below the data folder."""

    folder: str
    name: str
    sep: str = ","


def path_of(root: str, files: dict[int, SourceFile], file_id: int) -> str:
    if file_id not in files:
        raise FileNotFoundError(f"no file {file_id}; known: {sorted(files)}")
    f = files[file_id]
    return f"{root.rstrip('/')}/{f.folder}/{f.name}"


def read_table(spark: SparkSession, path: str, columns: dict[str, Sequence[str]], sep: str = ",", optional: Sequence[str] = (), encoding: str = "UTF-8") -> DataFrame:
    """The columns that ``columns`` names (new name -> keywords, resolved fuzzily), as text; blank, NA and NaN are null.

    An ``optional`` column that isn't there is null. Only the resolved columns are parsed.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    found = {new: find_column(raw.columns, words, required=new not in optional) for new, words in columns.items()}
    text = lambda c: F.when(~F.trim(c).isin("", "NA", "NaN", "nan"), c)
    return raw.select(*((text(F.col(f"`{old}`")) if old else F.lit(None).cast("string")).alias(new) for new, old in found.items()))


def read_table_any_encoding(spark: SparkSession, path: str, columns: dict[str, Sequence[str]], encodings: Sequence[str] = ("utf-8-sig", "cp1250", "cp1252")) -> DataFrame:
    """A small hand-edited table, as ``read_table`` gives it, in the first encoding that decodes the whole file.

    Spark reads few encodings, and a reviewed sheet is small: its size is checked, and the driver decodes it.
    """
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= SMALL_FILE).select("content").head(2)
    if len(found) != 1:
        raise ValueError(f"{path}: one file of {SMALL_FILE} bytes at most is expected")
    for encoding in encodings:
        try:
            text = bytes(found[0]["content"]).decode(encoding)
        except UnicodeDecodeError:
            continue
        head, *rows = csv.reader(io.StringIO(text))
        at = {new: head.index(find_column(head, words)) for new, words in columns.items()}
        cell = lambda r, i: None if i >= len(r) or r[i].strip() in ("", "NA", "NaN", "nan") else r[i]
        schema = ", ".join(f"`{c}` string" for c in at)
        return spark.createDataFrame([tuple(cell(r, i) for i in at.values()) for r in rows], schema)
    raise ValueError(f"{path}: none of {list(encodings)}")


def _cells(line: Column, sep: str) -> Column:
    return F.transform(F.split(line, {"\t": "\t", ",": ","}[sep]), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def number(c: Column) -> Column:
    """A double; anything else, NaN and infinities are null."""
    return finite(c.try_cast("double"))


def read_matrix(spark: SparkSession, path: str, sep: str = ",", skip: int = 0, keys: int = 1, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """A wide matrix as long rows (row, column, value): all or the ``wanted`` columns, nulls kept.

    The header is read on the driver; a line is split once and only wanted cells of it are exploded, so
    neither the schema nor the plan grows with the number of columns. ``skip`` lines come before the header,
    ``keys`` leading columns hold the row's names, of which the first is kept.
    """
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.head(skip + 1)]
    names = [c.strip().strip('"') for c in head[-1].lstrip("﻿").split(sep)]
    at = [(i, n) for i, n in enumerate(names) if i >= keys and (wanted is None or wanted(n))]
    if not at:
        return spark.createDataFrame([], "row string, column string, value double")
    body = lines.where(~F.col("value").isin(head)).select(_cells(F.col("value"), sep).alias("cells"))
    places = F.lit(json.dumps([i for i, _ in at]))
    titles = F.lit(json.dumps([n for _, n in at]))
    pairs = F.arrays_zip(F.from_json(places, T.ArrayType(T.IntegerType())).alias("i"), F.from_json(titles, T.ArrayType(T.StringType())).alias("n"))
    rows = body.select(F.get("cells", F.lit(0)).alias("row"), "cells", F.explode(pairs).alias("p"))
    return rows.select("row", F.col("p.n").alias("column"), number(F.get("cells", F.col("p.i"))).alias("value"))


def read_matrix_of(spark: SparkSession, path: str, known: DataFrame, sep: str = ",", skip: int = 0, keys: int = 1) -> tuple[DataFrame, DataFrame]:
    """A wide matrix whose column names are re-keyed by ``known`` (name, id): long rows (row, id, value), and the names that have no id.

    The header is read as rows, (place, name), and joined to ``known``; a line gets the places and ids of the columns that have an id
    and only those cells are exploded, so no list of ids comes to the driver. Of several ids of a name the least counts. Rows without a
    key go; cells without a number are null.
    """
    lines = spark.read.text(path)
    preamble = [r["value"] for r in lines.head(skip + 1)]
    head = spark.createDataFrame([(preamble[-1].lstrip("\ufeff"),)], "value string").select(F.posexplode(_cells(F.col("value"), sep)).alias("place", "name")).where(F.col("place") >= keys)
    ids = known.where("name IS NOT NULL AND id IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"))
    matched = head.join(ids, "name", "left")
    places = matched.where("id IS NOT NULL").agg(F.collect_list(F.struct("place", "id")).alias("places"))
    body = lines.where(~F.col("value").isin(preamble)).select(_cells(F.col("value"), sep).alias("cells"))
    body = body.where(F.coalesce(F.get("cells", F.lit(0)), F.lit("")) != "").crossJoin(F.broadcast(places))
    rows = body.select(F.get("cells", F.lit(0)).alias("row"), "cells", F.explode("places").alias("p"))
    return rows.select("row", F.col("p.id").alias("id"), number(F.get("cells", F.col("p.place"))).alias("value")), matched.where("id IS NULL").select("name")


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """A GCT file as (feature, entity, value): two lines of preamble, features in rows, entities in columns."""
    return read_matrix(spark, path, "\t", skip=2, keys=2).select(F.col("row").alias("feature"), F.col("column").alias("entity"), "value")


def load_config(path: str, kind: type):
    """A dataclass from a JSON object; unknown fields are refused."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    unknown = set(data) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return kind(**data)
