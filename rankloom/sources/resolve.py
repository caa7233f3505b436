"""Identifiers of entities and features, resolved by joins with small maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scalar import ensembl_base, upper_alnum, without_cell_line_prefix


def first_per_key(df: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """(key, value) with the value that comes first; null keys and values go."""
    there = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return there.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_per_key(df: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """(key, value) with the value that comes last, as in a map that later entries overwrite."""
    there = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return there.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def name_map(registry: DataFrame) -> DataFrame:
    """(name_key, accession) from (nth, accession, name, synonyms); the first registration of a normalised name wins.

    Synonyms are split at ``||`` and ``;``.
    """
    names = F.concat(F.array("name"), F.split(F.coalesce("synonyms", F.lit("")), r"\|\||;"))
    rows = registry.select("nth", "accession", F.posexplode(names).alias("place", "n"))
    rows = rows.withColumn("name_key", F.nullif(upper_alnum(F.col("n")), F.lit("")))
    return first_per_key(rows, "name_key", "accession", F.col("nth"), F.col("place"))


def entity_map(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(accession, entity): the primary source's entity, else the fallback's; in each the first wins. Inputs: nth, accession, entity."""
    both = primary.select("accession", "entity", "nth", F.lit(0).alias("p")).unionByName(fallback.select("accession", "entity", "nth", F.lit(1).alias("p")))
    return first_per_key(both, "accession", "entity", F.col("p"), F.col("nth"))


def resolve_accessions(df: DataFrame, column: str, entities: DataFrame, out: str = "entity") -> DataFrame:
    """Adds the entity of an accession; anything that isn't ``CVCL_...`` has none."""
    key = F.when(F.startswith(F.trim(column), F.lit("CVCL_")), F.trim(column))
    return df.withColumn("__a", key).join(entities.select(F.col("accession").alias("__a"), F.col("entity").alias(out)), "__a", "left").drop("__a")


def resolve_names(df: DataFrame, column: str, names: DataFrame, entities: DataFrame, out: str = "entity") -> DataFrame:
    """Adds the entity of a name: an ``ACH-`` id as it is, else by its normalised name and accession."""
    rows = df.withColumn("__k", upper_alnum(F.col(column)))
    rows = rows.join(names.select(F.col("name_key").alias("__k"), F.col("accession").alias("__a")), "__k", "left")
    rows = rows.join(entities.select(F.col("accession").alias("__a"), F.col("entity").alias("__e")), "__a", "left")
    own = F.when(F.startswith(F.trim(F.col(column)), F.lit("ACH-")), F.trim(F.col(column)))
    return rows.withColumn(out, F.coalesce(own, "__e")).drop("__k", "__a", "__e")


def resolve_samples(samples: DataFrame, names: DataFrame, entities: DataFrame) -> DataFrame:
    """(sample, entity) from (nth, sample, accession, title): by accession, else by the cleaned title; a sample's first row wins."""
    rows = samples.withColumn("title", without_cell_line_prefix(F.col("title")))
    rows = resolve_names(resolve_accessions(rows, "accession", entities, "__x"), "title", names, entities, "__y")
    first = rows.groupBy("sample").agg(F.min_by(F.struct(F.coalesce("__x", "__y").alias("entity")), "nth").alias("f"))
    return first.select("sample", F.col("f.entity").alias("entity")).where("entity is not null")


def symbol_maps(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ensembl, symbol) and (symbol, ensembl) from (nth, ensembl, symbol): versions stripped, symbols upper-cased, the first pair wins."""
    rows = pairs.select("nth", ensembl_base(F.trim("ensembl")).alias("ensembl"), F.upper(F.trim("symbol")).alias("symbol"))
    return first_per_key(rows, "ensembl", "symbol", F.col("nth")), first_per_key(rows, "symbol", "ensembl", F.col("nth"))


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of several rows; empty where a many-to-one join is safe."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
