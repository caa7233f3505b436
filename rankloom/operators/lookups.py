"""Lookups of one feature, and the profile of a feature over all entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialised


def same_name(column: str, name: str) -> Column:
    """Equality of names in any case."""
    return F.upper(column) == name.upper()


def feature_values(long: DataFrame, feature: str, source: str | None = None, feature_col: str = "gene_symbol", value_col: str = "value_raw", entity_col: str = "DepMap_ID") -> DataFrame:
    """Entity and value of one feature, of one source if given; nulls stay. KeyError where the feature isn't there.

    The feature's rows are stored, so that the plan below them runs once.
    """
    mine = long.where(same_name(feature_col, feature))
    if source is not None:
        mine = mine.where(F.col("source") == source)
    mine = materialised(mine)
    if mine.isEmpty():
        raise KeyError(feature)
    return mine.select(entity_col, F.col(value_col).alias("value"))


def feature_names(long: DataFrame, feature_col: str = "gene_symbol") -> DataFrame:
    """All features that there are."""
    return long.select(feature_col).where(F.col(feature_col).isNotNull()).distinct()


def event_records(events: DataFrame, feature: str, feature_col: str, keep: list[str], loss_col: str) -> DataFrame:
    """All events of a feature, with is_lof: whether a loss of function is named for them."""
    return events.where(same_name(feature_col, feature)).select(*keep, F.col(loss_col).isNotNull().alias("is_lof"))


def rows_of_entities(rows: DataFrame, entities: DataFrame, entity_col: str = "DepMap_ID") -> DataFrame:
    """The rows of some entities."""
    return rows.join(entities.select(entity_col).distinct(), entity_col, "left_semi")


def flagged(rows: DataFrame, members: DataFrame, name: str, entity_col: str = "DepMap_ID") -> DataFrame:
    """Adds ``name``: whether the entity is among the members."""
    there = members.select(F.col(entity_col).alias("__member")).distinct()
    return rows.join(there, rows[entity_col] == there["__member"], "left").withColumn(name, F.col("__member").isNotNull()).drop("__member")


def feature_profile(spine: DataFrame, rna: DataFrame, protein: DataFrame, mutated: DataFrame, fused: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row for each entity with RNA or protein of a feature: both values, whether it is mutated or fused there and
    whether it is excluded.

    rna and protein: DepMap_ID, value, one row an entity; the others: DepMap_ID. Rows go by RNA, the highest
    first and missing ones last.
    """
    side = lambda df, name: df.select("DepMap_ID", F.col("value").alias(name))
    rows = spine.join(side(rna, "rna_expression"), "DepMap_ID", "left").join(side(protein, "protein_expression"), "DepMap_ID", "left")
    rows = rows.where(F.col("rna_expression").isNotNull() | F.col("protein_expression").isNotNull())
    for members, name in ((mutated, "has_target_mutation"), (fused, "has_target_fusion"), (excluded, "excluded")):
        rows = flagged(rows, members, name)
    return rows.orderBy(F.desc_nulls_last("rna_expression"), "DepMap_ID")


def profile_in_one_pass(spine: DataFrame, long: DataFrame, feature: str) -> DataFrame:
    """``feature_profile`` from the long rows of the feature and of those that exclude, by one aggregation: replicates are averaged, and
    an entity is excluded by a mutation or fusion of any other feature."""
    own, event = F.col("gene_symbol") == feature, lambda *sources: F.col("source").isin(*sources)
    mean = lambda source: F.avg(F.when(own & event(source), F.col("value_raw")))
    seen = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rows = long.groupBy("DepMap_ID").agg(
        mean("depmap_rna").alias("rna_expression"),
        mean("ccle_gygi_protein").alias("protein_expression"),
        seen(own & event("depmap_mutation")).alias("has_target_mutation"),
        seen(own & event("depmap_fusion")).alias("has_target_fusion"),
        seen(~own & event("depmap_mutation", "depmap_fusion")).alias("excluded"),
    )
    there = F.col("rna_expression").isNotNull() | F.col("protein_expression").isNotNull()
    return spine.join(rows.where(there), "DepMap_ID").orderBy(F.desc_nulls_last("rna_expression"), "DepMap_ID")


def supplementary(entities: DataFrame, profiles: dict[str, DataFrame]) -> DataFrame:
    """Entities with what each profile (DepMap_ID, top: array of feature and value) shows of them; without any, an empty array."""
    for name, top in profiles.items():
        entities = entities.join(top.select("DepMap_ID", F.col("top").alias(name)), "DepMap_ID", "left")
    empty = F.array().cast("array<struct<feature:string,value:double>>")
    return entities.withColumns({name: F.coalesce(F.col(name), empty) for name in profiles})


# The global signatures that a context shows, and the notes where a profile is missing.
SIGNATURES = ("MSIScore", "LoHFraction", "WGD", "CIN", "Ploidy", "Aneuploidy")
NO_PROFILE = {"global_signatures": "No File 14 global-signature record for this cell line.", "top_mirna": "No File 13 miRNA profile for this cell line.", "top_metabolites": "No File 12 metabolomics profile for this cell line."}


def entity_context(entities: DataFrame, signatures: DataFrame, mirna: DataFrame, metabolites: DataFrame) -> DataFrame:
    """DepMap_ID with global_signatures (a map of those measured), top_mirna, top_metabolites and notes on what isn't there.

    Context only, never scored. signatures: DepMap_ID and some of SIGNATURES, the first row by its values counts; the other two: DepMap_ID, top
    (see ``top_features``). Values that aren't finite are left out.
    """
    there = [c for c in SIGNATURES if c in signatures.columns]
    value = lambda c: F.col(c).try_cast("double")
    finite_value = lambda c: F.when(~F.isnan(value(c)) & (F.abs(value(c)) != float("inf")), value(c))
    one = signatures.groupBy("DepMap_ID").agg(F.min(F.struct(F.lit(1).alias("there"), *(finite_value(c).alias(c) for c in there))).alias("__row"))
    entry = [F.struct(F.lit(c).alias("key"), F.col(f"__row.{c}").alias("value")) for c in there]
    measured = F.map_from_entries(F.filter(F.array(*entry), lambda e: e["value"].isNotNull())) if entry else F.create_map().cast("map<string,double>")
    rows = entities.select("DepMap_ID").distinct().join(one.select("DepMap_ID", measured.alias("global_signatures")), "DepMap_ID", "left")
    for name, top in (("top_mirna", mirna), ("top_metabolites", metabolites)):
        rows = rows.join(top.select("DepMap_ID", F.col("top").alias(name)), "DepMap_ID", "left")
    notes = F.array_compact(F.array(*(F.when(F.col(c).isNull(), text) for c, text in NO_PROFILE.items())))
    empty = F.array().cast("array<struct<feature:string,value:double>>")
    rows = rows.withColumn("notes", notes).withColumns({c: F.coalesce(F.col(c), empty) for c in ("top_mirna", "top_metabolites")})
    return rows.withColumn("global_signatures", F.coalesce("global_signatures", F.create_map().cast("map<string,double>")))


def context_text(*columns: str) -> Column:
    """A row's context as one JSON document; missing values are null in it."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
