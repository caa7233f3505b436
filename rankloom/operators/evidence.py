"""The unified long table, its standardisation and the wide table of a feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rankloom.functions.scalar import clip01, mean_available, spread_available, upper_key

# The columns of the unified long table, its layers, and the sources with their layers.
UNIFIED = ["DepMap_ID", "gene_symbol", "ensembl_id", "omics_layer", "value_raw", "value_unit", "source", "source_version"]
LAYERS = ["rna", "protein", "mutation", "fusion"]
SOURCES = {
    "depmap_rna": "rna",
    "hpa_rna": "rna",
    "geo_rna": "rna",
    "ccle_gygi_protein": "protein",
    "depmap_mutation": "mutation",
    "depmap_mutation_highimpact": "mutation",
    "depmap_fusion": "fusion",
    "depmap_fusion_confidence": "fusion",
}
RNA = [s for s, layer in SOURCES.items() if layer == "rna"]
EVIDENCE = ["depmap_rna", "hpa_rna", "geo_rna", "ccle_gygi_protein", "depmap_mutation", "depmap_fusion"]


def packed(df: DataFrame, source: str, entity: str, feature: Column, value: Column, unit: str, version: str, alt: Column | None = None, seen: Observation | None = None) -> DataFrame:
    """Rows in the unified schema, without those that lack an entity or a feature; features are upper-cased.

    ``seen`` gets the number of rows and of ``dropped`` ones when the rows are read, without another pass.
    """
    rows = df.select(
        F.col(entity).alias("DepMap_ID"),
        F.upper(F.trim(feature)).alias("gene_symbol"),
        (F.lit(None) if alt is None else alt).cast("string").alias("ensembl_id"),
        F.lit(SOURCES[source]).alias("omics_layer"),
        value.cast("double").alias("value_raw"),
        F.lit(unit).alias("value_unit"),
        F.lit(source).alias("source"),
        F.lit(version).alias("source_version"),
    )
    if seen is not None:
        lacks = F.col("DepMap_ID").isNull() | F.col("gene_symbol").isNull()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(lacks).alias("dropped"))
    return rows.dropna(subset=["DepMap_ID", "gene_symbol"])


def long_table(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def standardise(long: DataFrame) -> DataFrame:
    """Adds value_std, the z-score by source and feature over all replicates and entities; null where there is no spread.

    Means and deviations are one small row for each source and feature, summed before the shuffle, and joined
    back, so rows are neither sorted nor gathered by feature.
    """
    stats = long.groupBy("source", "gene_symbol").agg(F.avg("value_raw").alias("__mean"), F.stddev_pop("value_raw").alias("__sd"), F.count("value_raw").alias("__n"))
    z = F.when((F.col("__n") > 1) & (F.col("__sd") > 0), (F.col("value_raw") - F.col("__mean")) / F.col("__sd"))
    return long.join(stats, ["source", "gene_symbol"]).withColumn("value_std", z).select(*long.columns, "value_std")


def wide_table(long: DataFrame, spine: DataFrame, features: DataFrame) -> DataFrame:
    """One row for every entity and requested feature: <source>__raw and __std (means of replicates), has_<layer>,
    rna_consistency and data_completeness.

    ``features`` (gene_symbol) are the few symbols of a request; the schema is fixed, whatever sources have data.
    """
    mine = long.join(F.broadcast(features), "gene_symbol", "left_semi")
    means = mine.groupBy("DepMap_ID", "gene_symbol").pivot("source", list(SOURCES)).agg(F.avg("value_raw").alias("_raw"), F.avg("value_std").alias("_std"))
    renamed = {f"{s}_{k}": f"{s}_{k}" for s in SOURCES for k in ("_raw", "_std")}
    means = means.withColumnsRenamed(renamed)
    rows = spine.select("DepMap_ID").crossJoin(F.broadcast(features.select("gene_symbol"))).join(means, ["DepMap_ID", "gene_symbol"], "left")
    has = {layer: reduce(lambda a, b: a | b, (F.col(f"{s}__raw").isNotNull() for s, at in SOURCES.items() if at == layer)) for layer in LAYERS}
    rows = rows.withColumns({f"has_{layer}": c for layer, c in has.items()})
    std = [F.col(f"{s}__std") for s in RNA]
    agree = F.when(sum((c.isNotNull().cast("int") for c in std), F.lit(0)) >= 2, 1.0 - clip01(spread_available(std)))
    complete = sum((F.col(f"has_{layer}").cast("int") for layer in LAYERS), F.lit(0)) / len(LAYERS)
    return rows.withColumns({"rna_consistency": agree, "data_completeness": complete})


def rna_mean() -> Column:
    return mean_available([F.col(f"{s}__std") for s in RNA])


def coverage(long: DataFrame) -> DataFrame:
    """Rows, entities and features of each source.

    Cells of an entity are counted first, which takes no shuffle where its rows are in one partition, and its first cell stands for it.
    """
    cells = long.groupBy("DepMap_ID", "omics_layer", "source", "gene_symbol").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("DepMap_ID", "omics_layer", "source").orderBy("gene_symbol"))
    first = (F.col("nth") == 1) & F.col("DepMap_ID").isNotNull()
    return cells.withColumn("nth", nth).groupBy("omics_layer", "source").agg(
        F.sum("n").alias("n_rows"), F.count_if(first).alias("n_entities"), F.count_distinct("gene_symbol").alias("n_features")
    )


def replicate_audit(long: DataFrame) -> DataFrame:
    """Replicates by source: groups of (entity, feature) with several rows, and those whose values differ.

    Takes no shuffle of groups where the rows of an entity are in one partition.
    """
    keys = ["source", "gene_symbol", "DepMap_ID"]
    values = long.groupBy(*keys, "value_raw").agg(F.count(F.lit(1)).alias("n"))
    groups = values.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("value_raw").alias("d"))
    return groups.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(F.col("d") > 1).alias("n_conflicting"),
        F.sum(F.col("n") - 1).alias("n_collapsed"),
    )


#: Numeric types from narrow to wide; any other mixture of types is text.
WIDTHS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Tables of unlike columns as one: a column that a table lacks is null there, one of several types gets the widest number or is text.

    Columns keep the order in which they first appear, but masks (has_*), rna_consistency and data_completeness come last. Column
    names are compared as they are. No tables are an error.
    """
    if not tables:
        raise ValueError("no tables to stack")
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for c, kind in t.dtypes:
            kinds.setdefault(c, set()).add(kind)
    widest = {c: k.pop() if len(k := set(found) - ({"void"} if len(found) > 1 else set())) == 1 else max(k, key=WIDTHS.index) if k <= set(WIDTHS[1:]) else "string" for c, found in kinds.items()}
    late = lambda c: c.startswith("has_") or c in ("rna_consistency", "data_completeness")
    order = sorted(widest, key=late)
    cast = lambda t, c: (F.col(f"`{c}`") if c in t.columns else F.lit(None)).cast(widest[c]).alias(c)
    return reduce(DataFrame.unionAll, (t.select(*(cast(t, c) for c in order)) for t in tables))


def panel_rows(long: DataFrame, panel: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long rows of a panel's features and of known entities, and one row that tells what went.

    panel: gene_symbol, a short list without repeated symbols (broadcast, its size is checked). Keys are normalised. The audit has
    rows_before, rows_after, ids_before, unmatched_ids, rows_removed, n_missing (features without rows left) and missing (the least of them).
    """
    n, distinct = panel.agg(F.count(F.lit(1)), F.count_distinct(upper_key(F.col("gene_symbol")))).first()
    if n != distinct or n > 1_000_000:
        raise ValueError("a panel lists each feature once, and a million at most")
    features = F.broadcast(panel.select(upper_key(F.col("gene_symbol")).alias("gene_symbol")))
    mine = long.withColumns({"DepMap_ID": upper_key(F.col("DepMap_ID")), "gene_symbol": upper_key(F.col("gene_symbol"))}).join(features, "gene_symbol", "left_semi")
    there = known.select(upper_key(F.col("DepMap_ID")).alias("DepMap_ID")).distinct().withColumn("__known", F.lit(True))
    marked = mine.join(there, "DepMap_ID", "left")
    kept = marked.where("__known").select(*long.columns)
    by_feature = marked.groupBy("gene_symbol").agg(F.count_if("__known").alias("n"))
    missing = features.join(by_feature.where("n > 0"), "gene_symbol", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"), F.min("gene_symbol").alias("missing"))
    ids = marked.groupBy("DepMap_ID").agg(F.count(F.lit(1)).alias("n"), F.max("__known").alias("known"))
    audit = ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("rows_after"),
        F.count(F.lit(1)).alias("ids_before"),
        F.count_if(F.col("known").isNull()).alias("unmatched_ids"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("rows_removed"),
    )
    return kept, audit.crossJoin(F.broadcast(missing))
