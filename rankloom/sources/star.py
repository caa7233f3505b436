"""The star-schema tables seen as evidence: customers are entities, brands are features, line items are measurements.

Orders bridge line items to customers; pending orders are left out, so some rows have no entity. Line
status and return flag tell the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.scalar import fusion_confidence, log2_plus_one
from rankloom.operators.evidence import SOURCES, UNIFIED, long_table, standardise
from rankloom.session import spread, table

VERSION = "star-1"


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("ACH-"), F.lpad(key.cast("string"), 6, "0"))


def padded(key: Column, width: int) -> Column:
    """A number with leading zeros; ``lpad`` alone cuts longer ones, so that different keys meet."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.char_length(text), F.lit(width)), "0")


def symbol(brand: str) -> Column:
    """A brand as a symbol, which may hold no #."""
    return F.translate(F.upper(F.trim(brand)), "#", "-")


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(entity_id(F.col("c_custkey")).alias("DepMap_ID"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(entity_id(F.col("c_custkey")).alias("DepMap_ID"), F.col("c_name").alias("cell_line_name"), F.col("c_mktsegment").alias("primary_disease"), F.col("r_name").alias("lineage"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their entity and feature; those of pending orders have none and go."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    bridge = orders.where("o_orderstatus <> 'P'").select("o_orderkey", entity_id(F.col("o_custkey")).alias("DepMap_ID"))
    features = part.select("p_partkey", symbol("p_brand").alias("p_brand"), "p_type")
    n = line.count()
    line, bridge = spread(line, n, "l_orderkey"), spread(bridge, n, "o_orderkey")
    return line.join(bridge, line.l_orderkey == bridge.o_orderkey).join(features, line.l_partkey == features.p_partkey)


def unified(rows: DataFrame, source: Column, value: Column, unit: Column, alt: Column | None = None) -> DataFrame:
    """Rows in the unified schema, the source told by a column, so that several sources are read in one pass."""
    layer = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))
    out = rows.select(
        "DepMap_ID",
        F.col("p_brand").alias("gene_symbol"),
        (F.lit(None) if alt is None else alt).cast("string").alias("ensembl_id"),
        value.cast("double").alias("value_raw"),
        unit.alias("value_unit"),
        source.alias("source"),
        F.lit(VERSION).alias("source_version"),
    )
    return out.withColumn("omics_layer", layer[F.col("source")]).dropna(subset=["DepMap_ID", "gene_symbol"]).select(*UNIFIED)


def value_sources(rows: DataFrame) -> DataFrame:
    """The three RNA sources and the protein source."""
    flag = F.col("l_returnflag")
    rna = F.when(flag == "N", "depmap_rna").when(flag == "A", "hpa_rna").when(flag == "R", "geo_rna")
    source = F.when(F.col("l_linestatus") == "O", rna).when((F.col("l_linestatus") == "F") & (flag == "N"), "ccle_gygi_protein")
    mine = rows.withColumn("source", source).where("source is not null")
    protein = F.col("source") == "ccle_gygi_protein"
    value = F.when(protein, F.col("l_quantity").cast("double")).otherwise(log2_plus_one(F.col("l_extendedprice")))
    return unified(mine, F.col("source"), value, F.when(protein, "quantity").otherwise("log2(x+1)"), F.col("p_type"))


def event_sources(events: DataFrame, values: dict[str, str]) -> DataFrame:
    """A source for each of the columns (source -> column) of counted events."""
    pairs = F.array(*(F.struct(F.lit(s).alias("source"), F.col(c).cast("double").alias("value")) for s, c in values.items()))
    return unified(events.withColumn("e", F.explode(pairs)), F.col("e.source"), F.col("e.value"), F.lit("events"))


def mutation_events(rows: DataFrame, n_rows: int = 0) -> DataFrame:
    """Events counted by entity and feature, and whether one of them is of high impact."""
    mine = rows.where("l_linestatus = 'F' and l_returnflag = 'A'")
    mine = spread(mine, n_rows, "DepMap_ID")
    return mine.groupBy("DepMap_ID", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("l_discount") > 0.05).cast("int")).alias("high"))


def fusion_events(rows: DataFrame, part: DataFrame, n_parts: int, n_rows: int = 0) -> DataFrame:
    """Each event counts for both partners; the best confidence of an entity and feature stays."""
    mine = rows.where("l_linestatus = 'F' and l_returnflag = 'R'").withColumn("other", (F.col("l_partkey") * 7 + 1) % n_parts)
    other = part.select(F.col("p_partkey").alias("other"), symbol("p_brand").alias("other_brand"))
    tax = F.when(F.col("l_tax") >= 0.06, "high").when(F.col("l_tax") >= 0.03, "medium").otherwise("low")
    partners = mine.join(other, "other").select("DepMap_ID", tax.alias("confidence"), F.explode(F.array("p_brand", "other_brand")).alias("p_brand"))
    partners = spread(partners, n_rows, "DepMap_ID")
    return partners.groupBy("DepMap_ID", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.max(fusion_confidence(F.col("confidence"))).alias("best"))


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, in three passes over the line items."""
    rows, part = measurements(spark, sf_dir), table(spark, sf_dir, "part")
    n = table(spark, sf_dir, "lineitem").count()
    mutated = event_sources(mutation_events(rows, n), {"depmap_mutation": "n", "depmap_mutation_highimpact": "high"})
    fused = event_sources(fusion_events(rows, part, part.count(), n), {"depmap_fusion": "n", "depmap_fusion_confidence": "best"})
    return long_table([value_sources(rows), mutated, fused])


def long_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_long`` with all rows of an entity in one partition, for groupings that hold a row for nearly each of its rows."""
    return spread(raw_long(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "DepMap_ID")


def standard_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise(raw_long(spark, sf_dir))
