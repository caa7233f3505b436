"""Adapters from measurement files to the unified long table; all push the wanted features into the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.scalar import ensembl_base, ensembl_of_header, fusion_confidence, high_impact, log2_plus_one, symbol_in_parens, symbol_of_header
from rankloom.operators.evidence import packed
from rankloom.sources.files import number, read_matrix, read_matrix_of, read_table
from rankloom.sources.resolve import resolve_accessions, resolve_names


def _wanted(features: Sequence[str] | None) -> Callable[[str], bool] | None:
    """A test on headers ``NAME (ALIAS)``: a wanted symbol is the name or in the parentheses."""
    if features is None:
        return None
    names = {f.upper() for f in features}
    return lambda header: bool(names & {t.strip(" )").upper() for t in header.split("(")})


def rna_matrix(spark: SparkSession, path: str, bridge: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Profiles in rows, ``SYMBOL (ENSG)`` in columns; bridge: (profile, entity). Unmapped profiles and nulls go."""
    rows = read_matrix(spark, path, wanted=_wanted(features)).where("value is not null")
    rows = rows.join(bridge, rows["row"] == bridge["profile"])
    return packed(rows, "depmap_rna", "entity", symbol_of_header(F.col("column")), F.col("value"), "log2(TPM+1)", "matrix", ensembl_of_header(F.col("column")))


def protein_matrix(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> DataFrame:
    """Entities in rows, ``UNIPROT (SYMBOL)`` in columns; unmeasured cells stay as nulls."""
    rows = read_matrix(spark, path, wanted=_wanted(features))
    return packed(rows, "ccle_gygi_protein", "row", symbol_in_parens(F.col("column")), F.col("value"), "log2 MS intensity", "matrix")


def rna_long(spark: SparkSession, path: str, accession_of_name: DataFrame, names: DataFrame, entities: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """A tab-separated long file of names; accession_of_name: (name, accession) described beside it, else the name itself is resolved."""
    rows = read_table(spark, path, {"ensembl": ["Gene"], "symbol": ["Gene name"], "name": ["Cell line"], "value": ["nTPM"]}, sep="\t")
    if features is not None:
        rows = rows.where(F.upper("symbol").isin([f.upper() for f in features]))
    rows = resolve_accessions(rows.join(accession_of_name, "name", "left"), "accession", entities, "by_accession")
    rows = resolve_names(rows, "name", names, entities, "by_name").withColumn("entity", F.coalesce("by_accession", "by_name"))
    value = log2_plus_one(number(F.col("value")))
    return packed(rows, "hpa_rna", "entity", F.col("symbol"), value, "log2(nTPM+1)", "long", ensembl_base(F.col("ensembl")))


def rna_samples(spark: SparkSession, path: str, samples: DataFrame, symbols: DataFrame, features: Sequence[str] | None = None, logged: bool = True) -> DataFrame:
    """Genes in rows (symbols or Ensembl ids), samples in columns; samples: (sample, entity); symbols: (ensembl, symbol).

    Only columns of resolved samples are read.
    """
    rows, _ = read_matrix_of(spark, path, samples.select(F.col("sample").alias("name"), F.col("entity").alias("id")))
    rows = rows.where("value is not null").withColumnRenamed("id", "entity")
    rows = rows.withColumn("ensembl", F.when(F.startswith("row", F.lit("ENSG")), ensembl_base(F.col("row"))))
    rows = rows.join(symbols, "ensembl", "left").withColumn("symbol", F.when(F.col("ensembl").isNull(), F.col("row")).otherwise(F.col("symbol")))
    if features is not None:
        rows = rows.where(F.upper("symbol").isin([f.upper() for f in features]))
    value, unit = (log2_plus_one(F.col("value"), clipped=False), "log2(intensity+1)") if logged else (F.col("value"), "intensity")
    return packed(rows, "geo_rna", "entity", F.col("symbol"), value, unit, "matrix", F.col("ensembl"))


def mutations(spark: SparkSession, path: str, bridge: DataFrame, features: Sequence[str] | None = None) -> list[DataFrame]:
    """Events by profile: their number by entity and symbol, and whether one is of high impact."""
    flags = ["oncogene", "tsg", "lof"]
    columns = {"profile": ["ProfileID"], "symbol": ["HugoSymbol"], "oncogene": ["OncogeneHighImpact"], "tsg": ["TumorSuppressorHighImpact"], "lof": ["LikelyLoF"], "impact": ["VepImpact"]}
    rows = read_table(spark, path, columns, optional=[*flags, "impact"])
    if features is not None:
        rows = rows.where(F.upper("symbol").isin([f.upper() for f in features]))
    rows = rows.join(bridge, "profile").withColumn("high", high_impact([F.col(f) for f in flags], F.col("impact")).cast("int"))
    events = rows.groupBy("entity", F.upper("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high"))
    pack = lambda source, c: packed(events, source, "entity", F.col("symbol"), F.col(c), "event count", "events")
    return [pack("depmap_mutation", "n"), pack("depmap_mutation_highimpact", "high")]


def fusions(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> list[DataFrame]:
    """Each fusion counts for both partners (``SYMBOL (ENSG)``): number and best confidence by entity and symbol."""
    rows = read_table(spark, path, {"entity": ["ModelID"], "left": ["Gene1"], "right": ["Gene2"], "confidence": ["confidence"]})
    rows = rows.select("entity", fusion_confidence(F.col("confidence")).alias("c"), F.explode(F.array("left", "right")).alias("gene"))
    rows = rows.withColumns({"symbol": F.upper(symbol_of_header(F.col("gene"))), "ensembl": ensembl_of_header(F.col("gene"))})
    if features is not None:
        rows = rows.where(F.col("symbol").isin([f.upper() for f in features]))
    events = rows.groupBy("entity", "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("best"), F.min("ensembl").alias("ensembl"))
    pack = lambda source, c: packed(events, source, "entity", F.col("symbol"), F.col(c), "event count", "events", F.col("ensembl"))
    return [pack("depmap_fusion", "n"), pack("depmap_fusion_confidence", "best")]


def fusions_of(events: DataFrame, name_col: str, symbol: str) -> DataFrame:
    """Fusions (``A--B``) in which a symbol is a partner."""
    return events.where(F.array_contains(F.transform(F.split(name_col, "--"), lambda x: F.upper(x)), symbol.upper()))


def default_signatures(rows: DataFrame, entity: str = "entity", default: str = "is_default", order: str = "nth") -> DataFrame:
    """The default entry of each entity; of several the first."""
    kept = rows.where(F.lower(F.trim(F.col(default).cast("string"))).isin("true", "1", "yes"))
    columns = [c for c in rows.columns if c not in (entity, default, order)]
    first = kept.groupBy(entity).agg(F.min_by(F.struct(*columns), order).alias("f"))
    return first.select(entity, *(F.col(f"f.{c}").alias(c) for c in columns))
