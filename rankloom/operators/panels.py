"""Feature panels: coverage strata, seeded samples, and the prototype scorer of a feature's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.scoring import scale

# Thresholds of strata, their quotas, and the prototype's weights.
RICH, RELIABLE_N, LOW, HIGH = 2, 10, 0.25, 0.50
QUOTAS = {"protein_corr_low": 10, "protein_corr_mid": 10, "protein_corr_high": 10, "protein_no_reliable_corr": 20, "multisource_rna_no_protein": 25, "depmap_rna_only": 25}
PROTOTYPE = {"rna": 0.40, "protein": 0.25, "consistency": 0.15, "tissue": 0.10, "completeness": 0.10}


def stratum() -> Column:
    """Of a catalog row (rna_sources, protein_n, correlation, correlation_n). Later rules override earlier ones."""
    rich = F.col("rna_sources") >= RICH
    protein = F.col("protein_n") >= RELIABLE_N
    known = protein & F.col("correlation").isNotNull() & (F.col("correlation_n").isNull() | (F.col("correlation_n") >= RELIABLE_N))
    r = F.col("correlation")
    return (
        F.when(~protein & (F.col("rna_sources") == 1), "depmap_rna_only")
        .when(~protein & rich, "multisource_rna_no_protein")
        .when(protein & ~known, "protein_no_reliable_corr")
        .when(known & rich & (r >= HIGH), "protein_corr_high")
        .when(known & rich & (r <= LOW), "protein_corr_low")
        .when(known & rich, "protein_corr_mid")
        .otherwise("not_selected_pool")
    )


def sample_strata(catalog: DataFrame, quotas: dict[str, int], seed: int, feature: str = "feature", strata: str = "stratum") -> DataFrame:
    """Up to a quota of each stratum without replacement, by a hash of the seed and the feature."""
    draw = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(feature)), 256)
    most = F.lit(0)
    for name, n in quotas.items():
        most = F.when(F.col(strata) == name, n).otherwise(most)
    nth = F.row_number().over(Window.partitionBy(strata).orderBy(draw, feature))
    return catalog.withColumn("nth", nth).where(F.col("nth") <= most)


def largest_n(correlations: DataFrame, key: str = "feature") -> DataFrame:
    """One correlation a feature: that of the largest n (a missing one is 0); of equal ones the largest correlation."""
    rest = [c for c in correlations.columns if c != key]
    best = correlations.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("n", F.lit(0)), *rest)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in rest))


def percentile_rank(column: str, by: list[str]) -> Column:
    """Average rank of ties over the number of values that are there; null stays null."""
    c = F.col(column)
    present = Window.partitionBy(*by, c.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull(), (F.rank().over(present.orderBy(c)) + (ties - 1) / 2.0) / F.count(F.lit(1)).over(present))


def prototype_scores(profile: DataFrame, by: list[str], weights: dict[str, float] | None = None, lineage: str | None = None) -> DataFrame:
    """Five-term scores of a profile (DepMap_ID, lineage, rna, protein, excluded), by query.

    Rows without protein give its weight and the consistency's to RNA and tissue in proportion. Tissue is the
    enrichment of a row's lineage in the top RNA quartile, relative to the most enriched, or 1 for a stated
    lineage. Excluded rows score -1.
    """
    w = PROTOTYPE | (weights or {})
    rows = scale(profile, by, {"rna_score": "rna", "protein_score": "protein"}, constant="zero")
    rows = rows.withColumns({"__rp": percentile_rank("rna", by), "__pp": percentile_rank("protein", by)})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if lineage is not None:
        rows = rows.withColumn("tissue_score", F.coalesce((F.lower("lineage") == lineage.lower()).cast("double"), F.lit(0.0)))
    else:
        quarter = profile.groupBy(*by).agg(F.percentile("rna", F.lit(0.75)).alias("__q"), F.count("lineage").alias("__n"))
        flagged = profile.join(quarter, by).withColumn("__top", F.coalesce(F.col("rna") >= F.col("__q"), F.lit(False)))
        tops = Window.partitionBy(*by)
        share = flagged.where("lineage is not null").groupBy(*by, "lineage", "__n").agg(F.count(F.lit(1)).alias("__all"), F.count_if("__top").alias("__hot"))
        share = share.withColumn("__e", F.try_divide(F.col("__hot") / F.sum("__hot").over(tops), F.col("__all") / F.col("__n")))
        share = share.withColumn("tissue_score", F.least(F.try_divide(F.col("__e"), F.max("__e").over(tops)), F.lit(1.0)))
        rows = rows.join(share.select(*by, "lineage", "tissue_score"), [*by, "lineage"], "left").withColumn("tissue_score", zero(F.col("tissue_score")))
    has = F.col("protein").isNotNull()
    agree = zero(F.when(has & F.col("rna").isNotNull(), 1.0 - F.abs(F.col("__rp") - F.col("__pp"))))
    complete = (F.col("rna").isNotNull().cast("int") + has.cast("int")) / 2.0
    freed = w["protein"] + w["consistency"]
    share_rna = w["rna"] / (w["rna"] + w["tissue"])
    rna_w = F.when(has, w["rna"]).otherwise(w["rna"] + freed * share_rna)
    tissue_w = F.when(has, w["tissue"]).otherwise(w["tissue"] + freed * (1 - share_rna))
    both_w = lambda k: F.when(has, w[k]).otherwise(0.0)
    final = rna_w * zero(F.col("rna_score")) + both_w("protein") * zero(F.col("protein_score")) + both_w("consistency") * agree + tissue_w * F.col("tissue_score") + w["completeness"] * complete
    rows = rows.withColumns({"rna_score": zero(F.col("rna_score")), "protein_score": zero(F.col("protein_score")), "consistency_score": agree, "completeness_score": complete})
    return rows.withColumn("final_score", F.when(F.col("excluded"), -1.0).otherwise(final)).drop("__rp", "__pp")
