"""Candidates, scores and ranks of a feature query."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from math import isclose, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalar import (
    alteration_status,
    clip01,
    confidence_level,
    count_available,
    feature_label,
    first_text,
    mean_available,
    normal_context,
    positive,
    recommendation_level,
    rounded,
)
from rankloom.operators.evidence import RNA

FLAGS = {"hasDepMapRNA": "depmap_rna", "hasHpaRNA": "hpa_rna", "hasGeoRNA": "geo_rna"}
NAMES = ["cellosaurus_name", "stripped_cell_line_name", "cell_line_name", "CCLE_Name"]


@dataclass(frozen=True)
class ScoringConfig:
    """Weights of the ranker; both groups sum to 1."""

    name: str = "A0_team_baseline_provisional"
    rna_weight: float = 0.55
    protein_weight: float = 0.30
    confidence_weight: float = 0.15
    confidence_completeness: float = 0.40
    confidence_source_support: float = 0.35
    confidence_consistency: float = 0.25
    max_exclusion_penalty: float = 0.30

    def __post_init__(self) -> None:
        weights = {k: v for k, v in asdict(self).items() if k != "name"}
        bad = [k for k, v in weights.items() if not isfinite(v) or v < 0]
        outer = self.rna_weight + self.protein_weight + self.confidence_weight
        inner = self.confidence_completeness + self.confidence_source_support + self.confidence_consistency
        if bad or not isclose(outer, 1.0, abs_tol=1e-9) or not isclose(inner, 1.0, abs_tol=1e-9):
            raise ValueError(f"weights must be finite, not negative and sum to 1 in each group: {weights}")


#: Columns that the display name may come from where it is null throughout, in this order.
NAME_FALLBACKS = ("cell_line_name", "CCLE_Name", "ModelID")


def prepared_annotations(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each entity, with stripped_cell_line_name, lineage and primary_disease.

    Of an entity's rows the first by ``order`` stays (by all columns, in their order, if none is given). Columns that aren't there are null. If no
    row has a stripped_cell_line_name, the first of NAME_FALLBACKS that is there takes its place throughout. Rows without an id go.
    """
    need = [c for c in ("stripped_cell_line_name", "lineage", "primary_disease") if c not in rows.columns]
    rows = rows.where(F.col("DepMap_ID").isNotNull()).withColumns({c: F.lit(None).cast("string") for c in need})
    others = [c for c in rows.columns if c != "DepMap_ID"]
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)), F.struct(*(F.col(f"`{c}`") for c in order or others)))
    one = rows.groupBy("DepMap_ID").agg(first.alias("__row")).select("DepMap_ID", "__row.*")
    other = next((c for c in NAME_FALLBACKS if c in others), None)
    if other is None:
        return one
    if "stripped_cell_line_name" in need:
        return one.withColumn("stripped_cell_line_name", F.col(other).cast("string"))
    named = one.agg(F.count("stripped_cell_line_name").alias("__named"))
    name = F.when(F.col("__named") > 0, F.col("stripped_cell_line_name")).otherwise(F.col(other).cast("string"))
    return one.crossJoin(F.broadcast(named)).withColumn("stripped_cell_line_name", name).drop("__named")


def context_filter(rows: DataFrame, aliases: list[str]) -> DataFrame:
    """Rows whose disease and lineage hold one of the aliases as a substring; no aliases: all rows. Adds matchedDiseaseText."""
    text = normal_context(F.concat_ws(" ", F.coalesce("primary_disease", F.lit("")), F.coalesce("lineage", F.lit(""))))
    rows = rows.withColumn("matchedDiseaseText", text)
    if not aliases:
        return rows
    hit = F.lit(False)
    for a in aliases:
        hit = hit | F.col("matchedDiseaseText").contains(a)
    return rows.where(hit)


def candidates(wide: DataFrame, annotations: DataFrame, aliases: list[str], mode: str, gene: str | None, protein: str | None, exclusion: str | None) -> DataFrame:
    """Candidate rows of a query.

    RNA and alterations come from the gene's table (the protein's, if no gene is given), protein from the
    protein's (the gene's, if no protein is given), the exclusion expression from the exclusion gene's. In
    protein-only mode a row needs protein, else RNA or protein.
    """
    main, prot = gene or protein, protein or gene
    std = [F.col(f"{s}__std") for s in RNA]
    # One pass over the wide table: the rows of an entity's two or three features meet in one group.
    own = [c for c in wide.columns if c not in ("DepMap_ID", "gene_symbol")]
    of = lambda symbol, value: F.max(F.when(F.col("gene_symbol") == symbol, value))
    rows = wide.groupBy("DepMap_ID").agg(
        of(main, F.struct(*own)).alias("own"),
        of(prot, F.col("ccle_gygi_protein__std")).alias("protExpr"),
        of(prot, F.col("ccle_gygi_protein__raw")).alias("proteinRaw"),
        (of(exclusion, mean_available(std)) if exclusion else F.lit(None).cast("double")).alias("exclusionExpr"),
    )
    rows = rows.select("DepMap_ID", "own.*", "protExpr", "proteinRaw", "exclusionExpr").join(annotations, "DepMap_ID", "left")
    rows = context_filter(rows, aliases)
    rows = rows.withColumn("nRna", count_available(std))
    rows = rows.where(F.col("protExpr").isNotNull() if mode == "PROTEIN_ONLY" else (F.col("nRna") > 0) | F.col("protExpr").isNotNull())
    mutated, fused, high = (positive(F.col(f"{s}__raw")) for s in ("depmap_mutation", "depmap_fusion", "depmap_mutation_highimpact"))
    status = alteration_status(mutated, fused, high)
    names = [F.col(n) for n in NAMES if n in annotations.columns]
    text = lambda v: F.lit(v).cast("string")
    return rows.select(
        "DepMap_ID",
        F.coalesce(first_text(names), F.col("DepMap_ID")).alias("cellLine") if names else F.col("DepMap_ID").alias("cellLine"),
        "lineage",
        F.col("primary_disease").alias("disease"),
        F.lit(mode).alias("queryMode"),
        text(gene).alias("targetGene"),
        text(protein).alias("targetProtein"),
        text(prot).alias("proteinSymbolUsed"),
        mean_available(std).alias("rnaExpr"),
        "protExpr",
        "exclusionExpr",
        "nRna",
        F.col("protExpr").isNotNull().cast("int").alias("nProt"),
        F.col("exclusionExpr").isNotNull().cast("int").alias("nExclusion"),
        *(F.col(f"{s}__std").isNotNull().alias(flag) for flag, s in FLAGS.items()),
        F.col("protExpr").isNotNull().alias("hasProteomics"),
        F.col("depmap_rna__raw").alias("depmapRnaRaw"),
        F.col("hpa_rna__raw").alias("hpaRnaRaw"),
        F.col("geo_rna__raw").alias("geoRnaRaw"),
        "proteinRaw",
        F.col("rna_consistency").alias("rnaConsistency"),
        F.col("data_completeness").alias("mergedDataCompleteness"),
        mutated.alias("hasMutation"),
        fused.alias("hasFusion"),
        high.alias("hasHighImpactMutation"),
        F.col("depmap_mutation__raw").alias("mutationRaw"),
        F.col("depmap_mutation_highimpact__raw").alias("mutationHighImpactRaw"),
        F.col("depmap_fusion__raw").alias("fusionRaw"),
        F.col("depmap_fusion_confidence__raw").alias("fusionConfidenceRaw"),
        status.alias("alterationStatus"),
        feature_label(F.lit(main), status).alias("targetGeneLabel"),
    )


def scale(rows: DataFrame, by: list[str], columns: dict[str, str], constant: str = "sign", close: bool = False) -> DataFrame:
    """Min-max scaled columns (new name -> column) over the rows of ``by``; null stays null.

    A constant column gives 1 if it is positive, else 0 (``constant="sign"``), or 0 (``"zero"``); with
    ``close`` constancy is up to a relative 1e-9. Extremes are one row for each group, joined back.
    """
    ends = rows.groupBy(*by).agg(*(f(c).alias(f"__{k}_{n}") for n, c in columns.items() for k, f in (("lo", F.min), ("hi", F.max))))
    joined = rows.join(F.broadcast(ends) if not by else ends, by) if by else rows.crossJoin(F.broadcast(ends))
    out = {}
    for n, c in columns.items():
        lo, hi = F.col(f"__lo_{n}"), F.col(f"__hi_{n}")
        same = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo)) if close else hi == lo
        flat = F.when(hi > 0, 1.0).otherwise(0.0) if constant == "sign" else F.lit(0.0)
        out[n] = F.when(F.col(c).isNotNull(), F.when(same, flat).otherwise(F.try_divide(F.col(c) - lo, hi - lo)))
    return joined.withColumns(out).select(*(F.col(f"`{c}`") for c in rows.columns), *out)


def agreement(r: Column, p: Column) -> Column:
    """1 - |difference| of two layers, 0.5 with one, 0 with none."""
    both = r.isNotNull() & p.isNotNull()
    return F.when(both, clip01(1.0 - F.abs(r - p))).when(r.isNotNull() | p.isNotNull(), 0.5).otherwise(0.0)


def support(flags: list[str]) -> Column:
    return sum((F.col(f).cast("int") for f in flags), F.lit(0)) / float(len(flags))


def ranks(rows: DataFrame, by: list[str], order: list[Column], score: str = "finalScore") -> DataFrame:
    """Adds ``rank``, from 1, within ``by``. ``score`` has four digits and falls with ``order``.

    Rows of one score are sorted together, and the rows of higher scores, of which there are at most 10,001
    sums for each group of ``by``, are added, so no task sorts all rows.
    """
    sums = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"__{c}") for c in [*by, score]), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, score).orderBy(*order))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, score]))
    joined = rows.withColumn("__nth", inside).join(before, on)
    return joined.withColumn("rank", (F.col("__before") + F.col("__nth")).cast("long")).drop("__before", "__nth", *(f"__{c}" for c in [*by, score]))


def short_ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank`` to the rows of a short list, which are few."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))


def scored(rows: DataFrame, mode: str, config: ScoringConfig | None = None, by: list[str] | None = None, merged: bool = False, top: int | None = None) -> DataFrame:
    """Candidates with their scores, levels and rank; with ``top`` that many of the best of all.

    Missing layers give their weight to the others; confidence mixes completeness, source support and
    agreement; the exclusion gene's scaled RNA is subtracted. Dynamic: ranked by rounded final and confidence
    score, then id. Merged: by the final score to nine digits, then id, as the order of a mean's terms decides on the last ones.
    """
    c = config or ScoringConfig()
    by = by or []
    only = mode == "PROTEIN_ONLY"
    rows = scale(rows, by, {"__r": "rnaExpr", "__p": "protExpr", "__e": "exclusionExpr"})
    r, p, e = F.col("__r"), F.col("__p"), F.col("__e")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    penalty = zero(c.max_exclusion_penalty * e)
    complete = (r.isNotNull().cast("int") + p.isNotNull().cast("int")) / 2.0
    backed, agree = support([*FLAGS, "hasProteomics"]), agreement(r, p)
    confidence = clip01(c.confidence_completeness * complete + c.confidence_source_support * backed + c.confidence_consistency * agree)
    if only:
        biology, own, other = p, c.rna_weight + c.protein_weight, c.confidence_weight
    else:
        weight = c.rna_weight * r.isNotNull().cast("int") + c.protein_weight * p.isNotNull().cast("int")
        biology = F.try_divide(c.rna_weight * zero(r) + c.protein_weight * zero(p), weight)
        own, other = c.rna_weight + c.protein_weight, c.confidence_weight
    rows = rows.withColumns({"__biology": biology, "__confidence": confidence, "__penalty": penalty}).where(F.col("__biology").isNotNull())
    rows = rows.withColumn("__final", clip01(own * F.col("__biology") + other * F.col("__confidence") - F.col("__penalty")))
    rows = rows.withColumns(
        {
            "rnaScore": rounded(r),
            "proteinScore": rounded(p),
            "biologicalScore": rounded(F.col("__biology")),
            "exclusionPenalty": rounded(F.col("__penalty")),
            "completenessScore": rounded(complete),
            "sourceSupportScore": rounded(backed),
            "rnaProteinConsistencyScore": rounded(agree),
            "confidenceScore": rounded(F.col("__confidence")),
            "confidenceLevel": confidence_level(F.col("__confidence")),
            "finalScore": rounded(F.col("__final")),
            "recommendationLevel": recommendation_level(F.col("__final")),
        }
    )
    fine = F.floor(F.col("__final") * 1e9 + 0.5)
    order = [F.desc("finalScore"), F.desc(fine), F.asc("DepMap_ID")] if merged else [F.desc("finalScore"), F.desc("confidenceScore"), F.asc("DepMap_ID")]
    rows = short_ranks(rows.orderBy(*order).limit(top), order) if top else ranks(rows, by, order)
    return rows.drop("__r", "__p", "__e", "__biology", "__confidence", "__penalty", "__final")


# The notes of responses on the weights of the two modes.
WEIGHT_NOTES = {
    "PROTEIN_ONLY": "Protein is the only directly scored biological modality: 0.85× protein + 0.15× confidence. RNA contributes only supporting evidence to confidence.",
    "": "RNA and protein comprise the 0.85 biological-evidence weight. The weight of a missing modality is redistributed across the available biological modalities.",
}


def weights_payload(mode: str, config: ScoringConfig | None = None) -> dict[str, float | str]:
    """The weights that a mode ranks with, as responses show them: without RNA, protein has the weight of both."""
    c = config or ScoringConfig()
    only = mode == "PROTEIN_ONLY"
    biology = {"rna": 0.0, "protein": round(c.rna_weight + c.protein_weight, 10)} if only else {"rna": c.rna_weight, "protein": c.protein_weight}
    return biology | {"confidence": c.confidence_weight, "exclusion_penalty_max": c.max_exclusion_penalty, "note": WEIGHT_NOTES["PROTEIN_ONLY" if only else ""]}
