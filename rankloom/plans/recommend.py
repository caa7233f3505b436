"""Requests from end to end: one lazy plan from the long table to ranked rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.contexts import clean_request, context_aliases, query_mode
from rankloom.operators.evidence import EVIDENCE, standardise, wide_table
from rankloom.operators.scoring import ScoringConfig, candidates, prepared_annotations, scored
from rankloom.session import materialised


@dataclass
class EvidenceStore:
    """The long table (standardised or not), the entities and their annotations that requests are answered from.

    A request reads the long table once, for its own few features, and standardises those; candidates are computed
    once too, as scaling needs their extremes first.
    """

    long: DataFrame
    spine: DataFrame
    annotations: DataFrame

    def __post_init__(self) -> None:
        self.spark: SparkSession = self.long.sparkSession

    def wide(self, *symbols: str | None) -> DataFrame:
        names = list(dict.fromkeys(s.strip().upper() for s in symbols if s))
        features = self.spark.createDataFrame([(n,) for n in names], "gene_symbol string")
        mine = materialised(self.long.where(F.col("gene_symbol").isin(names)))
        return wide_table(mine if "value_std" in mine.columns else standardise(mine), self.spine, features)

    def has_evidence(self, symbol: str, protein: bool = False) -> bool:
        sources = ["ccle_gygi_protein"] if protein else EVIDENCE
        mine = self.long.where((F.col("gene_symbol") == symbol) & F.col("source").isin(sources) & F.col("value_raw").isNotNull())
        return not mine.limit(1).isEmpty()

    def candidates(self, gene: str | None = None, protein: str | None = None, exclusion: str | None = None, context: str | None = None, merged: bool = False) -> DataFrame:
        mode = query_mode(gene, protein)
        wide = self.wide(gene, protein, exclusion)
        return candidates(wide, prepared_annotations(self.annotations), context_aliases(context, merged), mode, gene, protein, exclusion)

    def rank(self, gene: str | None = None, protein: str | None = None, exclusion: str | None = None, context: str | None = None, merged: bool = False, config: ScoringConfig | None = None) -> DataFrame:
        """All candidates of a request, scored and ranked."""
        rows = materialised(self.candidates(gene, protein, exclusion, context, merged))
        return scored(rows, query_mode(gene, protein), config, merged=merged)

    def recommend(self, request: dict) -> DataFrame:
        """The best rows of a checked request; LookupError where the target has no evidence."""
        q = clean_request(request)
        gene, protein = q["target_gene"], q["target_protein"]
        if gene and not self.has_evidence(gene):
            raise LookupError(f"no evidence for {gene}")
        if not gene and not self.has_evidence(protein, protein=True):
            raise LookupError(f"no protein evidence for {protein}")
        rows = materialised(self.candidates(gene, protein, q["exclusion_gene"], q["context"]))
        return scored(rows, query_mode(gene, protein), top=q["top_n"])
