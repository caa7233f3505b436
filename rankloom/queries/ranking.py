"""Requests in all modes, the merged ranker, traces, reasons, gaps, alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.contexts import context_aliases
from rankloom.functions.scalar import rounded
from rankloom.operators.explain import alternatives, fingerprint, gaps, merged_alternatives, merged_trace, reasons, top_features, trace
from rankloom.operators.scoring import ScoringConfig, context_filter
from rankloom.queries.base import r4, registry, scored, store
from rankloom.sources import star

QUERIES, ORACLE_SQL, register = registry()
GENE, PROTEIN, EXCLUDED, CONTEXT = "BRAND-13", "BRAND-7", "BRAND-22", "building"
SHOWN = [
    "DepMap_ID", "cellLine", "lineage", "disease", "rnaScore", "proteinScore", "biologicalScore", "exclusionPenalty", "completenessScore", "sourceSupportScore",
    "rnaProteinConsistencyScore", "confidenceScore", "confidenceLevel", "finalScore", "recommendationLevel", "alterationStatus", "rank",
]
_SQL = ", ".join({"DepMap_ID": "id AS DepMap_ID", "cellLine": "name AS cellLine"}.get(c, c) for c in SHOWN)
MERGED = ScoringConfig("custom", 0.50, 0.25, 0.25, 0.5, 0.3, 0.2, 0.2)


def _ranked(name: str, gene, protein, exclusion, context, merged=False, config=None, weights=None):
    aliases = context_aliases(context, merged)
    extra = {"weights": weights} if weights else {}

    @register(name, f"WITH {scored(gene, protein, exclusion, aliases, merged, **extra)} SELECT {_SQL} FROM ranked")
    def run(spark, sf_dir):
        return store(spark, sf_dir).rank(gene, protein, exclusion, context, merged, config).select(*SHOWN)


_ranked("rank_gene", GENE, None, None, CONTEXT)
_ranked("rank_gene_with_exclusion", GENE, None, EXCLUDED, CONTEXT)
_ranked("rank_protein_only", None, PROTEIN, EXCLUDED, CONTEXT)
_ranked("rank_combined", GENE, PROTEIN, EXCLUDED, "america cancer")
_ranked("rank_merged_all_contexts", GENE, None, EXCLUDED, None, merged=True)
_ranked("rank_merged_custom_weights", GENE, None, EXCLUDED, CONTEXT, merged=True, config=MERGED, weights=(0.50, 0.25, 0.25, 0.5, 0.3, 0.2, 0.2))


@register("recommend_top10", f"WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))} SELECT {_SQL} FROM ranked WHERE rank <= 10")
def recommend_top10(spark, sf_dir):
    request = {"target_gene": GENE, "exclusion_gene": EXCLUDED, "disease": CONTEXT, "top_n": 10}
    return store(spark, sf_dir).recommend(request).select(*SHOWN)


@register(
    "context_filter_counts",
    r"""WITH t AS (SELECT trim(regexp_replace(translate(lower(c_mktsegment || ' ' || r_name), '-_/', '   '), '\s+', ' ', 'g')) AS text
                   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        q AS (SELECT * FROM (VALUES ('Building', 'building'), ('Middle-East tumour', 'middle east'), ('ASIA', 'asia'), ('cancer', 'cancer'), ('America/Household', 'america household')) v(query, alias))
    SELECT query, count(*) FILTER (WHERE contains(text, alias)) AS n_rows, min(text) FILTER (WHERE contains(text, alias)) AS first_text FROM t, q GROUP BY query""",
)
def context_filter_counts(spark, sf_dir):
    rows = star.annotations(spark, sf_dir)
    out = None
    for query in ("Building", "Middle-East tumour", "ASIA", "cancer", "America/Household"):
        one = context_filter(rows, context_aliases(query)).agg(F.lit(query).alias("query"), F.count(F.lit(1)).alias("n_rows"), F.min("matchedDiseaseText").alias("first_text"))
        out = one if out is None else out.unionByName(one)
    return out


_PRIMARY = "list_filter([CASE WHEN depmap_rna_v IS NOT NULL THEN 'DepMap_RNAseq' END, CASE WHEN hpa_rna_v IS NOT NULL THEN 'HPA_RNAseq' END, CASE WHEN geo_rna_v IS NOT NULL THEN 'GEO_RNA' END, CASE WHEN prot_v IS NOT NULL THEN 'CCLE_Gygi_Proteomics' END, CASE WHEN mutated THEN 'DepMap_Mutation' END, CASE WHEN fused_ THEN 'DepMap_Fusion' END, CASE WHEN fused_ AND depmap_fusion_confidence_v IS NOT NULL THEN 'DepMap_Fusion' END], lambda x: x IS NOT NULL)"
_RNA_REASON = f"CASE WHEN rnaScore >= 0.7 THEN 'Strong RNA expression evidence for {GENE}.' WHEN rnaScore >= 0.4 THEN 'Moderate RNA expression evidence for {GENE}.' ELSE 'Limited RNA expression evidence for {GENE}.' END"


@register(
    "explained_rows",
    f"""WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))}
    SELECT id AS DepMap_ID, rank, array_to_string({_PRIMARY}, ';') AS datasets,
           array_to_string(list_filter(['The cell line passed the disease-specific hard filter for {CONTEXT}.', {_RNA_REASON},
             CASE WHEN proteinScore IS NOT NULL THEN 'Supporting protein-level evidence is available for {GENE}.' ELSE 'Protein evidence is missing; its weight was redistributed and confidence was reduced.' END,
             CASE WHEN alterationStatus <> 'NO ALTERATION' THEN 'Genomic alteration detected for {GENE}: ' || alterationStatus || '.' END,
             CASE WHEN exclusionPenalty <= 0.05 THEN 'The exclusion gene {EXCLUDED} does not cause a major penalty.' ELSE 'A penalty is applied because {EXCLUDED} shows relatively high RNA expression evidence.' END], lambda x: x IS NOT NULL), ' ') AS reasons,
           (depmap_rna_z IS NULL)::INT + (hpa_rna_z IS NULL)::INT + (geo_rna_z IS NULL)::INT + (prot IS NULL)::INT AS n_gaps
    FROM ranked""",
)
def explained_rows(spark, sf_dir):
    rows = store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT)
    mode = "GENE_MULTIOMICS"
    datasets = F.array_join(F.transform(trace(mode), lambda t: t["dataset"]), ";")
    return rows.select("DepMap_ID", "rank", datasets.alias("datasets"), F.array_join(reasons(mode, GENE, None, EXCLUDED, CONTEXT), " ").alias("reasons"), F.size(gaps(mode, GENE)).alias("n_gaps"))


@register(
    "alternatives_to_the_best",
    f"""WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))}, top AS (SELECT rnaScore AS r0, proteinScore AS p0 FROM ranked WHERE rank = 1),
    d AS (SELECT k.*, abs(r0 - rnaScore) AS dr, abs(p0 - proteinScore) AS dp FROM ranked k, top WHERE rank > 1),
    s AS (SELECT *, CASE WHEN dr IS NULL AND dp IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - (coalesce(dr, 0) + coalesce(dp, 0)) / ((dr IS NOT NULL)::INT + (dp IS NOT NULL)::INT))) END AS sim FROM d)
    SELECT id AS DepMap_ID, name AS alternativeCellLine, {r4("sim")} AS similarityScore, finalScore FROM s ORDER BY similarityScore DESC, finalScore DESC, id LIMIT 5""",
)
def alternatives_to_the_best(spark, sf_dir):
    return alternatives(store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT)).drop("targetGeneLabel")


_MERGED = f"{scored(GENE, None, EXCLUDED, context_aliases(CONTEXT, True), True)}"
_SEEN = [("depmap_rna_v IS NOT NULL", "'DepMap_RNAseq rna_expression '", "depmap_rna_v", "log2(TPM+1)"), ("hpa_rna_v IS NOT NULL", "'HPA_RNAseq rna_expression '", "hpa_rna_v", "log2(nTPM+1)"), ("geo_rna_v IS NOT NULL", "'GEO_RNA rna_expression '", "geo_rna_v", "log2(intensity+1)"),
         ("prot_v IS NOT NULL", "'CCLE_Gygi_Proteomics protein_expression '", "prot_v", "log2 MS intensity"), ("mutated", "CASE WHEN high THEN 'DepMap_Mutation high_impact_mutation ' ELSE 'DepMap_Mutation mutation ' END", "depmap_mutation_v", "event count"),
         ("fused_", "'DepMap_Fusion fusion '", "depmap_fusion_v", "event evidence"), ("fused_ AND depmap_fusion_confidence_v IS NOT NULL", "'DepMap_Fusion fusion_confidence '", "depmap_fusion_confidence_v", "source confidence")]
_LINES = ", ".join(f"CASE WHEN {when} THEN {what} || printf('%.4f', {r4(v)}) || ' {unit}' END" for when, what, v, unit in _SEEN)


@register("merged_traces", f"WITH {_MERGED} SELECT id AS DepMap_ID, rank, array_to_string(list_filter([{_LINES}], lambda x: x IS NOT NULL), ';') AS trace FROM ranked")
def merged_traces(spark, sf_dir):
    """The evidence of every row of the merged ranker, a line for each measurement."""
    rows = store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT, merged=True)
    line = lambda t: F.concat_ws(" ", t["dataset"], t["type"], F.format_string("%.4f", rounded(t["value"])), t["unit"])
    return rows.select("DepMap_ID", "rank", F.array_join(F.transform(merged_trace(), line), ";").alias("trace"))


@register(
    "merged_alternatives",
    f"""WITH {_MERGED}, top AS (SELECT rnaScore AS r0, proteinScore AS p0 FROM ranked WHERE rank = 1),
    d AS (SELECT k.*, abs(r0 - rnaScore) AS dr, abs(p0 - proteinScore) AS dp FROM ranked k, top WHERE rank > 1),
    s AS (SELECT *, CASE WHEN dr IS NULL AND dp IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - (coalesce(dr, 0) + coalesce(dp, 0)) / ((dr IS NOT NULL)::INT + (dp IS NOT NULL)::INT))) END AS sim FROM d)
    SELECT id AS DepMap_ID, name AS alternativeCellLine, lineage, disease, {r4("sim")} AS similarityScore, finalScore, '{GENE}' || CASE WHEN alterationStatus = 'NO ALTERATION' THEN '' ELSE ' [' || alterationStatus || ']' END AS targetGeneLabel
    FROM s ORDER BY similarityScore DESC, finalScore DESC, rank LIMIT 5""",
)
def alternatives_of_the_merged_ranker(spark, sf_dir):
    return merged_alternatives(store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT, merged=True))


@register(
    "ranking_fingerprint",
    f"""WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))},
    lines AS (SELECT rank, sha256(concat_ws('|', rank, id, name, printf('%.4f', finalScore), printf('%.4f', confidenceScore), recommendationLevel)) AS h FROM ranked),
    thousands AS (SELECT rank // 1000 AS part, sha256(string_agg(h, '' ORDER BY rank)) AS h, count(*) AS n FROM lines GROUP BY part)
    SELECT sha256(string_agg(h, '' ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS n_rows FROM thousands""",
)
def ranking_fingerprint(spark, sf_dir):
    return fingerprint(store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT))


@register(
    "entity_context_features",
    f"""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, 'f' || lpad(i::VARCHAR, 3, '0')) AS n FROM p)
    SELECT vec_id, n::INT AS n, 'f' || lpad(i::VARCHAR, 3, '0') AS feature, {r4("v", 6)} AS value FROM r WHERE n <= 5""",
)
def entity_context_features(spark, sf_dir):
    """The five largest dimensions of each embedding, as the profile matrices' top features are shown."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = e.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("feature"), F.col("v").cast("double").alias("v"))
    top = top_features(long, "vec_id", "feature", "v")
    rows = top.select("vec_id", F.posexplode("top").alias("i", "t"))
    return rows.select("vec_id", (F.col("i") + 1).alias("n"), F.col("t.feature").alias("feature"), rounded(F.col("t.value"), 6).alias("value"))
