"""Lookups of features, profiles, saved runs and the run of the scripted writer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.functions.contexts import context_aliases
from rankloom.functions.scalar import rounded
from rankloom.operators.explain import explain_run, run_detail, top_features
from rankloom.operators.lookups import entity_context, event_records, feature_names, feature_values, profile_in_one_pass, rows_of_entities, supplementary
from rankloom.queries.base import LONG, r4, registry, scored, store
from rankloom.queries.ranking import _SQL, CONTEXT, EXCLUDED, GENE, SHOWN
from rankloom.session import materialised, scratch_folder, table
from rankloom.sources import star
from rankloom.sources.sinks import EXPORTED, candidate_detail, load_run, read_export, save_export, save_run

QUERIES, ORACLE_SQL, register = registry()
OTHERS = ("BRAND-22", "BRAND-7")


def _of(source: str, name: str):
    @register(name, f"WITH {LONG} SELECT id AS DepMap_ID, {r4('v')} AS value FROM long WHERE src = '{source}' AND feature = '{GENE}'")
    def run(spark, sf_dir):
        return feature_values(star.raw_long(spark, sf_dir), GENE.lower(), source).withColumn("value", rounded(F.col("value")))


_of("depmap_rna", "rna_of_feature")
_of("ccle_gygi_protein", "protein_of_feature")


@register("mutations_of_feature", f"WITH {LONG} SELECT id AS DepMap_ID, l_orderkey, l_linenumber, l_tax, l_tax > 0.04 AS is_lof FROM li WHERE l_linestatus = 'F' AND l_returnflag = 'A' AND feature = '{GENE}'")
def mutations_of_feature(spark, sf_dir):
    """Events of one feature; a high tax stands for a named loss of function."""
    events = star.measurements(spark, sf_dir).where("l_linestatus = 'F' and l_returnflag = 'A'").withColumn("loss", F.when(F.col("l_tax") > 0.04, F.col("p_type")))
    return event_records(events, GENE.lower(), "p_brand", ["DepMap_ID", "l_orderkey", "l_linenumber", "l_tax"], "loss")


def _matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select(F.col("vec_id").alias("DepMap_ID"), F.concat(F.lit("F"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("feature"), F.col("v").cast("double").alias("v"))


@register("matrix_feature", f"SELECT vec_id AS DepMap_ID, {r4('embedding[8]::DOUBLE', 6)} AS value FROM embeddings")
def matrix_feature(spark, sf_dir):
    """One column of a profile matrix, by its name in any case."""
    return feature_values(_matrix(spark, sf_dir), "f007", None, "feature", "v").withColumn("value", rounded(F.col("value"), 6))


@register("feature_names", f"WITH {LONG} SELECT DISTINCT feature AS gene_symbol FROM long")
def names_of_features(spark, sf_dir):
    return feature_names(star.raw_long(spark, sf_dir))


@register("annotations_of_entities", f"WITH {LONG}, m AS (SELECT DISTINCT id FROM long WHERE feature = '{GENE}' AND src = 'depmap_fusion') SELECT s.id AS DepMap_ID, s.disease AS primary_disease FROM spine s JOIN m USING (id)")
def annotations_of_entities(spark, sf_dir):
    ids = feature_values(star.raw_long(spark, sf_dir), GENE, "depmap_fusion")
    return rows_of_entities(star.annotations(spark, sf_dir), ids).select("DepMap_ID", "primary_disease")


@register(
    "feature_profile",
    f"""WITH {LONG}, r AS (SELECT id, avg(v) AS rna FROM long WHERE feature = '{GENE}' AND src = 'depmap_rna' GROUP BY id), p AS (SELECT id, avg(v) AS prot FROM long WHERE feature = '{GENE}' AND src = 'ccle_gygi_protein' GROUP BY id),
    x AS (SELECT DISTINCT id FROM long WHERE feature IN {OTHERS} AND src IN ('depmap_mutation', 'depmap_fusion')),
    f AS (SELECT s.id, s.lineage, rna, prot FROM spine s LEFT JOIN r USING (id) LEFT JOIN p USING (id) WHERE rna IS NOT NULL OR prot IS NOT NULL)
    SELECT id AS DepMap_ID, lineage, {r4("rna")} AS rna_expression, {r4("prot")} AS protein_expression, id IN (SELECT id FROM long WHERE feature = '{GENE}' AND src = 'depmap_mutation') AS has_target_mutation,
           id IN (SELECT id FROM long WHERE feature = '{GENE}' AND src = 'depmap_fusion') AS has_target_fusion, id IN (SELECT id FROM x) AS excluded FROM f""",
)
def profile_of_feature(spark, sf_dir):
    """The rows of the three features are stored once; all columns of the profile come from them."""
    long = star.raw_long(spark, sf_dir).where(F.col("gene_symbol").isin(GENE, *OTHERS) & F.col("source").isin("depmap_rna", "ccle_gygi_protein", "depmap_mutation", "depmap_fusion"))
    out = profile_in_one_pass(star.annotations(spark, sf_dir).select("DepMap_ID", "lineage"), materialised(long), GENE)
    return out.withColumns({c: rounded(F.col(c)) for c in ("rna_expression", "protein_expression")})


@register(
    "supplementary_context",
    """WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, 'F' || lpad(unnest(range(len(embedding)))::VARCHAR, 3, '0') AS f FROM embeddings),
    low AS (SELECT vec_id, f, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, f) AS n FROM p WHERE f < 'F032'), high AS (SELECT vec_id, f, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, f) AS n FROM p WHERE f >= 'F032'),
    l AS (SELECT vec_id, string_agg(f, ';' ORDER BY n) AS metabolites FROM low WHERE n <= 3 GROUP BY vec_id), h AS (SELECT vec_id, string_agg(f, ';' ORDER BY n) AS mirnas FROM high WHERE n <= 3 AND vec_id % 2 = 0 GROUP BY vec_id)
    SELECT e.vec_id AS DepMap_ID, coalesce(metabolites, '') AS metabolites, coalesce(mirnas, '') AS mirnas FROM embeddings e LEFT JOIN l USING (vec_id) LEFT JOIN h USING (vec_id)""",
)
def supplementary_context(spark, sf_dir):
    """The three largest features of two profiles of each entity; every other entity lacks the second."""
    m = _matrix(spark, sf_dir)
    top = lambda rows: top_features(rows, "DepMap_ID", "feature", "v", 3)
    rows = supplementary(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("DepMap_ID")), {"metabolites": top(m.where("feature < 'F032'")), "mirnas": top(m.where("feature >= 'F032' and DepMap_ID % 2 = 0"))})
    return rows.select("DepMap_ID", *(F.array_join(F.transform(c, lambda x: x["feature"]), ";").alias(c) for c in ("metabolites", "mirnas")))


@register("saved_run_candidate", f"WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))} SELECT {_SQL} FROM ranked WHERE rank = 3")
def saved_run_candidate(spark, sf_dir):
    """A ranking is saved under an id, read back by it, and one of its ranks looked up."""
    folder, run_id = scratch_folder(spark, "runs"), uuid.uuid4().hex
    save_run(store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT).select(*SHOWN), folder, run_id)
    return candidate_detail(load_run(spark, folder, run_id), 3)


@register(
    "explained_run",
    f"""WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))}, t AS (SELECT * FROM ranked WHERE rank <= 10),
    lines AS (SELECT rank, sha256(concat_ws('|', rank, id, name, printf('%.4f', finalScore), printf('%.4f', confidenceScore), recommendationLevel)) AS h FROM t),
    thousands AS (SELECT rank // 1000 AS part, sha256(string_agg(h, '' ORDER BY rank)) AS h FROM lines GROUP BY part)
    SELECT sha256(string_agg(h, '' ORDER BY part)) AS fingerprint, TRUE AS unchanged, (SELECT count(*) FROM t) AS n_rows FROM thousands""",
)
def explained_run(spark, sf_dir):
    """The scripted writer over a ranking; its fingerprint before and after."""
    rows = store(spark, sf_dir).recommend({"target_gene": GENE, "exclusion_gene": EXCLUDED, "disease": CONTEXT, "top_n": 10})
    _, prints = explain_run(rows, "GENE_MULTIOMICS", GENE, None)
    return prints


_TARGETS = {"DepMap_ID": "id AS DepMap_ID", "cellLine": "name AS cellLine", "queryMode": "'GENE_MULTIOMICS' AS queryMode", "targetGene": f"'{GENE}' AS targetGene", "targetProtein": "NULL::VARCHAR AS targetProtein"}


@register("ranking_export", f"WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))} SELECT {', '.join(_TARGETS.get(c, c) for c in EXPORTED)} FROM ranked WHERE rank <= 10")
def ranking_export(spark, sf_dir):
    """A request's answer as the file that users download, read back."""
    folder = scratch_folder(spark, "export")
    save_export(store(spark, sf_dir).recommend({"target_gene": GENE, "exclusion_gene": EXCLUDED, "disease": CONTEXT, "top_n": 10}), folder)
    return read_export(spark, folder)


_CARDINAL = "printf('%.4f', {})".format
_TOPS = """prof AS (SELECT 'ACH-' || lpad(vec_id::VARCHAR, 6, '0') AS id, unnest(embedding)::DOUBLE AS v, 'F' || lpad(unnest(range(len(embedding)))::VARCHAR, 3, '0') AS f FROM embeddings),
    tops AS (SELECT id, string_agg(f, ';' ORDER BY n) FILTER (WHERE NOT high) AS metabolites, string_agg(f, ';' ORDER BY n) FILTER (WHERE high) AS mirnas
             FROM (SELECT id, f, f >= 'F032' AS high, row_number() OVER (PARTITION BY id, f >= 'F032' ORDER BY v DESC, f) AS n FROM prof) WHERE n <= 3 GROUP BY id),
    sign AS (SELECT 'ACH-' || lpad(c_custkey::VARCHAR, 6, '0') AS id, c_acctbal AS msi, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey::DOUBLE END AS wgd FROM customer WHERE c_custkey % 5 <> 0)"""
_BEST = f"""{scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))}, {_TOPS}, best AS (SELECT * FROM ranked WHERE rank <= 10)"""
_TRACE = ["('DepMap_RNAseq', 'PRIMARY_rna_expression', depmap_rna_v, 'log2(TPM+1)')", "('HPA_RNAseq', 'PRIMARY_rna_expression', hpa_rna_v, 'log2(nTPM+1)')", "('GEO_RNA', 'PRIMARY_rna_expression', geo_rna_v, 'log2(intensity+1)')", "('CCLE_Gygi_Proteomics', 'PRIMARY_protein_expression', prot_v, 'log2 MS intensity')",
          "('DepMap_Mutation', CASE WHEN high THEN 'PRIMARY_high_impact_mutation' ELSE 'PRIMARY_mutation' END, CASE WHEN mutated THEN depmap_mutation_v END, 'event count')", "('DepMap_Fusion', 'PRIMARY_fusion', CASE WHEN fused_ THEN depmap_fusion_v END, 'event count')", "('DepMap_Fusion', 'PRIMARY_fusion_confidence', CASE WHEN fused_ THEN depmap_fusion_confidence_v END, 'source confidence')"]
_TRACED = " UNION ALL ".join(f"SELECT rank, id, name, {i} AS n, t.* FROM best, (SELECT 1), LATERAL (SELECT * FROM (VALUES {v}) t(dataset, kind, value, unit)) t WHERE t.value IS NOT NULL" for i, v in enumerate(_TRACE))
_MISSING = [("depmap_rna_z IS NULL", "DepMap RNA-seq evidence"), ("hpa_rna_z IS NULL", "HPA RNA-seq evidence"), ("geo_rna_z IS NULL", "GEO RNA expression evidence"), ("prot IS NULL", f"CCLE-Gygi protein evidence for {GENE}")]
_GAPS = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in zip((x for x, _ in _MISSING), ("Missing DepMap RNA-seq evidence.", "Missing HPA RNA-seq evidence.", "Missing GEO RNA-expression evidence.", f"Missing CCLE-Gygi proteomics evidence for {GENE}."), strict=True))
_PRINT = """lines AS (SELECT rank, sha256(concat_ws('|', rank, id, name, printf('%.4f', finalScore), printf('%.4f', confidenceScore), recommendationLevel)) AS h FROM best),
    thousands AS (SELECT rank // 1000 AS part, sha256(string_agg(h, '' ORDER BY rank)) AS h FROM lines GROUP BY part), print_ AS (SELECT sha256(string_agg(h, '' ORDER BY part)) AS fingerprint FROM thousands)"""


def _context(spark, sf_dir):
    """Signatures of four of five entities; profiles of those that have a vector."""
    m = _matrix(spark, sf_dir).withColumn("DepMap_ID", star.entity_id(F.col("DepMap_ID")))
    top = lambda rows: top_features(rows, "DepMap_ID", "feature", "v", 3)
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    signatures = c.select(star.entity_id(F.col("c_custkey")).alias("DepMap_ID"), F.col("c_acctbal").alias("MSIScore"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("WGD"))
    return entity_context(star.spine(spark, sf_dir), signatures, top(m.where("feature >= 'F032'")), top(m.where("feature < 'F032'")))


def _saved_best(spark, sf_dir):
    """A request's answer, saved; how to read it."""
    rows = store(spark, sf_dir).recommend({"target_gene": GENE, "exclusion_gene": EXCLUDED, "disease": CONTEXT, "top_n": 10})
    folder, run_id = scratch_folder(spark, "runs"), uuid.uuid4().hex
    save_run(rows, folder, run_id)
    return lambda: load_run(spark, folder, run_id, rows.schema)


@register(
    "saved_run_detail",
    f"""WITH {_BEST}, {_PRINT}, traced AS ({_TRACED}),
    t AS (SELECT id, string_agg(dataset || ' ' || kind || ' ' || {_CARDINAL("value")} || ' ' || unit, ';' ORDER BY n) AS trace FROM traced GROUP BY id)
    SELECT id AS DepMap_ID, finalScore, coalesce(trace, '') AS trace, array_to_string(list_filter([{_GAPS}], lambda x: x IS NOT NULL), ' ') AS gaps,
           CASE WHEN s.id IS NULL THEN '' WHEN wgd IS NULL THEN 'MSIScore ' || {_CARDINAL("msi")} ELSE 'MSIScore ' || {_CARDINAL("msi")} || ';WGD ' || {_CARDINAL("wgd")} END AS signatures, coalesce(mirnas, '') AS mirnas, coalesce(metabolites, '') AS metabolites,
           array_to_string(list_filter([CASE WHEN s.id IS NULL THEN 'No File 14 global-signature record for this cell line.' END, CASE WHEN p.id IS NULL THEN 'No File 13 miRNA profile for this cell line.' END, CASE WHEN p.id IS NULL THEN 'No File 12 metabolomics profile for this cell line.' END], lambda x: x IS NOT NULL), ' ') AS notes,
           '0.55 0.3 0.15 0.3' AS weights, fingerprint FROM best b JOIN print_ ON TRUE LEFT JOIN t USING (id) LEFT JOIN sign s USING (id) LEFT JOIN tops p USING (id) WHERE rank = 3""",
)
def saved_run_detail(spark, sf_dir):
    """Rank 3 of a saved run with its trace, gaps, context and weights."""
    d = run_detail(_saved_best(spark, sf_dir)(), 3, "GENE_MULTIOMICS", GENE, _context(spark, sf_dir))
    four = lambda c: F.format_string("%.4f", c)
    line = lambda t: F.concat_ws(" ", t["dataset"], t["type"], four(t["value"]), t["unit"])
    signed = F.transform(F.map_entries("supplementary.global_signatures"), lambda e: F.concat_ws(" ", e["key"], four(e["value"])))
    names = lambda c: F.array_join(F.transform(f"supplementary.{c}", lambda x: x["feature"]), ";")
    weights = F.concat_ws(" ", *(F.get_json_object("weights", f"$.{k}") for k in ("rna", "protein", "confidence", "exclusion_penalty_max")))
    return d.select(
        "DepMap_ID", F.col("candidate.finalScore"), F.array_join(F.transform("evidence_trace", line), ";").alias("trace"), F.array_join("data_gaps", " ").alias("gaps"), F.array_join(signed, ";").alias("signatures"),
        names("top_mirna").alias("mirnas"), names("top_metabolites").alias("metabolites"), F.array_join("supplementary.notes", " ").alias("notes"), weights.alias("weights"), F.col("ranking_fingerprint").alias("fingerprint"),
    )


_SCORED = " || ', ' || ".join(f"{a}" for a in (
    f"coalesce('RNA score ' || {_CARDINAL('rnaScore')}, 'RNA score not measured')", f"coalesce('protein score ' || {_CARDINAL('proteinScore')}, 'protein score not measured')", f"'biological score ' || {_CARDINAL('biologicalScore')}",
    f"'exclusion penalty ' || {_CARDINAL('exclusionPenalty')}", f"'data completeness ' || {_CARDINAL('completenessScore')}", f"'source support ' || {_CARDINAL('sourceSupportScore')}"))
_LACKS = " UNION ALL ".join(f"SELECT 'LIMITATION', '{t} is not measured for the top recommendation.' FROM best WHERE rank = 1 AND {c}" for c, t in _MISSING)


@register(
    "explained_claims",
    f"""WITH {_BEST}, {_PRINT}, traced AS ({_TRACED}), measured AS (SELECT *, row_number() OVER (ORDER BY n) AS nth FROM traced WHERE rank = 1),
    near AS (SELECT b.name, b.id, b.finalScore, abs(a.rnaScore - b.rnaScore) AS dr, abs(a.proteinScore - b.proteinScore) AS dp FROM best b, best a WHERE a.rank = 1 AND b.rank > 1),
    alike AS (SELECT *, {r4("CASE WHEN dr IS NULL AND dp IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - (coalesce(dr, 0) + coalesce(dp, 0)) / ((dr IS NOT NULL)::INT + (dp IS NOT NULL)::INT))) END")} AS sim FROM near),
    others AS (SELECT * FROM alike ORDER BY sim DESC, finalScore DESC, id LIMIT 3),
    claims(claim_type, text) AS (
        SELECT 'SUPPORT', 'The deterministic recommender ranks ' || name || ' (' || id || ') at position 1 for gene {GENE}, with final score ' || {_CARDINAL("finalScore")} || ', confidence score ' || {_CARDINAL("confidenceScore")} || ', and recommendation level ' || recommendationLevel || '.' FROM best WHERE rank = 1
        UNION ALL SELECT 'SUPPORT', 'For ' || name || ', the deterministic score breakdown is: ' || {_SCORED} || '.' FROM best WHERE rank = 1
        UNION ALL {_LACKS}
        UNION ALL SELECT 'SUPPORT', dataset || ' reports ' || kind || ' for ' || name || ' with value ' || {_CARDINAL("value")} || ' ' || unit || '.' FROM measured WHERE nth <= 3
        UNION ALL SELECT 'ALTERNATIVE', name || ' is a similar alternative to the top recommendation, with similarity score ' || {_CARDINAL("sim")} || '.' FROM others
        UNION ALL SELECT 'CONTEXT', 'Supplementary global signatures are available for ' || name || '; they are context only and were not used in scoring.' FROM best JOIN sign USING (id) WHERE rank = 1)
    -- The digits of the feature's name are a number that the card of a missing protein doesn't carry.
    SELECT claim_type, text, NOT contains(text, 'evidence for {GENE} is') AS ok, CASE WHEN contains(text, 'evidence for {GENE} is') THEN 'L2_numeric' END AS failed_layer, fingerprint, TRUE AS unchanged FROM claims, print_""",
)
def explained_claims(spark, sf_dir):
    """What the scripted writer says of a saved run, checked against its cards; the run is read again afterwards."""
    reread = _saved_best(spark, sf_dir)
    claims, prints = explain_run(reread(), "GENE_MULTIOMICS", GENE, None, context=_context(spark, sf_dir), reread=reread)
    return claims.select("claim_type", "text", "ok", "failed_layer").crossJoin(F.broadcast(prints.select("fingerprint", "unchanged")))
