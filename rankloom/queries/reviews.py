"""Panels, the prototype scorer, pools, queues and label checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.scalar import count_available, mean_available, rounded
from rankloom.operators.evidence import RNA
from rankloom.operators.panels import QUOTAS, prototype_scores, sample_strata, stratum
from rankloom.operators.reviews import blinded, candidate_pool, check_labels, detectability, disagreements, export_verified
from rankloom.operators.sweeps import CONTROLLED, config_table, pool_scores, sweep
from rankloom.queries.base import LONG, r4, registry, store, wide
from rankloom.queries.evaluation import _LABELS, TARGETS, labels_of, rows_of, swept
from rankloom.session import materialised
from rankloom.sources import star

QUERIES, ORACLE_SQL, register = registry()
SEED = 20240
PROFILE = ("BRAND-13", "BRAND-7")

_CATALOG = f"""{LONG}, pm AS (SELECT id, feature, avg(z) FILTER (WHERE layer = 'rna') AS x, avg(z) FILTER (WHERE layer = 'protein') AS y FROM zlong GROUP BY ALL),
    cc AS (SELECT feature, corr(x, y) AS correlation, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS correlation_n FROM pm GROUP BY feature),
    cat AS (SELECT feature, count(DISTINCT src) FILTER (WHERE layer = 'rna') AS rna_sources, count(DISTINCT id) FILTER (WHERE layer = 'protein') AS protein_n FROM long GROUP BY feature),
    catalog AS (SELECT cat.*, floor(correlation * 1e6 + 0.5) / 1e6 * 5 AS correlation, correlation_n FROM cat JOIN cc USING (feature)),
    strata AS (SELECT *, CASE WHEN protein_n < 10 AND rna_sources = 1 THEN 'depmap_rna_only' WHEN protein_n < 10 AND rna_sources >= 2 THEN 'multisource_rna_no_protein'
                    WHEN protein_n >= 10 AND (correlation IS NULL OR correlation_n < 10) THEN 'protein_no_reliable_corr'
                    WHEN rna_sources >= 2 AND correlation >= 0.5 THEN 'protein_corr_high' WHEN rna_sources >= 2 AND correlation <= 0.25 THEN 'protein_corr_low' WHEN rna_sources >= 2 THEN 'protein_corr_mid' ELSE 'not_selected_pool' END AS stratum FROM catalog)"""


def catalog_of(spark, sf_dir):
    """Features with their sources, protein coverage and correlation (stretched, so that all bands occur)."""
    z = star.standard_long(spark, sf_dir)
    layer = lambda name, c: F.when(F.col("omics_layer") == name, F.col(c))
    cover = z.groupBy(F.col("gene_symbol").alias("feature")).agg(F.count_distinct(layer("rna", "source")).alias("rna_sources"), F.count_distinct(layer("protein", "DepMap_ID")).alias("protein_n"))
    pairs = z.groupBy("DepMap_ID", F.col("gene_symbol").alias("feature")).agg(F.avg(layer("rna", "value_std")).alias("x"), F.avg(layer("protein", "value_std")).alias("y"))
    corr = pairs.groupBy("feature").agg((rounded(F.corr("x", "y"), 6) * 5).alias("correlation"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("correlation_n"))
    return cover.join(corr, "feature").withColumn("stratum", stratum())


@register("coverage_strata", f"WITH {_CATALOG} SELECT feature, rna_sources, protein_n, {r4('correlation')} AS correlation, correlation_n, stratum FROM strata")
def coverage_strata(spark, sf_dir):
    return catalog_of(spark, sf_dir).withColumn("correlation", rounded(F.col("correlation")))


_MOST = "CASE stratum " + " ".join(f"WHEN '{k}' THEN {v // 5}" for k, v in QUOTAS.items()) + " ELSE 0 END"


@register("stratified_panel", f"WITH {_CATALOG}, s AS (SELECT feature, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}|' || feature), feature) AS nth FROM strata) SELECT feature, stratum, nth::INT AS nth FROM s WHERE nth <= {_MOST}")
def stratified_panel(spark, sf_dir):
    picked = sample_strata(catalog_of(spark, sf_dir), {k: v // 5 for k, v in QUOTAS.items()}, SEED)
    return picked.select("feature", "stratum", "nth")


_PCT = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY p.query, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY p.query, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY p.query) END"
_MM = lambda c: f"CASE WHEN {c} IS NULL THEN 0.0 WHEN max({c}) OVER (PARTITION BY p.query) = min({c}) OVER (PARTITION BY p.query) THEN 0.0 ELSE ({c} - min({c}) OVER (PARTITION BY p.query)) / (max({c}) OVER (PARTITION BY p.query) - min({c}) OVER (PARTITION BY p.query)) END"


@register(
    "prototype_scores",
    f"""WITH {wide(*PROFILE)},
    prof AS (SELECT w.feature AS query, w.id, s.lineage, w.depmap_rna_v AS rna, w.ccle_gygi_protein_v AS protein, w.depmap_fusion_v IS NOT NULL AS excluded FROM wide w JOIN spine s USING (id) WHERE w.depmap_rna_v IS NOT NULL OR w.ccle_gygi_protein_v IS NOT NULL),
    q AS (SELECT query, quantile_cont(rna, 0.75) AS q, count(lineage) AS n FROM prof GROUP BY query),
    sh AS (SELECT p.query, lineage, any_value(n) AS n, count(*) AS a, count(*) FILTER (WHERE rna >= q.q) AS h FROM prof p JOIN q USING (query) GROUP BY p.query, lineage),
    en AS (SELECT *, (h::DOUBLE / sum(h) OVER (PARTITION BY query)) / (a::DOUBLE / n) AS e FROM sh),
    ts AS (SELECT query, lineage, coalesce(least(e / max(e) OVER (PARTITION BY query), 1.0), 0) AS tissue FROM en),
    sc AS (SELECT p.*, tissue, {_MM("rna")} AS rs, {_MM("protein")} AS ps, {_PCT("rna")} AS rp, {_PCT("protein")} AS pp FROM prof p LEFT JOIN ts ON p.query = ts.query AND p.lineage = ts.lineage),
    fs AS (SELECT *, CASE WHEN rna IS NOT NULL AND protein IS NOT NULL THEN 1.0 - abs(rp - pp) ELSE 0.0 END AS cs, ((rna IS NOT NULL)::INT + (protein IS NOT NULL)::INT) / 2.0 AS comp FROM sc)
    SELECT query, id AS DepMap_ID, {r4("rs")} AS rna_score, {r4("ps")} AS protein_score, {r4("cs")} AS consistency_score, {r4("tissue")} AS tissue_score, comp AS completeness_score,
           {r4("CASE WHEN excluded THEN -1.0 WHEN protein IS NOT NULL THEN 0.4 * rs + 0.25 * ps + 0.15 * cs + 0.1 * tissue + 0.1 * comp ELSE (0.4 + 0.4 * 0.8) * rs + (0.1 + 0.4 * 0.2) * tissue + 0.1 * comp END")} AS final_score FROM fs""",
)
def prototype(spark, sf_dir):
    s = store(spark, sf_dir)
    w = s.wide(*PROFILE).join(s.annotations, "DepMap_ID", "left")
    profile = w.select(F.col("gene_symbol").alias("query"), "DepMap_ID", "lineage", F.col("depmap_rna__raw").alias("rna"), F.col("ccle_gygi_protein__raw").alias("protein"), F.col("depmap_fusion__raw").isNotNull().alias("excluded"))
    out = prototype_scores(profile.where("rna is not null or protein is not null"), ["query"])
    names = ["rna_score", "protein_score", "consistency_score", "tissue_score", "completeness_score", "final_score"]
    return out.select("query", "DepMap_ID", *(rounded(F.col(n)).alias(n) for n in names))


def _ranked(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return rows, materialised(sweep(rows, config_table(spark, CONTROLLED), ["query"], controlled=True))


def _pooled(spark, sf_dir, k: int):
    """Labels, and the scores and places of all that can be in the pool of the k best."""
    rows = rows_of(spark, sf_dir)
    labels = labels_of(rows)
    return labels, materialised(pool_scores(rows, config_table(spark, CONTROLLED), ["query"], labels, k))


_SHOWN = ["A0_team_baseline", "B0_rna_mean", "A6_v3_full"]


@register(
    "candidate_pool",
    f"""WITH {swept(CONTROLLED, True)}, {_LABELS}, chosen AS (SELECT DISTINCT query, id FROM ranked WHERE rankMin <= 5 UNION SELECT query, id FROM labels)
    SELECT r.query, r.id AS DepMap_ID, min(rankMin) AS min_rank, min(finalScore) AS min_score, max(finalScore) AS max_score,
           coalesce(string_agg(config, ';' ORDER BY config) FILTER (WHERE rankMin <= 5), '') AS configs, {", ".join(f"max(rankMin) FILTER (WHERE config = '{c}') AS rank_{c}" for c in _SHOWN)}, any_value(l.relation) AS relation
    FROM ranked r JOIN chosen c ON r.query = c.query AND r.id = c.id LEFT JOIN labels l ON l.query = r.query AND l.id = r.id GROUP BY r.query, r.id""",
)
def pool(spark, sf_dir):
    labels, ranked = _pooled(spark, sf_dir, 5)
    return candidate_pool(ranked, labels, 5, _SHOWN)


@register(
    "blinded_review_sheet",
    f"""WITH {swept(CONTROLLED, True)}, {_LABELS}, chosen AS (SELECT DISTINCT query, id FROM ranked WHERE rankMin <= 5 UNION SELECT query, id FROM labels)
    SELECT 'V5-' || upper(substr(sha256(query || '|' || id), 1, 12)) AS review_id, query, id AS DepMap_ID, row_number() OVER (PARTITION BY query ORDER BY sha256('{SEED}|' || query || '|' || id)) AS position FROM chosen""",
)
def review_sheet(spark, sf_dir):
    labels, ranked = _pooled(spark, sf_dir, 5)
    return blinded(candidate_pool(ranked, labels, 5, []), SEED)


@register(
    "disagreement_queue",
    f"""WITH {swept(CONTROLLED, True)}, {_LABELS}, qa AS (SELECT * FROM ranked WHERE config = 'A0_team_baseline'), qb AS (SELECT * FROM ranked WHERE config = 'B0_rna_mean'),
    f AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.id, b.id) AS id, a.rankMin AS rank_a, a.finalScore AS score_a, b.rankMin AS rank_b, b.finalScore AS score_b FROM qa a FULL JOIN qb b ON a.query = b.query AND a.id = b.id)
    SELECT query, id AS DepMap_ID, rank_a, score_a, rank_b, score_b, CASE WHEN rank_a <= 10 THEN 'a' ELSE 'b' END AS only_in FROM f
    WHERE coalesce(rank_a <= 10, FALSE) <> coalesce(rank_b <= 10, FALSE) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.query = f.query AND l.id = f.id)""",
)
def queue(spark, sf_dir):
    rows, ranked = _ranked(spark, sf_dir)
    return disagreements(ranked, "A0_team_baseline", "B0_rna_mean", 10, labels_of(rows))


def _sheet(spark, sf_dir):
    """Labels as reviewers hand them in: some unverified, some with malformed ids, some twice."""
    labels = labels_of(rows_of(spark, sf_dir))
    mark = F.substring(F.md5(F.concat("DepMap_ID", "query")), 1, 1)
    rows = labels.withColumns({"verified": F.when(mark < "c", "yes").otherwise("no"), "DepMap_ID": F.when(mark == "3", F.concat(F.lit(" "), F.lower("DepMap_ID"))).when(mark == "4", "ACH-1").otherwise(F.col("DepMap_ID"))})
    return rows.unionByName(rows.where(mark == "5").withColumn("relation", F.lit("positive")))


_SHEET = f"""WITH {swept([CONTROLLED[1]], True)}, {_LABELS},
    s0 AS (SELECT query, id AS own, relation, substr(md5(id || query), 1, 1) AS m FROM labels),
    s1 AS (SELECT query, CASE WHEN m < 'c' THEN 'yes' ELSE 'no' END AS verified, CASE WHEN m = '3' THEN ' ' || lower(own) WHEN m = '4' THEN 'ACH-1' ELSE own END AS id, relation,
                  substr(md5((CASE WHEN m = '3' THEN ' ' || lower(own) WHEN m = '4' THEN 'ACH-1' ELSE own END) || query), 1, 1) AS m2 FROM s0),
    sheet AS (SELECT query, verified, id, relation FROM s1 UNION ALL SELECT query, verified, id, 'positive' FROM s1 WHERE m2 = '5'),
    norm AS (SELECT upper(trim(query)) AS query, upper(trim(id)) AS id, lower(trim(relation)) AS relation, verified = 'yes' AS ok FROM sheet)"""


@register(
    "label_checks",
    f"""{_SHEET}, p AS (SELECT query, id, count(*) AS n, count(DISTINCT relation) AS d FROM norm GROUP BY ALL)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_verified, count(*) FILTER (WHERE relation NOT IN ('positive', 'negative', 'unknown')) AS n_bad_relation,
           count(*) FILTER (WHERE NOT regexp_full_match(id, 'ACH-[0-9]{{6}}')) AS n_bad_id, count(*) FILTER (WHERE id NOT IN (SELECT id FROM spine)) AS n_unknown,
           (SELECT count(*) FROM p WHERE n > 1) AS n_repeated, (SELECT count(*) FROM p WHERE d > 1) AS n_conflicting FROM norm""",
)
def label_checks(spark, sf_dir):
    return check_labels(_sheet(spark, sf_dir), star.spine(spark, sf_dir))


@register("verified_labels", f"{_SHEET} SELECT query, id AS DepMap_ID, relation FROM norm WHERE ok AND relation IN ('positive', 'negative') AND regexp_full_match(id, 'ACH-[0-9]{{6}}')")
def verified_labels(spark, sf_dir):
    return export_verified(_sheet(spark, sf_dir))


@register(
    "label_detectability",
    f"""WITH {swept([CONTROLLED[1]], True)}, {_LABELS},
    prof AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY floor(rna * 1e6 + 0.5) DESC, id) AS rank, count(*) OVER (PARTITION BY query) AS n FROM cand WHERE rna IS NOT NULL),
    pos AS (SELECT *, {r4("100.0 * (1.0 - (rank - 1) / greatest(n - 1, 1))")} AS position FROM prof),
    j AS (SELECT l.query, l.id, relation, rank, position, CASE WHEN relation = 'positive' THEN position ELSE 100.0 - position END AS good FROM labels l LEFT JOIN pos p ON p.query = l.query AND p.id = l.id)
    SELECT query, id AS DepMap_ID, relation, rank, position, CASE WHEN good IS NULL THEN 'NOT_MEASURED' WHEN good >= 75 THEN 'OK' WHEN good >= 50 THEN 'WEAK' ELSE 'CONTRADICTED' END AS verdict FROM j""",
)
def label_detectability(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    profiles = rows.select("query", "DepMap_ID", F.floor(F.col("rnaExpr") * 1e6 + 0.5).alias("value"))
    return detectability(labels_of(rows), profiles)
