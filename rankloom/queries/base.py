"""Registration, and the common table expressions that SQL of several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans.recommend import EvidenceStore
from rankloom.sources import star

Query = Callable[[SparkSession, str], DataFrame]
SOURCES = ["depmap_rna", "hpa_rna", "geo_rna", "ccle_gygi_protein", "depmap_mutation", "depmap_mutation_highimpact", "depmap_fusion", "depmap_fusion_confidence"]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def register(name: str, text: str | None = None):
        def add(f: Query) -> Query:
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, register


def store(spark: SparkSession, sf_dir: str) -> EvidenceStore:
    return EvidenceStore(star.raw_long(spark, sf_dir), star.spine(spark, sf_dir), star.annotations(spark, sf_dir))


def r4(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def mean(x: str, digits: int = 9) -> str:
    """The mean of values of so many digits at most, in any order."""
    return f"(sum(floor(({x}) * 1e{digits} + 0.5)::HUGEINT)::DOUBLE / count({x}) / 1e{digits})"


def clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END)"


LONG = """
    bridge AS (SELECT o_orderkey, 'ACH-' || lpad(o_custkey::VARCHAR, 6, '0') AS id FROM orders WHERE o_orderstatus <> 'P'),
    li AS (SELECT b.id, translate(upper(trim(p.p_brand)), '#', '-') AS feature, l.* FROM lineitem l JOIN bridge b ON l.l_orderkey = b.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
    mut AS (SELECT id, feature, count(*) AS n, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS high
            FROM li WHERE l_linestatus = 'F' AND l_returnflag = 'A' GROUP BY id, feature),
    fused AS (SELECT * FROM li WHERE l_linestatus = 'F' AND l_returnflag = 'R'),
    partners AS (SELECT id, feature, l_tax FROM fused
                 UNION ALL SELECT f.id, translate(upper(trim(p.p_brand)), '#', '-'), f.l_tax FROM fused f JOIN part p ON p.p_partkey = (f.l_partkey * 7 + 1) % (SELECT count(*) FROM part)),
    fus AS (SELECT id, feature, count(*) AS n, max(CASE WHEN l_tax >= 0.06 THEN 3.0 WHEN l_tax >= 0.03 THEN 2.0 ELSE 1.0 END) AS best FROM partners GROUP BY id, feature),
    long AS (
        SELECT id, feature, 'rna' AS layer, CASE l_returnflag WHEN 'N' THEN 'depmap_rna' WHEN 'A' THEN 'hpa_rna' ELSE 'geo_rna' END AS src,
               log2(l_extendedprice + 1) AS v FROM li WHERE l_linestatus = 'O'
        UNION ALL SELECT id, feature, 'protein', 'ccle_gygi_protein', l_quantity::DOUBLE FROM li WHERE l_linestatus = 'F' AND l_returnflag = 'N'
        UNION ALL SELECT id, feature, 'mutation', 'depmap_mutation', n::DOUBLE FROM mut
        UNION ALL SELECT id, feature, 'mutation', 'depmap_mutation_highimpact', high::DOUBLE FROM mut
        UNION ALL SELECT id, feature, 'fusion', 'depmap_fusion', n::DOUBLE FROM fus
        UNION ALL SELECT id, feature, 'fusion', 'depmap_fusion_confidence', best::DOUBLE FROM fus),
    stats AS (SELECT src, feature, avg(v) AS m, stddev_pop(v) AS sd, count(v) AS n FROM long GROUP BY src, feature),
    zlong AS (SELECT l.*, CASE WHEN s.n > 1 AND s.sd > 0 THEN (l.v - s.m) / s.sd END AS z FROM long l JOIN stats s USING (src, feature)),
    spine AS (SELECT 'ACH-' || lpad(c_custkey::VARCHAR, 6, '0') AS id, c_name AS name, c_mktsegment AS disease, r_name AS lineage
              FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_STD = ["depmap_rna_z", "hpa_rna_z", "geo_rna_z"]
_N_RNA = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _STD)
_SUM_RNA = " + ".join(f"coalesce({c}, 0)" for c in _STD)


def wide(*features: str) -> str:
    """``wide``: a row for each entity and feature, with <source>_v and <source>_z, nrna and rna."""
    values = ", ".join(f"('{f}')" for f in features)
    means = ", ".join(f"avg(v) FILTER (WHERE src = '{s}') AS {s}_v, avg(z) FILTER (WHERE src = '{s}') AS {s}_z" for s in SOURCES)
    return f"""{LONG},
    feats AS (SELECT * FROM (VALUES {values}) t(feature)),
    means AS (SELECT id, feature, {means} FROM zlong WHERE feature IN (SELECT feature FROM feats) GROUP BY id, feature),
    wide0 AS (SELECT s.id, f.feature, m.* EXCLUDE (id, feature), {_N_RNA} AS nrna FROM spine s CROSS JOIN feats f LEFT JOIN means m ON m.id = s.id AND m.feature = f.feature),
    wide AS (SELECT *, CASE WHEN nrna > 0 THEN ({_SUM_RNA}) / nrna END AS rna FROM wide0)"""


def candidates(gene: str | None, protein: str | None, exclusion: str | None, aliases: list[str]) -> str:
    """``cand``: candidate rows of a query."""
    main, prot = gene or protein, protein or gene
    names = list(dict.fromkeys(f for f in (gene, protein, exclusion) if f))
    text = r"trim(regexp_replace(translate(lower(disease || ' ' || lineage), '-_/', '   '), '\s+', ' ', 'g'))"
    hit = " OR ".join(f"contains({text}, '{a}')" for a in aliases) or "TRUE"
    need = "prot IS NOT NULL" if not gene else "nrna > 0 OR prot IS NOT NULL"
    excl = f"(SELECT id, rna AS excl FROM wide WHERE feature = '{exclusion}')" if exclusion else "(SELECT id, NULL::DOUBLE AS excl FROM spine)"
    return f"""{wide(*names)},
    cand AS (SELECT s.id, s.name, s.disease, s.lineage, w.* EXCLUDE (id, feature), p.prot, p.prot_v, x.excl,
                    coalesce(w.depmap_mutation_v > 0, FALSE) AS mutated, coalesce(w.depmap_fusion_v > 0, FALSE) AS fused_, coalesce(w.depmap_mutation_highimpact_v > 0, FALSE) AS high
             FROM wide w JOIN spine s USING (id)
             LEFT JOIN (SELECT id, ccle_gygi_protein_z AS prot, ccle_gygi_protein_v AS prot_v FROM wide WHERE feature = '{prot}') p USING (id)
             LEFT JOIN {excl} x USING (id)
             WHERE w.feature = '{main}' AND ({hit}) AND ({need}))"""


def minmax(column: str, over: str = "", constant: str = "CASE WHEN max({c}) OVER ({o}) > 0 THEN 1.0 ELSE 0.0 END") -> str:
    c, o = column, over
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER ({o}) = min({c}) OVER ({o}) THEN {constant.format(c=c, o=o)} ELSE ({c} - min({c}) OVER ({o})) / (max({c}) OVER ({o}) - min({c}) OVER ({o})) END"


def level(x: str, names: tuple[str, ...]) -> str:
    cuts = (0.80, 0.65, 0.50, 0.35)
    return "CASE " + " ".join(f"WHEN {x} >= {c} THEN '{n}'" for c, n in zip(cuts, names, strict=False)) + f" ELSE '{names[-1]}' END"


def scored(gene: str | None, protein: str | None, exclusion: str | None, aliases: list[str], merged: bool = False, weights: tuple = (0.55, 0.30, 0.15, 0.40, 0.35, 0.25, 0.30)) -> str:
    """``ranked``: candidates with scores and rank."""
    wr, wp, wc, k1, k2, k3, cap = weights
    biology = "p" if not gene else f"({wr} * coalesce(r, 0) + {wp} * coalesce(p, 0)) / nullif({wr} * (r IS NOT NULL)::INT + {wp} * (p IS NOT NULL)::INT, 0)"
    status = "CASE WHEN mutated AND fused_ THEN 'MIXED: MUTATION + FUSION' WHEN mutated AND high THEN 'MUTATION (HIGH-IMPACT)' WHEN mutated THEN 'MUTATION' WHEN fused_ THEN 'FUSION' ELSE 'NO ALTERATION' END"
    order = "finalScore DESC, floor(final * 1e9 + 0.5) DESC, id" if merged else "finalScore DESC, confidenceScore DESC, id"
    return f"""{candidates(gene, protein, exclusion, aliases)},
    scaled AS (SELECT *, {minmax("rna")} AS r, {minmax("prot")} AS p, {minmax("excl")} AS e FROM cand),
    parts AS (SELECT *, coalesce({cap} * e, 0) AS penalty, ((r IS NOT NULL)::INT + (p IS NOT NULL)::INT) / 2.0 AS complete,
                     ((depmap_rna_z IS NOT NULL)::INT + (hpa_rna_z IS NOT NULL)::INT + (geo_rna_z IS NOT NULL)::INT + (prot IS NOT NULL)::INT) / 4.0 AS backed,
                     CASE WHEN r IS NOT NULL AND p IS NOT NULL THEN {clip("1.0 - abs(r - p)")} WHEN r IS NOT NULL OR p IS NOT NULL THEN 0.5 ELSE 0.0 END AS agree,
                     {biology} AS biology FROM scaled),
    conf AS (SELECT *, {clip(f"{k1} * complete + {k2} * backed + {k3} * agree")} AS confidence FROM parts WHERE biology IS NOT NULL),
    fin AS (SELECT *, {clip(f"{wr + wp} * biology + {wc} * confidence - penalty")} AS final, {status} AS alterationStatus FROM conf),
    done AS (SELECT *, {r4("r")} AS rnaScore, {r4("p")} AS proteinScore, {r4("biology")} AS biologicalScore, {r4("penalty")} AS exclusionPenalty, {r4("complete")} AS completenessScore,
                    {r4("backed")} AS sourceSupportScore, {r4("agree")} AS rnaProteinConsistencyScore, {r4("confidence")} AS confidenceScore, {r4("final")} AS finalScore,
                    {level("confidence", ("High", "Medium-High", "Medium", "Medium-Low", "Low"))} AS confidenceLevel,
                    {level("final", ("Strongly Recommended", "Recommended", "Conditionally Recommended", "Low Priority", "Not Recommended"))} AS recommendationLevel FROM fin),
    ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM done)"""
