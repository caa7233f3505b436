"""Checks of a study: contrasts, portable resampling, parity, strata and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.scalar import rounded
from rankloom.operators.checks import by_stratum, check_row, contrasts, paired_bootstrap, parity, pool_counts, pool_order, top_with_tolerance, unique_finite
from rankloom.operators.reviews import candidate_pool, stability
from rankloom.operators.sweeps import CONTROLLED, config_table, sweep
from rankloom.queries import evaluation as E
from rankloom.queries.base import mean, r4, registry, scored, store
from rankloom.queries.reviews import _pooled, _ranked
from rankloom.session import materialised

QUERIES, ORACLE_SQL, register = registry()
# The controlled contrasts, each a reference and a treatment.
CONTRASTS = [
    ("C00_A0_vs_RNA_mean", "B0_rna_mean", "A0_team_baseline"),
    ("C01_remove_direct_protein", "A0_team_baseline", "A1a_no_direct_protein"),
    ("C02_remove_all_protein_evidence", "A0_team_baseline", "A1b_no_protein_evidence"),
    ("C03_remove_protein_confidence_only", "A0_team_baseline", "A1c_no_protein_confidence"),
    ("C04_remove_protein_conf_after_direct", "A1a_no_direct_protein", "A1b_no_protein_evidence"),
    ("C05_remove_direct_without_protein_conf", "A1c_no_protein_confidence", "A1b_no_protein_evidence"),
    ("C06_remove_full_confidence", "A0_team_baseline", "A2_no_confidence"),
    ("C07_remove_completeness", "A0_team_baseline", "A2a_no_conf_completeness"),
    ("C08_remove_source_support", "A0_team_baseline", "A2b_no_conf_source_support"),
    ("C09_remove_consistency", "A0_team_baseline", "A2c_no_conf_consistency"),
    ("C10_enable_adaptive_trust", "A0_team_baseline", "A4_adaptive_trust"),
]
METRICS = ["ndcg_at_5", "recall_at_10", "expected_rr"]
_PAIRS = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"{c}" for c in CONTRASTS) + ") t(contrast, reference, treatment))"
_LONG = " UNION ALL ".join(f"SELECT config, query, '{m}' AS metric, {m} AS v FROM detail" for m in METRICS)


@register(
    "controlled_contrasts",
    f"""WITH {E._evaluated(CONTROLLED, True)}, {_PAIRS}, ll AS ({_LONG}), dd AS (SELECT contrast, reference, treatment, r.metric, r.query, r.v AS a, t.v AS b, t.v - r.v AS d FROM pairs JOIN ll r ON r.config = reference JOIN ll t ON t.config = treatment AND t.query = r.query AND t.metric = r.metric)
    SELECT contrast, reference, treatment, metric, count(*) AS n, {r4("avg(a)", 6)} AS reference_mean, {r4("avg(b)", 6)} AS treatment_mean, {r4("avg(d)", 6)} AS mean_delta, {r4("quantile_cont(d, 0.5)", 6)} AS median_delta,
           count(*) FILTER (WHERE d > 1e-12) AS wins, count(*) FILTER (WHERE abs(d) <= 1e-12) AS ties, count(*) FILTER (WHERE d < -1e-12) AS losses FROM dd GROUP BY ALL""",
)
def controlled_contrasts(spark, sf_dir):
    pairs = spark.createDataFrame(CONTRASTS, "contrast string, reference string, treatment string")
    # Both sides of a contrast are read from the detail, a row for each configuration and query.
    out = contrasts(materialised(E.detail_of(spark, sf_dir, CONTROLLED)), pairs, METRICS, "query")
    return out.withColumns({c: rounded(F.col(c), 6) for c in ("reference_mean", "treatment_mean", "mean_delta", "median_delta")})


ROUNDS, SEED = 200, 20260723
_HEX = lambda x: f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr({x}, i, 1)) - 1)::BIGINT)), lambda a, b: a * 16 + b)"
_XOR = lambda a, n: f"xor({a}, ({a}) >> {n})"
_WORD = 1 << 32


@register(
    "portable_bootstrap",
    f"""WITH {E._evaluated(CONTROLLED, True)}, dd AS (SELECT x.config, x.query, x.ndcg_at_5 - b.ndcg_at_5 AS d FROM detail x JOIN detail b ON b.config = 'A0_team_baseline' AND b.query = x.query),
    vv AS (SELECT config, list(d ORDER BY query) AS v, count(*)::BIGINT AS n, max(abs(d)) <= 1e-12 AS zero, xor({_HEX("sha256(config)")}, {SEED}) AS seed FROM dd GROUP BY config),
    ss AS (SELECT vv.*, i, j, ((seed + ((i - 1) * n + j) * {0x6D2B79F5}) % {_WORD})::BIGINT AS s FROM vv, range(1, {ROUNDS + 1}) t(i), unnest(range(1, n + 1)) u(j)),
    aa AS (SELECT *, (({_XOR("s", 15)})::HUGEINT * (s | 1)::HUGEINT % {_WORD})::BIGINT AS x FROM ss),
    bb AS (SELECT *, xor(((x::HUGEINT + ({_XOR("x", 7)})::HUGEINT * (x | 61)::HUGEINT) % {_WORD})::BIGINT, x) AS y FROM aa),
    ee AS (SELECT config, zero, v, n, i, j, v[floor(({_XOR("y", 14)})::DOUBLE / {_WORD} * n)::BIGINT + 1] AS d FROM bb),
    mm AS (SELECT config, any_value(zero) AS zero, any_value(list_sum(v) / n) AS mean, i, sum(d) / any_value(n) AS m FROM ee GROUP BY config, i)
    SELECT config, {r4("any_value(mean)", 6)} AS mean_delta, {r4("CASE WHEN any_value(zero) THEN 0.0 ELSE quantile_cont(m, 0.025) END", 6)} AS low, {r4("CASE WHEN any_value(zero) THEN 0.0 ELSE quantile_cont(m, 0.975) END", 6)} AS high FROM mm GROUP BY config""",
)
def portable_bootstrap(spark, sf_dir):
    detail = materialised(E.detail_of(spark, sf_dir, CONTROLLED))
    base = detail.where("config = 'A0_team_baseline'").select("query", F.col("ndcg_at_5").alias("b"))
    differences = detail.join(base, "query").select("config", "query", (F.col("ndcg_at_5") - F.col("b")).alias("d"))
    out = paired_bootstrap(differences, "config", "query", "d", ROUNDS, SEED)
    return out.withColumns({c: rounded(F.col(c), 6) for c in ("mean_delta", "low", "high")})


_SWEPT = f"SELECT id, finalScore, confidenceScore FROM (WITH {E.swept([c for c in CONTROLLED if c.config == 'A0_team_baseline'], True)} SELECT * FROM ranked WHERE query = 'BRAND-13')"
_PRODUCED = f"SELECT id, finalScore, confidenceScore FROM (WITH {scored('BRAND-13', None, None, [], True)} SELECT * FROM ranked)"


@register(
    "study_checks",
    f"""WITH a AS ({_PRODUCED}), b AS ({_SWEPT}), c AS (SELECT a.id AS x, b.id AS y, a.finalScore = b.finalScore AND a.confidenceScore = b.confidenceScore AS same FROM a FULL JOIN b ON a.id = b.id),
    n AS (SELECT count(*) FILTER (WHERE y IS NULL) AS p, count(*) FILTER (WHERE x IS NULL) AS q, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND NOT same) AS r FROM c),
    u AS (SELECT count(*) FILTER (WHERE k > 1) AS k FROM (SELECT count(*) AS k FROM b GROUP BY id)), o AS (SELECT count(*) FILTER (WHERE finalScore IS NULL OR NOT isfinite(finalScore)) AS f FROM b),
    rows_ AS (SELECT 'parity' AS scope, 'only_produced' AS "check", p AS observed FROM n UNION ALL SELECT 'parity', 'only_swept', q FROM n UNION ALL SELECT 'parity', 'different', r FROM n
              UNION ALL SELECT 'sweep', 'repeated', k FROM u UNION ALL SELECT 'sweep', 'not_finite', f FROM o)
    SELECT scope, "check", CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status, observed, 0::BIGINT AS expected FROM rows_""",
)
def study_checks(spark, sf_dir):
    """The production ranker and the baseline of the controlled sweep give the same scores; keys are unique and scores finite."""
    produced = store(spark, sf_dir).rank("BRAND-13", None, None, None, merged=True)
    swept = sweep(E.rows_of(spark, sf_dir), config_table(spark, [c for c in CONTROLLED if c.config == "A0_team_baseline"]), ["query"], controlled=True)
    swept = materialised(swept.where("query = 'BRAND-13'"))
    same = materialised(parity(produced, swept, ["DepMap_ID"], ["finalScore", "confidenceScore"]))
    sound = materialised(unique_finite(swept, ["DepMap_ID"], ["finalScore"]))
    out = check_row("parity", "only_produced", same, "only_a")
    for scope, name, counted, column in (("parity", "only_swept", same, "only_b"), ("parity", "different", same, "different"), ("sweep", "repeated", sound, "n_repeated"), ("sweep", "not_finite", sound, "n_not_finite")):
        out = out.unionByName(check_row(scope, name, counted, column))
    return out


@register(
    "panel_summary",
    f"""WITH s AS ({E.ORACLE_SQL["sweep_against_baseline"]}), t AS (SELECT *, CASE WHEN query IN ('BRAND-13', 'BRAND-7') THEN 'reliable' ELSE 'unreliable' END AS stratum FROM s)
    SELECT stratum, config, count(*) AS n, {r4(mean("jaccard"))} AS mean_jaccard, {r4(mean("top1_changed::INT"))} AS mean_top1_changed FROM (SELECT * FROM t UNION ALL SELECT * REPLACE ('ALL' AS stratum) FROM t) GROUP BY stratum, config""",
)
def panel_summary(spark, sf_dir):
    detail = E.sweep_against_baseline(spark, sf_dir).withColumn("stratum", F.when(F.col("query").isin("BRAND-13", "BRAND-7"), "reliable").otherwise("unreliable"))
    out = by_stratum(detail.withColumn("top1_changed", F.col("top1_changed").cast("int")), "stratum", ["config"], ["jaccard", "top1_changed"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean_jaccard", "mean_top1_changed")})


@register("top_with_tolerance", f"WITH {E.swept(CONTROLLED, True)}, l AS (SELECT config, query, finalScore AS last FROM ranked WHERE rank = 10) SELECT r.config, r.query, count(*) AS n, min(finalScore) AS least FROM ranked r LEFT JOIN l USING (config, query) WHERE last IS NULL OR finalScore >= last - 1e-12 GROUP BY ALL")
def kept_with_tolerance(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir)
    return top_with_tolerance(ranked, ["config", "query"], 10).groupBy("config", "query").agg(F.count(F.lit(1)).alias("n"), F.min("finalScore").alias("least"))


_POOL = f"""WITH {E.swept(CONTROLLED, True)}, {E._LABELS}, chosen AS (SELECT DISTINCT query, id FROM ranked WHERE rankMin <= 5 UNION SELECT query, id FROM labels),
    pool AS (SELECT r.query, r.id, min(rankMin) AS min_rank, any_value(l.relation) AS relation FROM ranked r JOIN chosen c ON r.query = c.query AND r.id = c.id LEFT JOIN labels l ON l.query = r.query AND l.id = r.id GROUP BY r.query, r.id)"""


def _pool(spark, sf_dir):
    labels, ranked = _pooled(spark, sf_dir, 5)
    return candidate_pool(ranked, labels, 5, [])


@register("pool_counts", f"{_POOL} SELECT query, count(*) AS n_candidates, count(relation) AS n_labelled, count(*) FILTER (WHERE relation = 'positive') AS n_positive, count(*) FILTER (WHERE relation = 'negative') AS n_negative FROM pool GROUP BY query")
def counts_of_pool(spark, sf_dir):
    return pool_counts(_pool(spark, sf_dir))


@register("pool_order", f"{_POOL} SELECT query, id AS DepMap_ID, row_number() OVER (PARTITION BY query ORDER BY min_rank NULLS LAST, id) AS position FROM pool")
def order_of_pool(spark, sf_dir):
    return pool_order(_pool(spark, sf_dir)).select("query", "DepMap_ID", "position")


@register(
    "label_stability",
    f"""WITH {E._evaluated(CONTROLLED, True)}, mm AS (SELECT v, config, avg(ndcg_at_5) AS m FROM (SELECT 'all' AS v, * FROM detail UNION ALL SELECT 'some', * FROM detail WHERE query <> 'BRAND-1') GROUP BY v, config),
    rr AS (SELECT *, rank() OVER (PARTITION BY v ORDER BY m DESC) AS rank FROM mm)
    SELECT a.config, a.rank AS rank_a, b.rank AS rank_b, b.rank - a.rank AS moved, {r4("b.m - a.m", 6)} AS change FROM rr a JOIN rr b ON a.v = 'all' AND b.v = 'some' AND a.config = b.config""",
)
def label_stability(spark, sf_dir):
    """Configurations under all labels and under those of all queries but one."""
    detail = materialised(E.detail_of(spark, sf_dir, CONTROLLED))
    both = detail.withColumn("version", F.lit("all")).unionByName(detail.where("query <> 'BRAND-1'").withColumn("version", F.lit("some")))
    return stability(both, "all", "some", "ndcg_at_5")
