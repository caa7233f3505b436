"""Long table, standardisation, wide table, coverage and replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.scalar import list_texts, rounded, rounded_epsilon
from rankloom.operators.evidence import coverage, replicate_audit, rna_mean
from rankloom.operators.reviews import known_rows
from rankloom.queries.base import LONG, SOURCES, r4, registry, store, wide
from rankloom.session import table
from rankloom.sources import star

QUERIES, ORACLE_SQL, register = registry()
FEATURES = ("BRAND-13", "BRAND-7", "BRAND-22")


@register("long_table_coverage", f"WITH {LONG} SELECT layer AS omics_layer, src AS source, count(*) AS n_rows, count(DISTINCT id) AS n_entities, count(DISTINCT feature) AS n_features FROM long GROUP BY ALL")
def long_table_coverage(spark, sf_dir):
    return coverage(star.long_by_entity(spark, sf_dir))


@register(
    "standardised_by_source_and_feature",
    f"WITH {LONG} SELECT src AS source, feature AS gene_symbol, count(*) AS n, count(z) AS n_std, {r4('min(z)')} AS lo, {r4('max(z)')} AS hi, {r4('stddev_pop(z)')} AS sd FROM zlong GROUP BY ALL",
)
def standardised(spark, sf_dir):
    z = star.standard_long(spark, sf_dir)
    return z.groupBy("source", "gene_symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_std").alias("n_std"), rounded(F.min("value_std")).alias("lo"), rounded(F.max("value_std")).alias("hi"), rounded(F.stddev_pop("value_std")).alias("sd")
    )


_HAS = {"rna": SOURCES[:3], "protein": SOURCES[3:4], "mutation": SOURCES[4:6], "fusion": SOURCES[6:]}
_FLAGS = {k: "(" + " OR ".join(f"{s}_v IS NOT NULL" for s in v) + ")" for k, v in _HAS.items()}
_SPREAD = "sqrt((" + " + ".join(f"coalesce(({s}_z - rna) * ({s}_z - rna), 0)" for s in SOURCES[:3]) + ") / nrna)"


@register(
    "wide_feature_tables",
    f"""WITH {wide(*FEATURES)}
    SELECT id AS DepMap_ID, feature AS gene_symbol, {", ".join(f"{r4(s + '_v')} AS {s}__raw, {r4(s + '_z')} AS {s}__std" for s in SOURCES)},
           {", ".join(f"{c} AS has_{k}" for k, c in _FLAGS.items())}, {r4("rna")} AS rna_mean,
           CASE WHEN nrna >= 2 THEN {r4(f"1.0 - greatest(0.0, least(1.0, {_SPREAD}))")} END AS rna_consistency,
           ({" + ".join(f"{c}::INT" for c in _FLAGS.values())}) / 4.0 AS data_completeness FROM wide""",
)
def wide_feature_tables(spark, sf_dir):
    w = store(spark, sf_dir).wide(*FEATURES).withColumn("rna_mean", rounded(rna_mean()))
    values = {f"{s}__{k}": rounded(F.col(f"{s}__{k}")) for s in SOURCES for k in ("raw", "std")}
    return w.withColumns({**values, "rna_consistency": rounded(F.col("rna_consistency"))})


@register(
    "replicate_audit",
    f"""WITH {LONG}, g AS (SELECT src, feature, id, count(*) AS n, count(DISTINCT v) AS d FROM long GROUP BY ALL)
    SELECT src AS source, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_repeated, count(*) FILTER (WHERE d > 1) AS n_conflicting, sum(n - 1)::BIGINT AS n_collapsed FROM g GROUP BY src""",
)
def replicates(spark, sf_dir):
    return replicate_audit(star.long_by_entity(spark, sf_dir))


@register(
    "observed_entities_by_feature",
    f"WITH {LONG} SELECT feature AS gene_symbol, {', '.join(f'count(DISTINCT id) FILTER (WHERE src = {chr(39)}{s}{chr(39)}) AS {s}' for s in SOURCES)} FROM long GROUP BY feature",
)
def observed(spark, sf_dir):
    cells = star.long_by_entity(spark, sf_dir).select("DepMap_ID", "gene_symbol", "source").distinct()
    counts = cells.groupBy("gene_symbol").pivot("source", SOURCES).agg(F.count("DepMap_ID"))
    return counts.fillna(0, SOURCES)


_PAIRS = [(a, b) for i, a in enumerate(SOURCES[:4]) for b in SOURCES[i + 1 : 4]]


@register(
    "source_correlations",
    f"WITH {LONG}, m AS (SELECT id, feature, {', '.join(f'avg(z) FILTER (WHERE src = {chr(39)}{s}{chr(39)}) AS {s}' for s in SOURCES[:4])} FROM zlong GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r4(f'corr({a}, {b})', 6)} AS r FROM m" for a, b in _PAIRS),
)
def source_correlations(spark, sf_dir):
    """Pairwise-complete correlations of the sources' standardised values, over all pairs in one pass."""
    m = star.standard_long(spark, sf_dir).where(F.col("source").isin(SOURCES[:4])).groupBy("DepMap_ID", "gene_symbol").pivot("source", SOURCES[:4]).agg(F.avg("value_std"))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), rounded(F.corr(a, b), 6).alias("r")) for a, b in _PAIRS]
    return m.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@register(
    "missing_rates",
    f"""WITH {wide(*FEATURES)} SELECT s.src AS source, {r4("avg((v IS NULL)::INT)", 6)} AS missing_rate, {r4("quantile_cont(v, 0.25)")} AS q1, {r4("quantile_cont(v, 0.5)")} AS median, {r4("quantile_cont(v, 0.75)")} AS q3
    FROM ({" UNION ALL ".join(f"SELECT '{s}' AS src, {s}_v AS v FROM wide" for s in SOURCES)}) s GROUP BY s.src""",
)
def missing_rates(spark, sf_dir):
    w = store(spark, sf_dir).wide(*FEATURES).select(*(F.col(f"{s}__raw").alias(s) for s in SOURCES))
    rows = w.unpivot([], SOURCES, "source", "v")
    q = lambda x: rounded(F.percentile("v", F.lit(x)))
    return rows.groupBy("source").agg(rounded(F.avg(F.col("v").isNull().cast("int")), 6).alias("missing_rate"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


@register(
    "source_overlaps",
    f"""WITH {LONG}, e AS (SELECT DISTINCT src, id FROM long)
    SELECT a.src AS a, b.src AS b, count(*) AS n_common FROM e a JOIN e b ON a.id = b.id AND a.src < b.src GROUP BY ALL""",
)
def source_overlaps(spark, sf_dir):
    """Entities that two sources share: the sources of an entity are few, so pairs are made within an entity's set."""
    sets = star.raw_long(spark, sf_dir).groupBy("DepMap_ID").agg(F.collect_set("source").alias("s"))
    pairs = sets.select("DepMap_ID", F.explode("s").alias("a"), "s").select("DepMap_ID", "a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"))


@register(
    "known_entities_audit",
    """WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    SELECT count(*) AS n_rows, count(k.c_custkey) AS n_kept, count(*) - count(k.c_custkey) AS n_removed, count(DISTINCT CASE WHEN k.c_custkey IS NULL THEN o_custkey END) AS n_entities_removed,
           min(CASE WHEN k.c_custkey IS NULL THEN 'ACH-' || lpad(o_custkey::VARCHAR, 6, '0') END) AS first_removed FROM orders LEFT JOIN k ON o_custkey = c_custkey""",
)
def known_entities_audit(spark, sf_dir):
    """Orders of entities that aren't known (those without a balance) are removed, and counted."""
    rows = table(spark, sf_dir, "orders").select(star.entity_id(F.col("o_custkey")).alias("DepMap_ID"), "o_orderkey")
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(star.entity_id(F.col("c_custkey")).alias("DepMap_ID"))
    return known_rows(rows, known)[1]


@register(
    "entity_sheet",
    f"""WITH {LONG}, g AS (SELECT id, string_agg(DISTINCT src, ';' ORDER BY src) AS sources, count(*) AS n, bool_or(layer = 'protein') AS protein FROM long GROUP BY id)
    SELECT s.id AS DepMap_ID, coalesce(sources, '') AS sources, coalesce(n::VARCHAR, '') AS n_rows, CASE WHEN protein THEN 'True' WHEN NOT protein THEN 'False' ELSE '' END AS has_protein FROM spine s LEFT JOIN g USING (id)""",
)
def entity_sheet(spark, sf_dir):
    """Every entity with its sources as the text of a sheet; entities without evidence have empty cells."""
    of = star.raw_long(spark, sf_dir).groupBy("DepMap_ID").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.col("omics_layer") == "protein").alias("has_protein"))
    rows = star.spine(spark, sf_dir).select("DepMap_ID").join(of, "DepMap_ID", "left")
    return rows.select(*list_texts(rows, *rows.columns))


_SEVENTH = "(o_totalprice::DOUBLE / 7 + 2.220446049250313e-16) * 1e8"


@register("epsilon_rounding", f"SELECT o_orderkey, (floor({_SEVENTH}) + ({_SEVENTH} - floor({_SEVENTH}) >= 0.5)::INT) / 1e8 AS share FROM orders")
def epsilon_rounding(spark, sf_dir):
    """A seventh of every order, rounded as study reports are."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rounded_epsilon(F.col("o_totalprice").cast("double") / 7).alias("share"))
