"""Labels found by name, rules of label and query tables, table digests, stacked tables, panels and re-keyed matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.scalar import rounded
from rankloom.operators.detect import detect
from rankloom.operators.evidence import panel_rows, stacked
from rankloom.operators.rules import all_known, development_report, development_rows, development_set, judgements, query_report, query_table, reports
from rankloom.operators.scoring import prepared_annotations
from rankloom.queries.base import LONG, r4, registry, store, wide
from rankloom.session import materialised, scratch_folder, table
from rankloom.sources import star
from rankloom.sources.digests import DIGITS, table_digest
from rankloom.sources.files import read_matrix_of

QUERIES, ORACLE_SQL, register = registry()
PROFILE = ("BRAND-13", "BRAND-7")
_NORM = lambda x: f"lower(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
_ID = "'ACH-' || lpad(c_custkey::VARCHAR, 6, '0')"


@register(
    "labels_by_name",
    f"""WITH {wide(*PROFILE)}, vals AS (SELECT feature AS query, id, depmap_rna_v AS v FROM wide),
    meas AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY v DESC, id) AS rank, count(*) OVER (PARTITION BY query) AS n FROM vals WHERE v IS NOT NULL),
    marked AS (SELECT f.feature, {_ID} AS id, c_name, substr(md5(f.feature || c_name), 1, 1) AS h, substr(md5(f.feature || c_name), 2, 1) AS g FROM customer, feats f),
    labels AS (SELECT CASE WHEN h = '5' THEN 'BRAND-99' ELSE feature END AS query, CASE h WHEN '0' THEN id WHEN '4' THEN 'ACH-999999' END AS lid,
                      CASE h WHEN '2' THEN substr(c_name, 4) WHEN '3' THEN right(c_name, 3) ELSE upper(replace(c_name, '#', ' -')) END AS name, CASE WHEN g < '8' THEN 'positive' ELSE 'negative' END AS relation FROM marked WHERE h < '6'),
    asked AS (SELECT DISTINCT query, lid, CASE WHEN lid IS NULL THEN {_NORM("name")} END AS needle FROM labels),
    named AS (SELECT id, {_NORM("name")} AS norm FROM spine),
    strict AS (SELECT a.query, a.lid, a.needle, m.id, m.rank, m.n, FALSE AS loose FROM asked a JOIN meas m ON m.query = a.query JOIN named d ON d.id = m.id WHERE m.id = a.lid OR d.norm = a.needle),
    lax AS (SELECT a.query, a.lid, a.needle, m.id, m.rank, m.n, TRUE AS loose FROM asked a JOIN meas m ON m.query = a.query JOIN named d ON d.id = m.id WHERE a.needle IS NOT NULL AND contains(d.norm, a.needle) AND NOT EXISTS (SELECT 1 FROM strict s WHERE s.query = a.query AND s.needle = a.needle)),
    hits AS (SELECT DISTINCT ON (query, lid, needle) * FROM (SELECT * FROM strict UNION ALL SELECT * FROM lax) ORDER BY query, lid, needle, rank),
    sizes AS (SELECT query, count(v) AS measured FROM vals GROUP BY query), empties AS (SELECT query, id FROM vals WHERE v IS NULL),
    done AS (SELECT l.*, h.id AS found_id, h.rank, h.loose, measured, e.id IS NOT NULL AS unmeasured, 100.0 * (h.rank - 1) / greatest(h.n - 1, 1) AS top FROM labels l
             LEFT JOIN hits h ON h.query = l.query AND h.lid IS NOT DISTINCT FROM l.lid AND h.needle IS NOT DISTINCT FROM CASE WHEN l.lid IS NULL THEN {_NORM("l.name")} END
             LEFT JOIN sizes s ON s.query = l.query LEFT JOIN empties e ON e.query = l.query AND e.id = l.lid)
    SELECT query, lid AS DepMap_ID, name, relation, CASE WHEN lid IS NOT NULL THEN 'id' WHEN loose THEN 'contained name' WHEN found_id IS NOT NULL THEN 'name' END AS match_by,
           CASE WHEN measured IS NULL THEN 'NOT IN PANEL' WHEN found_id IS NULL AND unmeasured THEN 'VALUE MISSING' WHEN found_id IS NULL THEN 'NOT FOUND'
                WHEN relation = 'positive' THEN CASE WHEN top <= 10 THEN 'OK' WHEN top <= 50 THEN 'WEAK' ELSE 'CONTRADICTED' END ELSE CASE WHEN top >= 75 THEN 'OK' WHEN top >= 50 THEN 'WEAK' ELSE 'CONTRADICTED' END END AS status,
           rank, measured AS n, {r4("top", 1)} AS top_percent, found_id FROM done""",
)
def labels_by_name(spark, sf_dir):
    """Labels given by id, by a name in other letters, by a part of one, and such as aren't there."""
    values = materialised(store(spark, sf_dir).wide(*PROFILE).select(F.col("gene_symbol").alias("query"), "DepMap_ID", F.col("depmap_rna__raw").alias("value")))
    features = spark.createDataFrame([(f,) for f in PROFILE], "feature string")
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(features)).withColumn("hash", F.md5(F.concat("feature", "c_name")))
    h = F.substring("hash", 1, 1)
    name = F.when(h == "2", F.substring("c_name", 4, 100)).when(h == "3", F.expr("right(c_name, 3)")).otherwise(F.upper(F.replace("c_name", F.lit("#"), F.lit(" -"))))
    labels = c.where(h < "6").select(
        F.when(h == "5", "BRAND-99").otherwise(F.col("feature")).alias("query"),
        F.when(h == "0", star.entity_id(F.col("c_custkey"))).when(h == "4", "ACH-999999").alias("DepMap_ID"),
        name.alias("name"),
        F.when(F.substring("hash", 2, 1) < "8", "positive").otherwise("negative").alias("relation"),
    )
    names = star.annotations(spark, sf_dir).select("DepMap_ID", F.col("cell_line_name").alias("name"))
    return detect(labels, values, names).withColumn("top_percent", rounded(F.col("top_percent"), 1))


_POOL = """pool AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'egfr ' ELSE 'brand-' || (c_custkey % 10 + 1) END AS query, CASE WHEN c_custkey % 53 = 0 THEN 'ACH-12' ELSE 'ach-' || lpad((c_custkey % 1000)::VARCHAR, 6, '0') END AS id,
        CASE c_nationkey % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative ' WHEN 2 THEN 'unknown' ELSE 'positive' END AS relation, CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'no' END AS verified,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'Weight_Tuning' WHEN 'MACHINERY' THEN ' weight_tuning' ELSE 'holdout' END AS benchmark_role, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS source_url FROM customer),
    dev AS (SELECT upper(trim(query)) AS query, upper(trim(id)) AS id, lower(trim(relation)) AS relation, lower(trim(verified)) = 'yes' AS ok, trim(source_url) AS source_url, upper(trim(query)) || '|' || upper(trim(id)) AS key
            FROM pool WHERE lower(trim(benchmark_role)) = 'weight_tuning')"""
_BROKEN = {
    "classic feature": "query IN ('EGFR', 'KRAS', 'ERBB2', 'MYC', 'TP53')",
    "relation": "ok AND relation NOT IN ('positive', 'negative')",
    "malformed id": "ok AND NOT regexp_matches(id, '^ACH-[0-9]{6}$')",
    "no source": "ok AND source_url = ''",
    "blank query": "ok AND query = ''",
}
_TOTALS = {"rows": ("count(*) FILTER (WHERE ok)", 50), "queries": ("count(DISTINCT query) FILTER (WHERE ok)", 10), "positives": ("count(*) FILTER (WHERE ok AND relation = 'positive')", 48), "negatives": ("count(*) FILTER (WHERE ok AND relation = 'negative')", 2), "queries with a positive": ("count(DISTINCT query) FILTER (WHERE ok AND relation = 'positive')", 10)}


def _pool(spark, sf_dir):
    """A review pool with rows that break each of the rules."""
    key = F.col("c_custkey")
    nation = F.col("c_nationkey") % 5
    return table(spark, sf_dir, "customer").select(
        F.when(key % 97 == 0, "egfr ").otherwise(F.concat(F.lit("brand-"), (key % 10 + 1).cast("string"))).alias("query"),
        F.when(key % 53 == 0, "ACH-12").otherwise(F.concat(F.lit("ach-"), F.lpad((key % 1000).cast("string"), 6, "0"))).alias("DepMap_ID"),
        F.when(nation == 0, "Positive").when(nation == 1, "negative ").when(nation == 2, "unknown").otherwise("positive").alias("relation"),
        F.when(F.col("c_acctbal") > 0, "Yes").otherwise("no").alias("verified"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Weight_Tuning").when(F.col("c_mktsegment") == "MACHINERY", " weight_tuning").otherwise("holdout").alias("benchmark_role"),
        F.when(key % 11 == 0, "").otherwise(F.col("c_name")).alias("source_url"),
    )


@register(
    "development_violations",
    f"""WITH {_POOL}, twice AS (SELECT key FROM dev GROUP BY key HAVING count(*) > 1), totals AS ({" UNION ALL ".join(f"SELECT '{k}' AS rule, {a} AS seen, {n} AS expected FROM dev" for k, (a, n) in _TOTALS.items())})
    {" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {b}) AS n, min(key) FILTER (WHERE {b}) AS example FROM dev" for k, b in _BROKEN.items())}
    UNION ALL SELECT 'repeated key', count(*), min(key) FROM twice
    UNION ALL SELECT rule, (seen <> expected)::BIGINT, CASE WHEN seen <> expected THEN seen || ' not ' || expected END FROM totals
    UNION ALL SELECT 'unknown key', count(*), min(id) FROM dev WHERE id NOT IN (SELECT {_ID} FROM customer)""",
)
def development_violations(spark, sf_dir):
    rows = materialised(development_rows(_pool(spark, sf_dir)))
    return reports(development_report(rows, 50, 10, 48, 2), all_known(rows, star.spine(spark, sf_dir)))


@register("development_labels", f"WITH {_POOL} SELECT query, id AS DepMap_ID, relation FROM dev WHERE ok")
def development_labels(spark, sf_dir):
    return development_set(development_rows(_pool(spark, sf_dir)))


@register("judgement_counts", f"WITH {_POOL} SELECT benchmark_role, lower(trim(relation)) AS judgement, count(*) AS n, count(*) FILTER (WHERE lower(trim(verified)) = 'yes') AS n_verified FROM pool GROUP BY 1, 2")
def judgement_counts(spark, sf_dir):
    return judgements(_pool(spark, sf_dir).withColumnRenamed("relation", "judgement"), ["benchmark_role"])


_ASKED = """asked AS (SELECT 'Q' || (s_suppkey % 40) AS query_id, upper('brand-' || s_nationkey) AS target, 'BRAND-' || (s_suppkey % 25) AS excluded, CASE WHEN s_suppkey % 7 = 0 THEN 'PROTEIN_ONLY' ELSE 'GENE_MULTIOMICS' END AS mode,
        CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS candidates, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS observed FROM supplier)"""
_ASKED_BROKEN = {"target is excluded": "target = excluded", "mode": "mode <> 'GENE_MULTIOMICS'", "candidates": "coalesce(candidates < 10, TRUE)", "observed": "observed IS NULL"}


@register(
    "query_table_violations",
    f"""WITH {_ASKED}, twice AS (SELECT query_id FROM asked GROUP BY query_id HAVING count(*) > 1)
    {" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {b}) AS n, min(query_id) FILTER (WHERE {b}) AS example FROM asked" for k, b in _ASKED_BROKEN.items())} UNION ALL SELECT 'repeated key', count(*), min(query_id) FROM twice""",
)
def query_table_violations(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(" Q"), (key % 40).cast("string")).alias("query_id"),
        F.concat(F.lit("brand-"), nation.cast("string")).alias("target_gene"),
        F.concat(F.lit("BRAND-"), (key % 25).cast("string")).alias("exclusion_gene"),
        F.lit("all").alias("disease"),
        F.when(key % 7 == 0, "PROTEIN_ONLY").otherwise("GENE_MULTIOMICS ").alias("query_mode"),
        F.when(key % 5 == 0, "x").otherwise(key.cast("string")).alias("expected_candidates"),
        F.when(nation == 3, "").otherwise(nation.cast("string")).alias("expected_exclusion_observed"),
    )
    return query_report(query_table(rows))


# Tables whose digests are compared, and their columns with types.
DIGESTED = {
    "customer": {"c_custkey": "bigint", "c_mktsegment": "string", "c_name": "string"},
    "orders": {"o_custkey": "bigint", "o_orderkey": "bigint", "o_orderstatus": "string"},
    "documents": {"doc_id": "bigint", "lang": "string", "source": "string", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}
_HASH = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, {DIGITS + 1}), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::BIGINT)), lambda a, b: a * 16 + b)"


def _digest_sql(name: str, columns: dict[str, str]) -> str:
    text = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    shape = ",".join(f"{c} {t}" for c, t in columns.items())
    return f"""SELECT '{name}' AS name, count(*) AS n, sha256('{shape}|' || count(*) || '|' || coalesce(sum(v), 0) || '|' || coalesce(bit_xor(v), 0)) AS digest FROM (SELECT {_HASH} AS v FROM (SELECT sha256({text}) AS h FROM {name}))"""


@register("table_digests", " UNION ALL ".join(_digest_sql(n, c) for n, c in DIGESTED.items()))
def table_digests(spark, sf_dir):
    one = lambda name, columns: table_digest(table(spark, sf_dir, name).select(*(F.col(c).cast(t) for c, t in columns.items()))).select(F.lit(name).alias("name"), "n", "digest")
    return reports(*(one(n, c) for n, c in DIGESTED.items()))


_COMPLETE = "((depmap_rna_v IS NOT NULL OR hpa_rna_v IS NOT NULL OR geo_rna_v IS NOT NULL)::INT + (ccle_gygi_protein_v IS NOT NULL)::INT + (depmap_mutation_v IS NOT NULL OR depmap_mutation_highimpact_v IS NOT NULL)::INT + (depmap_fusion_v IS NOT NULL OR depmap_fusion_confidence_v IS NOT NULL)::INT) / 4.0"


@register(
    "wide_master",
    f"""WITH {wide("BRAND-13", "BRAND-7", "BRAND-1")}
    SELECT id AS DepMap_ID, feature AS gene_symbol, {r4("depmap_rna_v")} AS depmap_rna__raw, ccle_gygi_protein_v IS NOT NULL AS has_protein, {_COMPLETE} AS data_completeness, 1.0::DOUBLE AS level, '1' AS note FROM wide WHERE feature = 'BRAND-13'
    UNION ALL BY NAME SELECT id AS DepMap_ID, feature AS gene_symbol, {r4("ccle_gygi_protein_v")} AS ccle_gygi_protein__raw, ccle_gygi_protein_v IS NOT NULL AS has_protein, 2.5::DOUBLE AS level, 'x' AS note FROM wide WHERE feature = 'BRAND-7'
    UNION ALL BY NAME SELECT id AS DepMap_ID, feature AS gene_symbol, {r4("hpa_rna_v")} AS hpa_rna__raw, {_COMPLETE} AS data_completeness, 7.0::DOUBLE AS level FROM wide WHERE feature = 'BRAND-1'""",
)
def wide_master(spark, sf_dir):
    """Wide tables of three features, each without columns that another has, as one."""
    rows = materialised(store(spark, sf_dir).wide("BRAND-13", "BRAND-7", "BRAND-1"))
    of = lambda feature, raw, *more: rows.where(F.col("gene_symbol") == feature).select("DepMap_ID", *more, "gene_symbol", rounded(F.col(raw)).alias(raw))
    first = of("BRAND-13", "depmap_rna__raw", "has_protein", "data_completeness").withColumns({"level": F.lit(1), "note": F.lit(1)})
    second = of("BRAND-7", "ccle_gygi_protein__raw", "has_protein").withColumns({"level": F.lit(2.5), "note": F.lit("x")})
    third = of("BRAND-1", "hpa_rna__raw", "data_completeness").withColumn("level", F.lit(7).cast("bigint"))
    return stacked([first, second, third])


_PANEL = "panel AS (SELECT * FROM (VALUES ('BRAND-13'), ('BRAND-7'), ('BRAND-99')) t(feature)), mine AS (SELECT l.*, substr(id, 10, 1) <> '0' AS known FROM long l WHERE feature IN (SELECT feature FROM panel))"


def _panel(spark, sf_dir):
    panel = spark.createDataFrame([("BRAND-13",), ("brand-7 ",), ("BRAND-99",)], "gene_symbol string")
    return panel_rows(star.raw_long(spark, sf_dir), panel, star.spine(spark, sf_dir).where("substring(DepMap_ID, 10, 1) <> '0'"))


@register(
    "panel_audit",
    f"""WITH {LONG}, {_PANEL} SELECT count(*) AS rows_before, count(*) FILTER (WHERE known) AS rows_after, count(DISTINCT id) AS ids_before, count(DISTINCT id) FILTER (WHERE NOT known) AS unmatched_ids, count(*) FILTER (WHERE NOT known) AS rows_removed,
        (SELECT count(*) FROM panel WHERE feature NOT IN (SELECT feature FROM mine WHERE known)) AS n_missing, (SELECT min(feature) FROM panel WHERE feature NOT IN (SELECT feature FROM mine WHERE known)) AS missing FROM mine""",
)
def panel_audit(spark, sf_dir):
    return _panel(spark, sf_dir)[1]


@register("panel_coverage", f"WITH {LONG}, {_PANEL} SELECT feature AS gene_symbol, src AS source, count(*) AS n, count(DISTINCT id) AS n_entities FROM mine WHERE known GROUP BY ALL")
def panel_coverage(spark, sf_dir):
    return _panel(spark, sf_dir)[0].groupBy("gene_symbol", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("DepMap_ID").alias("n_entities"))


@register(
    "annotations_prepared",
    f"""WITH a AS (SELECT {_ID} AS DepMap_ID, c_name, r_name AS lineage, o_orderpriority AS priority, o_orderkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey)
    SELECT DISTINCT ON (DepMap_ID) DepMap_ID, c_name AS stripped_cell_line_name, lineage, NULL::VARCHAR AS primary_disease, priority, k FROM a ORDER BY DepMap_ID, priority NULLS FIRST, k NULLS FIRST""",
)
def annotations_prepared(spark, sf_dir):
    """Entities with a row for each of their orders: the first by priority and key stays; no row has a short name."""
    orders = table(spark, sf_dir, "orders").select(star.entity_id(F.col("o_custkey")).alias("DepMap_ID"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("k"))
    rows = star.annotations(spark, sf_dir).drop("primary_disease").join(orders, "DepMap_ID", "left").withColumn("stripped_cell_line_name", F.lit(None).cast("string"))
    return prepared_annotations(rows, ["priority", "k"]).select("DepMap_ID", "stripped_cell_line_name", "lineage", "primary_disease", "priority", "k")


@register(
    "rekeyed_matrix",
    """WITH m AS (SELECT p_brand AS row, c_nationkey AS k, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    cells AS (SELECT b.row, n_nationkey, value FROM (SELECT DISTINCT p_brand AS row FROM lineitem JOIN part ON l_partkey = p_partkey) b CROSS JOIN nation LEFT JOIN m ON m.row = b.row AND m.k = n_nationkey)
    SELECT row, 'ACH-' || n_nationkey AS id, value FROM cells WHERE n_nationkey % 4 <> 0 UNION ALL SELECT NULL, n_name, NULL FROM nation WHERE n_nationkey % 4 = 0""",
)
def rekeyed_matrix(spark, sf_dir):
    """A matrix file of brands by nations, its columns re-keyed; nations without an id are reported as rows without a brand."""
    line, part, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer", "nation"))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    rows = rows.join(F.broadcast(nation), rows.c_nationkey == nation.n_nationkey)
    names = [r["n_name"] for r in nation.orderBy("n_nationkey").collect()]
    path = scratch_folder(spark, "matrix")
    rows.groupBy("p_brand").pivot("n_name", names).agg(F.sum("l_quantity").cast("double")).coalesce(1).write.option("header", True).csv(path)
    known = nation.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name"), F.concat(F.lit("ACH-"), F.col("n_nationkey").cast("string")).alias("id"))
    long, unmatched = read_matrix_of(spark, path, known)
    return long.unionByName(unmatched.select(F.lit(None).cast("string").alias("row"), F.col("name").alias("id"), F.lit(None).cast("double").alias("value")))
