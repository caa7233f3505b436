"""Identifier resolution, header parsing, event sources and scalar expressions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import scalar as S
from rankloom.queries.base import r4, registry
from rankloom.session import table
from rankloom.sources import star
from rankloom.sources.adapters import default_signatures, fusions_of
from rankloom.sources.resolve import entity_map, last_per_key, name_map, resolve_accessions, resolve_names, resolve_samples, symbol_maps

QUERIES, ORACLE_SQL, register = registry()


def _registry(spark, sf_dir):
    """Customers as a registry: accessions, names, synonyms (shared by neighbours, so the first must win) and cross-references."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("nth"),
        F.concat(F.lit("CVCL_"), star.padded(key, 5)).alias("accession"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("cust-"), key.cast("string"), F.lit("||Group "), F.expr("c_custkey div 3").cast("string"), F.lit("; pair_"), F.expr("c_custkey div 2").cast("string")).alias("synonyms"),
        F.when(key % 3 == 0, F.concat(F.lit("CCLE; DepMap="), star.entity_id(key), F.lit("; Wikidata"))).otherwise(F.lit("CCLE")).alias("xrefs"),
    )


def _entities(spark, sf_dir):
    r = _registry(spark, sf_dir)
    primary = r.select("nth", "accession", S.entity_xref(F.col("xrefs")).alias("entity"))
    # The entity table knows all but every fifth, under an id that is one higher: the registry's own must win.
    own = r.where("nth % 5 <> 0").select("nth", "accession", star.entity_id(F.col("nth") + 1).alias("entity"))
    return entity_map(primary, own)


_PAD = lambda x: f"lpad(({x})::VARCHAR, greatest(length(({x})::VARCHAR), 5)::INT, '0')"
_REG = f"""reg AS (SELECT c_custkey AS nth, 'CVCL_' || {_PAD("c_custkey")} AS acc, c_name AS name,
                [c_name, 'cust-' || c_custkey, 'Group ' || (c_custkey // 3), ' pair_' || (c_custkey // 2)] AS names FROM customer),
    nm0 AS (SELECT nth, acc, unnest(names) AS n, unnest([0, 1, 2, 3]) AS place FROM reg),
    nm AS (SELECT k, arg_min(acc, nth * 10 + place) AS acc FROM (SELECT *, regexp_replace(upper(n), '[^A-Z0-9]', '', 'g') AS k FROM nm0) WHERE k <> '' GROUP BY k),
    both_ AS (SELECT acc, 0 AS p, nth, 'ACH-' || lpad(nth::VARCHAR, 6, '0') AS e FROM reg WHERE nth % 3 = 0
              UNION ALL SELECT acc, 1, nth, 'ACH-' || lpad((nth + 1)::VARCHAR, 6, '0') FROM reg WHERE nth % 5 <> 0),
    ent AS (SELECT DISTINCT ON (acc) acc, e FROM both_ ORDER BY acc, p, nth)"""


@register(
    "resolve_names",
    f"""WITH {_REG}, asked AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'customer ' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'CUST_' || o_custkey WHEN 2 THEN 'group-' || (o_custkey // 3) WHEN 3 THEN 'ACH-' || lpad(o_custkey::VARCHAR, 6, '0') ELSE 'nobody ' || o_custkey END AS n FROM orders),
    r AS (SELECT a.k, CASE WHEN starts_with(n, 'ACH-') THEN n ELSE e END AS e FROM asked a LEFT JOIN nm ON nm.k = regexp_replace(upper(n), '[^A-Z0-9]', '', 'g') LEFT JOIN ent ON ent.acc = nm.acc)
    SELECT k AS order_key, e AS entity FROM r""",
)
def resolve_order_names(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    spelled = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("customer "), F.lpad(key, 9, "0")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("CUST_"), key))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("group-"), F.expr("o_custkey div 3").cast("string")))
        .when(F.col("o_orderkey") % 5 == 3, star.entity_id(F.col("o_custkey")))
        .otherwise(F.concat(F.lit("nobody "), key))
    )
    asked = o.select(F.col("o_orderkey").alias("order_key"), spelled.alias("n"))
    return resolve_names(asked, "n", name_map(_registry(spark, sf_dir)), _entities(spark, sf_dir)).select("order_key", "entity")


@register(
    "resolve_samples",
    f"""WITH {_REG}, s AS (SELECT event_id AS nth, user_id AS sample, CASE WHEN event_id % 2 = 0 THEN 'CVCL_' || lpad(user_id::VARCHAR, 5, '0') ELSE 'none' END AS acc, 'cust ' || user_id AS title FROM events),
    f AS (SELECT sample, arg_min(acc, nth) AS acc, arg_min(title, nth) AS title FROM s GROUP BY sample),
    r AS (SELECT sample, coalesce(e1.e, e2.e) AS entity FROM f LEFT JOIN ent e1 ON e1.acc = f.acc LEFT JOIN nm ON nm.k = regexp_replace(upper(title), '[^A-Z0-9]', '', 'g') LEFT JOIN ent e2 ON e2.acc = nm.acc)
    SELECT * FROM r WHERE entity IS NOT NULL""",
)
def resolve_event_samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    accession = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("CVCL_"), F.lpad(F.col("user_id").cast("string"), 5, "0"))).otherwise(F.lit("none"))
    samples = e.select(F.col("event_id").alias("nth"), F.col("user_id").alias("sample"), accession.alias("accession"), F.concat(F.lit("RNA, Cell line: cust "), F.col("user_id").cast("string")).alias("title"))
    return resolve_samples(samples, name_map(_registry(spark, sf_dir)), _entities(spark, sf_dir))


@register(
    "resolve_accessions",
    f"WITH {_REG}, a AS (SELECT s_suppkey AS k, 'CVCL_' || {_PAD('s_suppkey * 2')} AS acc FROM supplier) SELECT k AS supplier, e AS entity FROM a LEFT JOIN ent USING (acc)",
)
def resolve_supplier_accessions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("supplier"), F.concat(F.lit(" CVCL_"), star.padded(F.col("s_suppkey") * 2, 5)).alias("a"))
    return resolve_accessions(rows, "a", _entities(spark, sf_dir)).select("supplier", "entity")


@register("bridge_last_wins", "SELECT o_custkey % 500 AS profile, arg_max(o_custkey, o_orderkey) AS entity FROM orders GROUP BY 1")
def bridge_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("profile"), F.col("o_custkey").alias("entity"), "o_orderkey")
    return last_per_key(o, "profile", "entity", F.col("o_orderkey"))


@register(
    "symbol_maps",
    """WITH p AS (SELECT p_partkey AS nth, 'ENSG' || lpad((p_partkey % 97)::VARCHAR, 6, '0') AS e, upper(trim(p_brand)) AS s FROM part)
    SELECT 'to_symbol' AS direction, e AS key, arg_min(s, nth) AS value FROM p GROUP BY e UNION ALL SELECT 'to_ensembl', s, arg_min(e, nth) FROM p GROUP BY s""",
)
def symbol_maps_of_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ensembl = F.concat(F.lit("ENSG"), F.lpad((F.col("p_partkey") % 97).cast("string"), 6, "0"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    forward, back = symbol_maps(p.select(F.col("p_partkey").alias("nth"), ensembl.alias("ensembl"), F.col("p_brand").alias("symbol")))
    named = lambda df, direction, k, v: df.select(F.lit(direction).alias("direction"), F.col(k).alias("key"), F.col(v).alias("value"))
    return named(forward, "to_symbol", "ensembl", "symbol").unionByName(named(back, "to_ensembl", "symbol", "ensembl"))


@register(
    "header_parsing",
    """SELECT p_partkey, p_brand AS symbol, 'ENSG' || lpad(p_partkey::VARCHAR, 8, '0') AS ensembl, p_type AS protein_symbol, 'ENSG' || lpad(p_partkey::VARCHAR, 8, '0') AS base,
              CASE WHEN p_partkey % 3 = 0 THEN 'CVCL_' || p_partkey END AS accession, 'line ' || p_partkey AS title, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name_key FROM part""",
)
def header_parsing(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    ensg = F.concat(F.lit("ENSG"), F.lpad(key, 8, "0"))
    header, protein = F.concat(F.col("p_brand"), F.lit(" ("), ensg, F.lit(".3)")), F.concat(F.lit("P"), key, F.lit(" ("), F.col("p_type"), F.lit(")"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("RRID:CVCL_"), key)).otherwise("none")
    return p.select(
        "p_partkey",
        S.symbol_of_header(header).alias("symbol"),
        S.ensembl_of_header(header).alias("ensembl"),
        S.symbol_in_parens(protein).alias("protein_symbol"),
        S.ensembl_base(F.concat(ensg, F.lit(".12"))).alias("base"),
        S.registry_id(text).alias("accession"),
        S.without_cell_line_prefix(F.concat(F.lit("human Cell Line = line "), key)).alias("title"),
        S.lower_alnum(F.col("p_name")).alias("name_key"),
    )


@register(
    "event_source_counts",
    """SELECT 'ACH-' || lpad(user_id::VARCHAR, 6, '0') AS DepMap_ID, event_type, count(*) AS n, floor(max(value) * 1e4 + 0.5) / 1e4 AS most, max((props::JSON->>'k')::BIGINT) AS top_k,
              bool_or(lower(event_type) IN ('true', '1', 'yes', 'high') OR value > 40) AS high FROM events GROUP BY ALL""",
)
def event_source_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    high = S.is_truthy(F.col("event_type")) | (F.col("value") > 40)
    return e.groupBy(star.entity_id(F.col("user_id")).alias("DepMap_ID"), "event_type").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.max("value")).alias("most"), F.max("k").alias("top_k"), F.max(high).alias("high"))


@register(
    "default_signatures",
    f"""WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
    d AS (SELECT user_id, value FROM s WHERE n = 1), q AS (SELECT quantile_cont(value, 0.9) AS q FROM d)
    SELECT user_id AS entity, {r4("value")} AS cin, value > q AS high_cin FROM d, q""",
)
def default_signatures_of_events(spark, sf_dir):
    """The first default entry of each user, and whether it lies above the 90 % quantile."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("nth"), F.when(F.col("event_type") == "click", "Yes").otherwise("No").alias("is_default"), F.col("value").alias("cin"))
    d = default_signatures(e)
    return d.crossJoin(d.agg(F.percentile("cin", F.lit(0.9)).alias("q"))).select("entity", S.rounded(F.col("cin")).alias("cin"), (F.col("cin") > F.col("q")).alias("high_cin"))


@register(
    "fusions_of_a_feature",
    """WITH f AS (SELECT l_orderkey, l_linenumber, p.p_brand || '--' || o.p_brand AS name FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN part o ON o.p_partkey = (l_partkey * 7 + 1) % (SELECT count(*) FROM part) WHERE l_linestatus = 'F' AND l_returnflag = 'R')
    SELECT name, count(*) AS n FROM f WHERE list_contains(string_split(name, '--'), 'Brand#7') GROUP BY name""",
)
def fusions_of_a_feature(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = p.count()
    line = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_returnflag = 'R'")
    left, right = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("a")), p.select(F.col("p_partkey").alias("o"), F.col("p_brand").alias("b"))
    f = line.join(left, "l_partkey").withColumn("o", (F.col("l_partkey") * 7 + 1) % n).join(right, "o").select(F.concat("a", F.lit("--"), "b").alias("name"))
    return fusions_of(f, "name", "BRAND#7").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "scalar_expressions",
    f"""WITH x AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_totalprice % 1000) / 1000 END AS r FROM orders)
    SELECT o_orderkey, CASE WHEN r >= 0.8 THEN 'High' WHEN r >= 0.65 THEN 'Medium-High' WHEN r >= 0.5 THEN 'Medium' WHEN r >= 0.35 THEN 'Medium-Low' ELSE 'Low' END AS level,
           {r4("CASE WHEN r IS NULL THEN 0.6 WHEN r >= 0.5 THEN 1.0 WHEN r < 0.25 THEN 0.3 ELSE 0.3 + (r - 0.25) / 0.25 * 0.7 END")} AS trust, {r4("CASE WHEN r IS NOT NULL THEN log2(r + 1) END")} AS logged,
           coalesce(try_cast(replace(o_orderpriority, '-', ' ') AS DOUBLE), coalesce(r, -1.0)) >= 0 AS measured,
           'V5-' || upper(substr(sha256(o_orderpriority || '|' || o_orderkey), 1, 12)) AS review_id, regexp_replace(upper(o_orderpriority), '[^A-Z0-9]', '', 'g') AS upper_key,
           trim(regexp_replace(translate(lower(o_orderpriority), '-_/', '   '), '\\s+', ' ', 'g')) AS context, lower(o_orderstatus) IN ('true', '1', 'yes', 'y', 't') AS flag FROM x""",
)
def scalar_expressions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("r", F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_totalprice") % 1000) / 1000))
    return o.select(
        "o_orderkey",
        S.confidence_level(F.col("r")).alias("level"),
        S.rounded(S.rna_trust(F.col("r"))).alias("trust"),
        S.rounded(S.log2_plus_one(F.col("r"))).alias("logged"),
        (F.coalesce(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")).try_cast("double"), S.safe_double(F.col("r"), -1.0)) >= 0).alias("measured"),
        S.review_id(F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("review_id"),
        S.upper_alnum(F.col("o_orderpriority")).alias("upper_key"),
        S.normal_context(F.col("o_orderpriority")).alias("context"),
        S.is_true(F.col("o_orderstatus")).alias("flag"),
    )
