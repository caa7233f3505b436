"""Grounding over texts, cards and claims of a ranking, and token frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.contexts import context_aliases
from rankloom.functions.scalar import rounded
from rankloom.operators.explain import cards, numbers_in, scripted_claims, supported, verify
from rankloom.queries.base import r4, registry, scored, store
from rankloom.queries.ranking import CONTEXT, EXCLUDED, GENE
from rankloom.session import table

QUERIES, ORACLE_SQL, register = registry()


# Without look-behind: a sign between a letter and a digit, or else the digit right after a letter, starts no number and goes.
_NUMBERS = r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([A-Za-z])[-+]([0-9])', '\1 \2', 'g'), '([A-Za-z])[0-9]', '\1 ', 'g') AS text FROM documents),
    v AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[-+]?[0-9]+(?:\.[0-9]+)?'), lambda x: x::DOUBLE) AS xs FROM t)
    SELECT doc_id, len(xs)::INT AS n, list_max(xs) AS most FROM v"""


@register("numbers_in_texts", _NUMBERS)
@register("numbers_in_all_texts", _NUMBERS)
def numbers_in_texts(spark, sf_dir):
    """Numbers of all texts; a null text has none."""
    n = F.coalesce(numbers_in(F.col("text")), F.array().cast("array<double>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(n).alias("n"), F.array_max(n).alias("most"))


@register(
    "supported_measurements",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE abs(l_quantity - round(l_quantity)) <= greatest(1e-4, abs(round(l_quantity)) * 1e-3) OR abs(l_quantity - l_discount) <= greatest(1e-4, abs(l_discount) * 1e-3)) AS n_supported FROM lineitem GROUP BY ALL",
)
def supported_measurements(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ok = supported(F.col("l_quantity"), F.array(F.round("l_quantity"), F.col("l_discount")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_supported"))


def _top(spark, sf_dir):
    return store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT).where("rank <= 10")


_TARGET = f"gene {GENE}"
_CARDS = f"""WITH {scored(GENE, None, EXCLUDED, context_aliases(CONTEXT))}, t AS (SELECT * FROM ranked WHERE rank <= 10)"""


@register(
    "ranking_cards",
    f"""{_CARDS} SELECT rank AS position, 'The deterministic recommender ranks ' || name || ' (' || id || ') at position ' || rank || ' for {_TARGET}, with final score ' || printf('%.4f', finalScore)
        || ', confidence score ' || printf('%.4f', confidenceScore) || ', and recommendation level ' || recommendationLevel || '.' AS text, 3 AS n_values FROM t""",
)
def ranking_cards(spark, sf_dir):
    c = cards(_top(spark, sf_dir), "GENE_MULTIOMICS", GENE, None).where("card_type = 'RANKING'")
    return c.select(F.col("position").cast("long").alias("position"), "text", F.size("values").alias("n_values"))


_FLAGS = ["depmap_rna", "hpa_rna", "geo_rna"]


@register(
    "claims_by_type",
    f"""{_CARDS}, one AS (SELECT * FROM t WHERE rank = 1)
    SELECT 'SUPPORT' AS claim_type, 2 + least(3, {" + ".join(f"({f}_v IS NOT NULL)::INT" for f in _FLAGS)} + (prot_v IS NOT NULL)::INT + mutated::INT + fused_::INT + (fused_ AND depmap_fusion_confidence_v IS NOT NULL)::INT)::BIGINT AS n, TRUE AS all_ok FROM one
    UNION ALL SELECT 'LIMITATION', ({" + ".join(f"({f}_z IS NULL)::INT" for f in _FLAGS)} + (prot IS NULL)::INT)::BIGINT, prot IS NOT NULL FROM one WHERE ({" + ".join(f"({f}_z IS NULL)::INT" for f in _FLAGS)} + (prot IS NULL)::INT) > 0
    UNION ALL SELECT 'ALTERNATIVE', least(3, (SELECT count(*) FROM t) - 1)::BIGINT, TRUE FROM one WHERE (SELECT count(*) FROM t) > 1""",
)
def claims_by_type(spark, sf_dir):
    """Claims that the scripted writer makes of a ranking, and whether the cited cards bear them out.

    The gap card of a missing protein names the feature, whose digits no card carries, so that claim fails.
    """
    c = cards(_top(spark, sf_dir), "GENE_MULTIOMICS", GENE, None)
    checked = verify(scripted_claims(c), c, "full")
    return checked.groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"), F.min("ok").alias("all_ok"))


@register(
    "resource_frequency",
    "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url, '[a-z]+')) AS token FROM pages) GROUP BY token ORDER BY n DESC, token LIMIT 20",
)
def resource_frequency(spark, sf_dir):
    """The most frequent words of cross-references, here of page addresses."""
    p = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("url", F.lit("[a-z]+"), 0)).alias("token"))
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


@register("score_tie_diagnostics", f"{_CARDS}, g AS (SELECT confidenceScore, count(*) AS c FROM ranked GROUP BY 1) SELECT max(c) AS largest_tie, {r4('sum(c) FILTER (WHERE c > 1)::DOUBLE / sum(c)')} AS tied_fraction, count(*) AS n_values FROM g")
def score_tie_diagnostics(spark, sf_dir):
    rows = store(spark, sf_dir).rank(GENE, None, EXCLUDED, CONTEXT)
    g = rows.groupBy("confidenceScore").agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.max("c").alias("largest_tie"), rounded(F.sum(F.when(F.col("c") > 1, F.col("c"))) / F.sum("c")).alias("tied_fraction"), F.count(F.lit(1)).alias("n_values"))
