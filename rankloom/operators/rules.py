"""Rules that tables of labels, queries and panels must keep, checked in one pass; tables that break them are refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.headers import require_columns
from rankloom.functions.scalar import is_true, upper_key

RELATIONS = ("positive", "negative")
#: The well-known features that a development set may not have, its role, and the mode of frozen queries.
CLASSIC = ("EGFR", "KRAS", "ERBB2", "MYC", "TP53")
DEVELOPMENT = "weight_tuning"
FROZEN_MODE = "GENE_MULTIOMICS"


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column], repeated: str = "repeated key", totals: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """rule, n and example, for every rule: how many rows break it (keys, for repeated ones), and the least key that does.

    ``rules`` are true for rows that keep them; null breaks them. Rows are counted by key and rule before they are shuffled. ``totals``
    (an aggregate of all rows and what it must be) are broken once or not at all, with what was found as the example.
    """
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    names = {f"__r{i}": (name, rule) for i, (name, rule) in enumerate(rules.items())}
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(c) for c, (_, rule) in names.items()]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *broken).withColumn("__key", key)
    found = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.min(F.when(F.col(c) > 0, F.col("__key"))).alias("example")) for c, (name, _) in names.items()]
    found.append(F.struct(F.lit(repeated).alias("rule"), F.count_if(F.col("__n") > 1).alias("n"), F.min(F.when(F.col("__n") > 1, F.col("__key"))).alias("example")))
    report = groups.agg(F.array(*found).alias("__found")).select(F.inline("__found"))
    if totals:
        seen = rows.agg(F.array(*(F.struct(F.lit(name).alias("rule"), observed.cast("long").alias("seen"), F.lit(expected).alias("expected")) for name, (observed, expected) in totals.items())).alias("__found")).select(F.inline("__found"))
        wrong = F.coalesce(F.col("seen") != F.col("expected"), F.lit(True))
        report = report.unionByName(seen.select("rule", wrong.cast("long").alias("n"), F.when(wrong, F.concat_ws(" not ", F.coalesce(F.col("seen").cast("string"), F.lit("none")), "expected")).alias("example")))
    return report


def kept_or_refused(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows; running the plan fails, and names the rules broken and an example of each, if the report has any."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("rule", "n", "example")))), lambda x: F.concat_ws(" ", x["rule"], F.concat(F.lit("("), x["n"].cast("string"), F.lit("):")), x["example"])), "; ")
    one = report.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__bad"), text.alias("__text"))
    # One row, joined to all.
    checked = rows.crossJoin(F.broadcast(one)).where(F.when(F.col("__bad") == 0, True).otherwise(F.raise_error(F.col("__text")).cast("boolean")))
    return checked.drop("__bad", "__text")


def save_checked(rows: DataFrame, report: DataFrame, path: str) -> None:
    """The rows as Parquet; nothing is written, and ValueError raised, if a rule is broken. Existing output is refused."""
    bad = [f"{r['rule']} ({r['n']}): {r['example']}" for r in report.where("n > 0").orderBy("rule").collect()]
    if bad:
        raise ValueError("; ".join(bad))
    rows.write.parquet(path)


def development_rows(pool: DataFrame, role: str = DEVELOPMENT) -> DataFrame:
    """Rows of a pool that are meant for development, keys and words normalised: query, DepMap_ID, relation, verified, source_url."""
    require_columns(pool.columns, ["query", "DepMap_ID", "relation", "verified", "benchmark_role", "source_url"])
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    mine = pool.where(text("benchmark_role") == role)
    return mine.select(upper_key(F.coalesce("query", F.lit(""))).alias("query"), upper_key(F.coalesce("DepMap_ID", F.lit(""))).alias("DepMap_ID"), text("relation").alias("relation"), is_true(F.col("verified")).alias("verified"), F.trim("source_url").alias("source_url"))


def development_set(rows: DataFrame) -> DataFrame:
    """Of development rows the verified labels."""
    return rows.where("verified").select("query", "DepMap_ID", "relation")


def development_report(rows: DataFrame, n_rows: int, n_queries: int, n_positive: int, n_negative: int, classic: tuple[str, ...] = CLASSIC) -> DataFrame:
    """What is wrong with development rows: see ``violations``. Unverified rows only may not be of classic features."""
    done = F.col("verified")
    positive = done & (F.col("relation") == "positive")
    rules = {
        "classic feature": ~F.col("query").isin(*classic),
        "relation": ~done | F.col("relation").isin(*RELATIONS),
        "malformed id": ~done | F.col("DepMap_ID").rlike(r"^ACH-\d{6}$"),
        "no source": ~done | (F.coalesce("source_url", F.lit("")) != ""),
        "blank query": ~done | (F.col("query") != ""),
    }
    totals = {
        "rows": (F.count_if(done), n_rows),
        "queries": (F.count_distinct(F.when(done, F.col("query"))), n_queries),
        "positives": (F.count_if(positive), n_positive),
        "negatives": (F.count_if(done & (F.col("relation") == "negative")), n_negative),
        "queries with a positive": (F.count_distinct(F.when(positive, F.col("query"))), n_queries),
    }
    return violations(rows, ["query", "DepMap_ID"], rules, totals=totals)


def query_table(rows: DataFrame) -> DataFrame:
    """A study's queries, normalised, with whole numbers in expected_candidates and expected_exclusion_observed (null where they aren't)."""
    require_columns(rows.columns, ["query_id", "target_gene", "exclusion_gene", "disease", "query_mode", "expected_candidates", "expected_exclusion_observed"])
    text = {c: F.trim(F.col(c).cast("string")) for c in ("query_id", "disease", "query_mode")}
    genes = {c: upper_key(F.col(c)) for c in ("target_gene", "exclusion_gene")}
    numbers = {c: F.col(c).cast("string").try_cast("int") for c in ("expected_candidates", "expected_exclusion_observed")}
    return rows.withColumns({**text, **genes, **numbers})


def query_report(rows: DataFrame, least: int = 10) -> DataFrame:
    """What is wrong with a query table: see ``violations``."""
    rules = {
        "target is excluded": F.col("target_gene") != F.col("exclusion_gene"),
        "mode": F.col("query_mode") == FROZEN_MODE,
        "candidates": F.col("expected_candidates") >= least,
        "observed": F.col("expected_exclusion_observed").isNotNull(),
    }
    return violations(rows, ["query_id"], rules)


def judgements(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Reviews by judgement, and how many of them are verified."""
    word = F.lower(F.trim(F.coalesce("judgement", F.lit("")))).alias("judgement")
    return reviews.groupBy(*by, word).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_true(F.col("verified"))).alias("n_verified"))


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that only one of two tables has, or that have another type; an empty list for equal schemas, in any order."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    return [f"{c}: {left.get(c, 'absent')}, {right.get(c, 'absent')}" for c in sorted(left.keys() | right.keys()) if left.get(c) != right.get(c)]


def all_known(rows: DataFrame, known: DataFrame, key: str = "DepMap_ID") -> DataFrame:
    """rule, n, example for a reference that must be there: rows whose key isn't among the known ones."""
    lost = rows.join(known.select(key).distinct(), key, "left_anti")
    return lost.agg(F.lit("unknown key").alias("rule"), F.count(F.lit(1)).alias("n"), F.min(F.col(key).cast("string")).alias("example"))


def reports(*some: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, some)
