"""Candidate pools, review queues, label checks and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalar import blinded_key, is_true, review_id, rounded, upper_key
from rankloom.sources.resolve import duplicated

RELATIONS = ("positive", "negative", "unknown")


def candidate_pool(ranked: DataFrame, labels: DataFrame, k: int, configs: list[str]) -> DataFrame:
    """Entities that are among the k best (ties kept) of some configuration, or labelled: least rank, score range,
    the configurations that chose them, and rank by configuration. ranked: config, query, DepMap_ID, finalScore, rank, rankMin."""
    keys = ["query", "DepMap_ID"]
    chosen = ranked.where(F.col("rankMin") <= k).select(*keys).union(labels.select(*keys)).distinct()
    mine = ranked.join(chosen, keys, "left_semi")
    top = F.col("rankMin") <= k
    sums = mine.groupBy(*keys).agg(
        F.min("rankMin").alias("min_rank"),
        F.min("finalScore").alias("min_score"),
        F.max("finalScore").alias("max_score"),
        F.array_join(F.sort_array(F.collect_set(F.when(top, F.col("config")))), ";").alias("configs"),
        *(F.max(F.when(F.col("config") == c, F.col("rankMin"))).alias(f"rank_{c}") for c in configs),
    )
    return sums.join(labels.select(*keys, "relation"), keys, "left")


def blinded(pool: DataFrame, seed: int) -> DataFrame:
    """A review sheet: stable review ids in an order that tells nothing of ranks or scores."""
    sheet = pool.select(review_id(F.col("query"), F.col("DepMap_ID")).alias("review_id"), "query", "DepMap_ID", blinded_key(seed, F.col("query"), F.col("DepMap_ID")).alias("key"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("key"))
    return sheet.withColumn("position", nth.cast("long")).drop("key")


def assert_blinded(sheet: DataFrame) -> None:
    """Refuses sheets that leak configurations, ranks or scores, and repeated pairs."""
    leaks = [c for c in sheet.columns if any(w in c.lower() for w in ("rank", "score", "config"))]
    if leaks:
        raise ValueError(f"a review sheet must not tell {', '.join(leaks)}")
    if not duplicated(sheet, "query", "DepMap_ID").isEmpty():
        raise ValueError("repeated pairs in a review sheet")


def disagreements(ranked: DataFrame, a: str, b: str, k: int, verified: DataFrame) -> DataFrame:
    """Entities among the k best of just one of two configurations that aren't verified yet, with both ranks."""
    keys = ["query", "DepMap_ID"]
    side = lambda c, s: ranked.where(F.col("config") == c).select(*keys, F.col("rankMin").alias(f"rank_{s}"), F.col("finalScore").alias(f"score_{s}"))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    in_a, in_b = (F.coalesce(F.col(f"rank_{s}") <= k, F.lit(False)) for s in "ab")
    return both.where(in_a != in_b).withColumn("only_in", F.when(in_a, "a").otherwise("b")).join(verified.select(*keys), keys, "left_anti")


def check_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """One row of counts: rows, verified rows, bad relations, bad ids, unknown entities, repeated and conflicting pairs."""
    rows = labels.select("query", upper_key(F.col("DepMap_ID")).alias("DepMap_ID"), F.lower(F.trim("relation")).alias("relation"), is_true(F.col("verified")).alias("ok"))
    there = known.select(F.col("DepMap_ID").alias("__known")).distinct()
    rows = rows.join(there, rows["DepMap_ID"] == there["__known"], "left")
    one = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("ok").alias("n_verified"),
        F.count_if(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))).alias("n_bad_relation"),
        F.count_if(~F.coalesce(F.col("DepMap_ID").rlike(r"^ACH-\d{6}$"), F.lit(False))).alias("n_bad_id"),
        F.count_if(F.col("__known").isNull()).alias("n_unknown"),
    )
    pairs = rows.groupBy("query", "DepMap_ID").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("d"))
    return one.crossJoin(pairs.agg(F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("d") > 1).alias("n_conflicting")))


def known_rows(rows: DataFrame, known: DataFrame, by: str = "DepMap_ID") -> tuple[DataFrame, DataFrame]:
    """The rows of known entities, and one row that tells what was removed: n_rows, n_kept, n_removed, n_entities_removed, first_removed.

    Ids are compared trimmed and in upper case; rows without an id are removed, and are no entity.
    """
    there = known.select(upper_key(F.col(by)).alias("__known")).distinct()
    joined = rows.withColumn("__id", F.nullif(upper_key(F.col(by)), F.lit(""))).join(there, F.col("__id") == F.col("__known"), "left")
    ids = joined.groupBy("__id", F.col("__known").isNotNull().alias("ok")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    audit = ids.agg(
        total(F.col("n"))("n_rows"), total(F.when(F.col("ok"), F.col("n")))("n_kept"), total(F.when(~F.col("ok"), F.col("n")))("n_removed"),
        F.count_if(~F.col("ok") & F.col("__id").isNotNull()).alias("n_entities_removed"), F.min(F.when(~F.col("ok"), F.col("__id"))).alias("first_removed"),
    )
    return joined.where(F.col("__known").isNotNull()).drop("__id", "__known"), audit


def export_verified(labels: DataFrame) -> DataFrame:
    """Verified positive and negative labels with well-formed ids, keys normalised."""
    rows = labels.where(is_true(F.col("verified"))).select(upper_key(F.col("query")).alias("query"), upper_key(F.col("DepMap_ID")).alias("DepMap_ID"), F.lower(F.trim("relation")).alias("relation"))
    return rows.where(F.col("relation").isin("positive", "negative") & F.col("DepMap_ID").rlike(r"^ACH-\d{6}$"))


def detectability(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Where labelled entities stand in their feature's profile (query, DepMap_ID, value): rank, percentile position,
    and whether the label fits: positives want the top half and at best the top 25 %, negatives the reverse."""
    by = Window.partitionBy("query")
    ranked = profiles.where("value is not null").withColumns({"rank": F.row_number().over(by.orderBy(F.desc("value"), "DepMap_ID")).cast("long"), "n": F.count(F.lit(1)).over(by)})
    ranked = ranked.withColumn("position", rounded(100.0 * (1.0 - (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))))
    joined = labels.join(ranked, ["query", "DepMap_ID"], "left")
    good = F.when(F.col("relation") == "positive", F.col("position")).otherwise(100.0 - F.col("position"))
    verdict = F.when(good.isNull(), "NOT_MEASURED").when(good >= 75, "OK").when(good >= 50, "WEAK").otherwise("CONTRADICTED")
    return joined.select("query", "DepMap_ID", "relation", "rank", "position", verdict.alias("verdict"))


def stability(detail: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """Ranks of configurations under two label sets (version, config, metric), and how they moved."""
    means = detail.groupBy("version", "config").agg(F.avg(metric).alias("m")).withColumn("rank", F.rank().over(Window.partitionBy("version").orderBy(F.desc("m"))).cast("long"))
    side = lambda v, s: means.where(F.col("version") == v).select("config", F.col("m").alias(f"m_{s}"), F.col("rank").alias(f"rank_{s}"))
    return side(a, "a").join(side(b, "b"), "config").select("config", "rank_a", "rank_b", (F.col("rank_b") - F.col("rank_a")).alias("moved"), rounded(F.col("m_b") - F.col("m_a"), 6).alias("change"))
