"""Tie-aware ranking metrics, resampling and selection of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.sweeps import leading


def tie_groups(ranked: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """One row for each score of a query: size, n_pos, n_neg, first (position of its first row) and mid (its mid-rank).

    labels: the query's columns shared with ``ranked``, DepMap_ID and relation (positive or negative); not joined where ``ranked`` has
    a relation already.
    """
    keys = [c for c in labels.columns if c != "relation"]
    joined = ranked if "relation" in ranked.columns else ranked.join(labels, keys, "left")
    groups = joined.groupBy(*by, "finalScore").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("relation") == "positive").alias("n_pos"), F.count_if(F.col("relation") == "negative").alias("n_neg")
    )
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(F.desc("finalScore")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("first", before + 1).withColumn("mid", F.col("first") + (F.col("size") - 1) / 2.0)


def discount(first: Column, last: Column) -> Column:
    """Sum of 1 / log2(position + 1) from ``first`` to ``last``; 0 if there are none."""
    positions = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(positions, F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))


def combination(n: Column, k: Column) -> Column:
    """n over k in doubles; 0 for k > n."""
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(k > n, 0.0).otherwise(F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / i))


def reciprocal_rank(k: int) -> Column:
    """Expected reciprocal rank of the first positive within k places, when ties are in random order; of a query's
    first tie group with a positive (size, n_pos, first)."""
    before, g, p = F.col("first") - 1, F.col("size"), F.col("n_pos")
    most = F.least(g - p + 1, F.lit(k) - before)
    places = F.when(most >= 1, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<long>"))
    total = combination(g, p)
    return F.aggregate(places, F.lit(0.0), lambda a, j: a + combination(g - j, p - 1) / total / (before + j))


def evaluate(ranked: DataFrame, labels: DataFrame, by: list[str], ks: tuple[int, ...] = (3, 5, 10), rr_k: int = 10, first_places: bool = False) -> DataFrame:
    """Metrics of each query: precision, recall and NDCG at k, MRR (1 / least mid-rank of a positive), expected
    reciprocal rank within ``rr_k``, neg_sink (mean relative mid-rank of negatives), and counts.

    Ties share places: a tie group gives its share of positives to each place it fills. With ``first_places`` only the metrics that
    hang on the first places (precision, recall, NDCG and expected reciprocal rank) are returned; they need only the
    groups that reach into these places, so others are counted but not shuffled.
    """
    groups = tie_groups(leading(ranked, by, max(*ks, rr_k)) if first_places else ranked, labels, by)
    gold_by = [c for c in labels.columns if c not in ("relation", "DepMap_ID")]
    gold = labels.groupBy(*gold_by).agg(F.count_if(F.col("relation") == "positive").alias("n_pos_gold"), F.count_if(F.col("relation") == "negative").alias("n_neg_gold"))
    parts, share = [], F.col("n_pos") / F.col("size")
    for k in ks:
        slots = F.greatest(F.least(F.col("size"), F.lit(k) - F.col("first") + 1), F.lit(0).cast("long"))
        parts += [F.sum(slots * share).alias(f"hits{k}"), F.sum(share * discount(F.col("first"), F.col("first") + slots - 1)).alias(f"dcg{k}")]
    head = F.min_by(F.struct("size", "n_pos", "first"), F.when(F.col("n_pos") > 0, F.col("first")))
    sums = groups.groupBy(*by).agg(
        F.sum("size").alias("n_candidates"),
        F.sum("n_pos").alias("n_pos_found"),
        F.sum("n_neg").alias("n_neg_found"),
        F.max("size").alias("largest_tie"),
        F.min(F.when(F.col("n_pos") > 0, F.col("mid"))).alias("first_mid"),
        F.sum(F.col("n_neg") * (F.col("mid") - 1)).alias("sunk"),
        head.alias("head"),
        *parts,
    )
    rows = sums.join(F.broadcast(gold) if not gold_by else gold, gold_by) if gold_by else sums.crossJoin(gold)
    rows = rows.where("n_pos_gold > 0")
    out = {}
    for k in ks:
        ideal = discount(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), F.col("n_pos_gold")))
        out |= {f"p_at_{k}": F.col(f"hits{k}") / k, f"recall_at_{k}": F.col(f"hits{k}") / F.col("n_pos_gold"), f"ndcg_at_{k}": F.col(f"dcg{k}") / ideal}
    rows = rows.withColumns({"size": F.col("head.size"), "n_pos": F.col("head.n_pos"), "first": F.col("head.first")})
    out["mrr"] = F.coalesce(1.0 / F.col("first_mid"), F.lit(0.0))
    out["expected_rr"] = F.coalesce(F.when(F.col("n_pos") > 0, reciprocal_rank(rr_k)), F.lit(0.0))
    out["neg_sink"] = F.try_divide(F.col("sunk"), F.col("n_neg_found") * (F.col("n_candidates") - 1))
    rows = rows.withColumns(out)
    if first_places:
        return rows.select(*by, "n_pos_gold", *(c for c in out if c not in ("mrr", "neg_sink")))
    return rows.select(*by, "n_candidates", "n_pos_gold", "n_pos_found", "n_neg_gold", "n_neg_found", "largest_tie", *out)


def summarise(detail: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and number of each metric by configuration."""
    return detail.groupBy("config").agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))))


def deltas(detail: DataFrame, baseline: str, metric: str, unit: str) -> DataFrame:
    """Paired differences to the baseline: mean, median, wins, ties and losses of each configuration."""
    base = detail.where(F.col("config") == baseline).select(unit, F.col(metric).alias("b"))
    d = F.col(metric) - F.col("b")
    paired = detail.join(base, unit).withColumn("d", d)
    return paired.groupBy("config").agg(
        F.avg("d").alias("mean_delta"),
        F.percentile("d", F.lit(0.5)).alias("median_delta"),
        F.count_if(F.col("d") > 1e-12).alias("wins"),
        F.count_if(F.abs("d") <= 1e-12).alias("ties"),
        F.count_if(F.col("d") < -1e-12).alias("losses"),
    )


def bootstrap(detail: DataFrame, baseline: str, metric: str, unit: str, iterations: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile intervals of the mean paired difference. Draws are a hash of (seed, iteration, slot), so they repeat on every run."""
    base = detail.where(F.col("config") == baseline).select(unit, F.col(metric).alias("b"))
    paired = detail.join(base, unit).select("config", unit, (F.col(metric) - F.col("b")).alias("d"))
    values = paired.groupBy("config").agg(F.transform(F.sort_array(F.collect_list(F.struct(unit, "d"))), lambda x: x["d"]).alias("v"))
    rows = values.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    draw = lambda s: F.get("v", F.pmod(F.xxhash64(F.lit(seed), F.col("i"), s), F.size("v")).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0.0), lambda a, s: a + draw(s))
    means = rows.select("config", (total / F.size("v")).alias("m"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("sum"), F.size("v").alias("n"))
    return means.groupBy("config").agg(
        F.first(F.col("sum") / F.col("n")).alias("mean_delta"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("iterations")
    )


def one_standard_error(summary: DataFrame, configs: DataFrame, primary: str, anchor: tuple[float, float, float], by: list[str] | None = None) -> DataFrame:
    """Of the configurations within one standard error of the best, the one nearest to the anchor's weights."""
    by = by or []
    rows = summary.join(F.broadcast(configs.select("config", "rna_w", "protein_w", "confidence_w")), "config")
    mean, se = F.col(f"{primary}_mean"), F.coalesce(F.col(f"{primary}_sd") / F.sqrt(F.col(f"{primary}_n")), F.lit(0.0))
    best = Window.partitionBy(*by).orderBy(F.desc(f"{primary}_mean"), "config")
    rows = rows.withColumns({"floor": F.first(mean - se).over(best), "best": F.first("config").over(best)})
    apart = sum((F.abs(F.col(c) - a) for c, a in zip(("rna_w", "protein_w", "confidence_w"), anchor, strict=True)), F.lit(0.0))
    rows = rows.where(mean >= F.col("floor")).withColumn("distance", F.floor(apart * 1e9 + 0.5) / 1e9)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("distance", "protein_w", F.desc(f"{primary}_mean"), "config"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return rows.withColumns({"nth": nth, "n_eligible": size}).where("nth = 1").select(*by, "config", "best", f"{primary}_mean", "distance", "n_eligible")


def leave_one_out(detail: DataFrame, configs: DataFrame, primary: str, unit: str, anchor: tuple[float, float, float]) -> DataFrame:
    """For each unit: the configuration chosen without it, and how that does on it."""
    held = detail.select(F.col(unit).alias("held_out")).distinct()
    # Units are the few queries of a study; each fold is the others.
    folds = detail.crossJoin(F.broadcast(held)).where(F.col(unit) != F.col("held_out"))
    summary = folds.groupBy("held_out", "config").agg(F.avg(primary).alias(f"{primary}_mean"), F.stddev_samp(primary).alias(f"{primary}_sd"), F.count(primary).alias(f"{primary}_n"))
    chosen = one_standard_error(summary, configs, primary, anchor, ["held_out"])
    own = detail.select(F.col(unit).alias("held_out"), "config", F.col(primary).alias("held_out_value"))
    return chosen.join(own, ["held_out", "config"], "left").select("held_out", "config", "held_out_value", "n_eligible")
