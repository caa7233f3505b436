"""Checks of studies: equality of scorings, unique and finite rows, and the rows that report them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalar import exact_mean


def close(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Equal, both null, or apart by no more than the tolerance."""
    near = F.abs(a - b) <= tolerance if tolerance else F.lit(False)
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def parity(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """One row: rows of ``a`` only, of ``b`` only, and of both with a column that isn't close."""
    side = lambda df, s: df.select(*keys, F.lit(True).alias(f"__{s}"), *(F.col(c).alias(f"{c}__{s}") for c in columns))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    equal = reduce(lambda x, y: x & y, (close(F.col(f"{c}__a"), F.col(f"{c}__b"), tolerance) for c in columns))
    return both.agg(F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b"), F.count_if(in_a & in_b & ~equal).alias("different"))


def unique_finite(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: rows, keys that are there more than once, and rows with a value that is null or not finite."""
    bad = reduce(lambda x, y: x | y, (F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in values))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum("bad").alias("n_not_finite"))


def check_row(scope: str, check: str, counted: DataFrame, observed: str, expected: int = 0) -> DataFrame:
    """A row that reports a check of a one-row table: scope, check, status, observed and expected."""
    seen = F.col(observed).cast("long")
    return counted.select(F.lit(scope).alias("scope"), F.lit(check).alias("check"), F.when(seen == expected, "PASS").otherwise("FAIL").alias("status"), seen.alias("observed"), F.lit(expected).cast("long").alias("expected"))


def top_with_tolerance(ranked: DataFrame, by: list[str], k: int, tolerance: float = 1e-12, score: str = "finalScore") -> DataFrame:
    """The k best of each group of ``by`` and all whose score is as good as that of the last of them, up to the tolerance."""
    last = ranked.where(F.col("rank") == k).select(*by, F.col(score).alias("__last"))
    return ranked.join(last, by, "left").where(F.col("__last").isNull() | (F.col(score) >= F.col("__last") - tolerance)).drop("__last")


def pool_counts(pool: DataFrame, by: str = "query") -> DataFrame:
    """Candidates of each query, how many of them are labelled, and how many of each relation."""
    of = lambda relation: F.count_if(F.col("relation") == relation).alias(f"n_{relation}")
    return pool.groupBy(by).agg(F.count(F.lit(1)).alias("n_candidates"), F.count("relation").alias("n_labelled"), of("positive"), of("negative"))


def pool_order(pool: DataFrame, by: str = "query") -> DataFrame:
    """Adds position: within a query by best rank, unranked ones last, then by id."""
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last("min_rank"), "DepMap_ID")
    return pool.withColumn("position", F.row_number().over(order).cast("long"))


def by_stratum(detail: DataFrame, stratum: str, by: list[str], rates: list[str]) -> DataFrame:
    """Rows and mean rates (of nine digits at most) by stratum, and over all as stratum ALL, in one pass."""
    rows = detail.withColumn(stratum, F.explode(F.array(F.col(stratum), F.lit("ALL"))))
    return rows.groupBy(stratum, *by).agg(F.count(F.lit(1)).alias("n"), *(exact_mean(F.col(r).cast("double")).alias(f"mean_{r}") for r in rates))


def contrasts(detail: DataFrame, pairs: DataFrame, metrics: list[str], unit: str) -> DataFrame:
    """Treatments against references (contrast, reference, treatment) on several metrics: means, mean and median
    difference, wins, ties and losses of the treatment over the units that both have."""
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))
    long = detail.select("config", unit, F.inline(values))
    pairs = F.broadcast(pairs)
    side = lambda role: pairs.join(long, F.col(role) == F.col("config")).select("contrast", "reference", "treatment", "metric", unit, F.col("v").alias(f"__{role}"))
    both = side("reference").join(side("treatment"), ["contrast", "reference", "treatment", "metric", unit]).withColumn("d", F.col("__treatment") - F.col("__reference"))
    return both.groupBy("contrast", "reference", "treatment", "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__reference").alias("reference_mean"),
        F.avg("__treatment").alias("treatment_mean"),
        F.avg("d").alias("mean_delta"),
        F.percentile("d", F.lit(0.5)).alias("median_delta"),
        F.count_if(F.col("d") > 1e-12).alias("wins"),
        F.count_if(F.abs("d") <= 1e-12).alias("ties"),
        F.count_if(F.col("d") < -1e-12).alias("losses"),
    )


# The constants of the portable generator.
STEP, WORD = 0x6D2B79F5, 1 << 32


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers modulo 2^32, by halves, so that nothing overflows."""
    low, high = F.pmod(a, F.lit(1 << 16)), F.shiftright(a, 16)
    return F.pmod(F.pmod(high * b, F.lit(1 << 16)) * (1 << 16) + low * b, F.lit(WORD))


def nth_draw(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) of the generator mulberry32, in [0, 1): its state moves by a constant, so any draw is at hand."""
    s = F.pmod(seed + F.pmod(n * STEP, F.lit(WORD)), F.lit(WORD))
    v = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    v = F.pmod(v + _times(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61))), F.lit(WORD)).bitwiseXOR(v)
    return v.bitwiseXOR(F.shiftright(v, 14)) / WORD


def label_seed(base: int, label: Column) -> Column:
    """A seed of its own for each label: the base, XOR the first 32 bits of the label's SHA-256."""
    return F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(base).cast("long"))


def paired_bootstrap(differences: DataFrame, label: str, unit: str, d: str, iterations: int = 5000, seed: int = 20260723) -> DataFrame:
    """Mean difference of each label and its 95 % interval over resampled units; exact, with interval 0, where all are 0.

    The units of a label are the few queries of a study. Draw s of iteration i is number (i - 1) * n + s of the label's
    generator, so results are the same wherever the generator is.
    """
    zero = F.max(F.abs(d)) <= 1e-12
    values = differences.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct(unit, d))), lambda x: x[d]).alias("v"), zero.alias("zero"))
    values = values.withColumns({"n": F.size("v").cast("long"), "seed": label_seed(seed, F.col(label))})
    rows = values.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    draw = lambda s: F.get("v", F.floor(nth_draw(F.col("seed"), (F.col("i") - 1) * F.col("n") + s) * F.col("n")).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0.0), lambda a, s: a + draw(s))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    means = rows.select(label, "zero", (total / F.col("n")).alias("m"), mean.alias("mean"))
    edge = lambda q: F.when(F.first("zero"), 0.0).otherwise(F.percentile("m", F.lit(q)))
    return means.groupBy(label).agg(F.first("mean").alias("mean_delta"), edge(0.025).alias("low"), edge(0.975).alias("high"))
