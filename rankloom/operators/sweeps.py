"""Configuration sweeps: many weightings of the same candidates in one plan."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.scalar import clip01, rna_trust, rounded
from rankloom.operators.scoring import agreement, scale
from rankloom.session import materialised


@dataclass(frozen=True)
class SweepConfig:
    """One configuration. structure: standard, rna_only or v3 (flat)."""

    config: str
    rna_w: float = 0.55
    protein_w: float = 0.30
    confidence_w: float = 0.15
    w_completeness: float = 0.40
    w_support: float = 0.35
    w_consistency: float = 0.25
    protein_biology: bool = True
    protein_confidence: bool = True
    adaptive: bool = False
    structure: str = "standard"
    max_penalty: float = 0.30

    def __post_init__(self) -> None:
        inner = self.w_completeness + self.w_support + self.w_consistency
        outer = self.rna_w + self.protein_w + self.confidence_w
        if abs(inner - 1) > 1e-9 or (self.structure == "standard" and abs(outer - 1) > 1e-9):
            raise ValueError(f"{self.config}: weights must sum to 1")


# The configurations of the labelled and of the controlled study, and the flat structure's weights.
_A0 = SweepConfig("A0_team_baseline")
LABELLED = [
    SweepConfig("B0_rna_mean", protein_biology=False, protein_confidence=False, structure="rna_only"),
    _A0,
    SweepConfig("A1a_no_direct_protein", 0.85, 0.0),
    SweepConfig("A1b_no_protein_evidence", 0.85, 0.0, protein_biology=False, protein_confidence=False),
    SweepConfig("A2_no_confidence", 0.647, 0.353, 0.0),
    SweepConfig("A3_equal_bio", 0.425, 0.425),
    SweepConfig("A3b_reversed_bio", 0.30, 0.55),
    SweepConfig("A4_adaptive_trust", adaptive=True),
    SweepConfig("A5_v3_structure", structure="v3"),
    SweepConfig("A6_v3_full", adaptive=True, structure="v3"),
]
CONTROLLED = [
    SweepConfig("B0_rna_mean", 1.0, 0.0, 0.0, protein_biology=False, protein_confidence=False, structure="rna_only"),
    _A0,
    SweepConfig("A1a_no_direct_protein", 0.85, 0.0, protein_biology=False),
    SweepConfig("A1b_no_protein_evidence", 0.85, 0.0, protein_biology=False, protein_confidence=False),
    SweepConfig("A1c_no_protein_confidence", protein_confidence=False),
    SweepConfig("A2_no_confidence", 0.55 / 0.85, 0.30 / 0.85, 0.0),
    SweepConfig("A2a_no_conf_completeness", w_completeness=0.0, w_support=0.35 / 0.60, w_consistency=0.25 / 0.60),
    SweepConfig("A2b_no_conf_source_support", w_completeness=0.40 / 0.65, w_support=0.0, w_consistency=0.25 / 0.65),
    SweepConfig("A2c_no_conf_consistency", w_completeness=0.40 / 0.75, w_support=0.35 / 0.75, w_consistency=0.0),
    SweepConfig("A3_equal_bio", 0.425, 0.425),
    SweepConfig("A3b_reversed_bio", 0.30, 0.55),
    SweepConfig("A4_adaptive_trust", adaptive=True),
    SweepConfig("A5_v3_structure", structure="v3"),
    SweepConfig("A6_v3_full", adaptive=True, structure="v3"),
]
FLAT = {"rna": 0.444, "protein": 0.278, "consistency": 0.167, "completeness": 0.111}
CAPS = {"P00": 0.0, "P15": 0.15, "P30": 0.30, "P45": 0.45}


def penalty_profiles() -> list[SweepConfig]:
    return [replace(_A0, config=name, max_penalty=cap) for name, cap in CAPS.items()]


def weight_grid() -> list[SweepConfig]:
    """RNA, protein and confidence weights in steps of 0.05, RNA from 0.50 to 0.90."""
    out = []
    for protein in range(0, 31, 5):
        for confidence in range(10, 31, 5):
            rna = 100 - protein - confidence
            if 50 <= rna <= 90:
                name = f"W_rna{rna / 100:.2f}_protein{protein / 100:.2f}_confidence{confidence / 100:.2f}"
                out.append(SweepConfig(name, rna / 100, protein / 100, confidence / 100))
    return out


def config_table(spark: SparkSession, configs: list[SweepConfig]) -> DataFrame:
    """One row for each configuration; a fixed handful, so it may be broadcast."""
    kinds = {"str": "string", "float": "double", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(SweepConfig))
    return spark.createDataFrame([astuple(c) for c in configs], schema)


def sweep(rows: DataFrame, configs: DataFrame, by: list[str], controlled: bool = False) -> DataFrame:
    """Scores of every candidate under every configuration (``sweep_scores``), with rank and tie mid-rank."""
    # Ranks need sums over the scores first.
    return tie_ranks(materialised(sweep_scores(rows, configs, by, controlled)), ["config", *by], controlled)


def scaled(rows: DataFrame, by: list[str]) -> DataFrame:
    """Candidates with their layers scaled within ``by``, for studies that score them several times."""
    return scale(rows, by, {"__r": "rnaExpr", "__p": "protExpr", "__e": "exclusionExpr"}, close=True)


def sweep_scores(rows: DataFrame, configs: DataFrame, by: list[str], controlled: bool = False, keep: tuple[str, ...] = (), unscored: bool = False) -> DataFrame:
    """Scores of every candidate under every configuration, without ranks, which most studies don't need of all rows.

    Columns in ``keep`` stay; with ``unscored``, candidates without a score under a configuration do too, and ``scored`` tells them. Candidates are scaled once within ``by``, before configurations multiply them; ``scaled`` ones are taken as they lie. Rows carry a
    ``correlation`` (may be null) for adaptive trust. Labelled study: rows without RNA score 0 where only RNA
    counts, an exclusion penalty applies, and scores aren't rounded. Controlled: such rows go, no penalty
    applies, and final and confidence scores are rounded before ranking; ties go by confidence, then id.
    """
    if "__r" not in rows.columns:
        # Configurations multiply few candidates, which may lie in a single partition.
        rows = scaled(rows, by).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.crossJoin(F.broadcast(configs))
    r, p = F.col("__r"), F.col("__p")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    has_r, seen = r.isNotNull(), p.isNotNull()
    # In the labelled study protein counts for biology unless all of its evidence is off.
    has_p = seen & (F.col("protein_biology") if controlled else F.col("protein_confidence"))
    used = F.when(F.col("protein_confidence"), p)
    flags = [F.col(c).cast("int") for c in ("hasDepMapRNA", "hasHpaRNA", "hasGeoRNA", "hasProteomics")]
    with_p = F.col("protein_confidence")
    complete = F.when(with_p, (has_r.cast("int") + seen.cast("int")) / 2.0).otherwise(has_r.cast("double"))
    support = F.when(with_p, sum(flags, F.lit(0)) / 4.0).otherwise(sum(flags[:3], F.lit(0)) / 3.0)
    agree = F.when(with_p, agreement(r, used))
    weighed = F.col("w_completeness") * complete + F.col("w_support") * support + zero(F.when(with_p, F.col("w_consistency")) * agree)
    confidence = zero(F.try_divide(weighed, F.col("w_completeness") + F.col("w_support") + F.when(with_p, F.col("w_consistency")).otherwise(0.0)))
    trust = F.when(F.col("adaptive"), rna_trust(F.col("correlation"))).otherwise(1.0)
    rows = rows.withColumns({"__trust": trust, "__has_r": has_r, "__has_p": has_p, "__complete": complete, "__support": support, "__agree": agree, "__confidence": confidence})
    has_r, has_p, trust = F.col("__has_r"), F.col("__has_p"), F.col("__trust")

    # Weights and partial scores are columns of their own: one expression for all of it repeats them in every branch.
    rows = rows.withColumns({"__rna_w": F.col("rna_w") * trust, "__flat_r": F.lit(FLAT["rna"]) * trust})
    freed, flat_freed = F.col("rna_w") - F.col("__rna_w"), FLAT["rna"] - F.col("__flat_r")
    rows = rows.withColumns(
        {
            "__protein_w": F.when(has_p, F.col("protein_w") + freed).otherwise(0.0),
            "__rna_w": F.when(has_p, F.col("__rna_w")).otherwise(F.col("__rna_w") + freed),
            "__flat_p": F.when(has_p, FLAT["protein"] + flat_freed).otherwise(0.0),
            "__flat_r": F.when(has_p, F.col("__flat_r")).otherwise(F.col("__flat_r") + flat_freed + FLAT["protein"] + FLAT["consistency"]),
        }
    )
    weight = F.col("__rna_w") * has_r.cast("int") + F.col("__protein_w")
    # Whether there is a score hangs on weights alone: a filter on the score itself is pushed below all columns and computes each of them again, many times.
    alone, flat_there = (has_r, has_r | has_p) if controlled else (F.lit(True), F.lit(True))
    scored = F.when(F.col("structure") == "rna_only", alone).when(F.col("structure") == "v3", flat_there).otherwise(weight != 0)
    rows = rows.withColumn("scored", scored)
    rows = rows if unscored else rows.where("scored")
    biology = F.try_divide(F.col("__rna_w") * zero(r) + F.col("__protein_w") * zero(p), weight)
    flat_c = F.when(has_p, FLAT["consistency"]).otherwise(0.0)
    flat = F.col("__flat_r") * zero(r) + F.col("__flat_p") * zero(F.when(has_p, p)) + flat_c * zero(F.col("__agree")) + FLAT["completeness"] * F.col("__complete")
    rows = rows.withColumns({"__standard": (F.col("rna_w") + F.col("protein_w")) * biology + F.col("confidence_w") * F.col("__confidence"), "__flat": flat})
    standard, flat = F.col("__standard"), F.col("__flat")
    if controlled:
        final = F.when(F.col("structure") == "rna_only", r).when(F.col("structure") == "v3", F.when(has_r | has_p, flat)).otherwise(standard)
        shape = lambda c: rounded(clip01(c))
    else:
        penalty = zero(F.col("max_penalty") * F.col("__e"))
        final = F.when(F.col("structure") == "rna_only", zero(r)).when(F.col("structure") == "v3", flat - penalty).otherwise(standard - penalty)
        shape = clip01
    rows = rows.withColumn("__final", final)
    # Never null here, which spares joins on it the same filter.
    score = shape(F.col("__final")) if unscored else zero(shape(F.col("__final")))
    rows = rows.withColumns({"finalScore": score, "confidenceScore": shape(F.col("__confidence")) if controlled else F.col("__confidence"), "exclusionScaled": F.col("__e")})
    rows = rows.select("config", *by, "DepMap_ID", "finalScore", "confidenceScore", "exclusionScaled", "__has_r", "__has_p", *keep, *(["scored"] if unscored else []))
    return rows.withColumnsRenamed({"__has_r": "has_rna", "__has_p": "has_protein"})


def score_part(score: str) -> Column:
    """The ten-thousandth of a score from 0 to 1, the best first.

    Never null, as else a join on it filters its rows by it, below all columns that the score comes from: an expression too long to be compiled.
    """
    return F.coalesce(F.floor((1.0 - F.col(score)) * 10_000).cast("int"), F.lit(10_001))


def leading(scores: DataFrame, by: list[str], k: int, score: str = "finalScore") -> DataFrame:
    """Rows enough to rank the k best of ``by``, ties kept: those of ten-thousandths with fewer than k rows above.

    All rows of a score and all rows above are among them, so places and ties of the k best are those that they have
    among all rows. At most k ten-thousandths of a group have so few rows above; these are broadcast.
    """
    rows = scores.withColumn("__part", score_part(score))
    sums = rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    above = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = sums.withColumn("__above", F.coalesce(above, F.lit(0))).where(F.col("__above") < k).select(*by, "__part")
    return rows.join(F.broadcast(first), [*by, "__part"], "left_semi").select(*scores.columns)


def places(scores: DataFrame, by: list[str], score: str = "finalScore", copies: str | None = None) -> DataFrame:
    """rankMin, rankMid, rankMax and tieSize of each score of ``by``; of scores with four digits, so at most 10,001 rows a group.

    With ``copies`` a row counts as often as this column says.
    """
    sums = scores.groupBy(*by, score).agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("tieSize"))
    above = F.sum("tieSize").over(Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1))
    least = sums.withColumn("rankMin", F.coalesce(above, F.lit(0)) + 1)
    return least.withColumns({"rankMid": F.col("rankMin") + (F.col("tieSize") - 1) / 2.0, "rankMax": F.col("rankMin") + F.col("tieSize") - 1})


def pool_scores(rows: DataFrame, configs: DataFrame, by: list[str], labels: DataFrame, k: int) -> DataFrame:
    """Scores and rankMin under every configuration of the controlled study, of candidates that are among the k best (ties kept)
    of some configuration, or labelled. Nobody else is in a pool, so others are scored and counted, but neither joined nor stored."""
    keys = [*by, "DepMap_ID"]
    group = ["config", *by]
    # A handful of configurations and queries with 10,001 scores at most.
    ranks = materialised(places(sweep_scores(rows, configs, by, True), group)).select(*group, "finalScore", "rankMin")
    first = F.broadcast(ranks.where(F.col("rankMin") <= k))
    best = sweep_scores(rows, configs, by, True).join(first, [*group, "finalScore"], "left_semi").select(*keys)
    chosen = best.union(labels.select(*keys)).distinct().withColumn("__chosen", F.lit(True))
    marked = materialised(rows.join(chosen, keys, "left"))
    mine = sweep_scores(marked, configs, by, True, keep=("__chosen",)).where("__chosen").drop("__chosen")
    return mine.join(F.broadcast(ranks), [*group, "finalScore"])


def tie_ranks(rows: DataFrame, by: list[str], by_confidence: bool = False, score: str = "finalScore") -> DataFrame:
    """rank (ordinal), rankMin, rankMid, rankMax and tieSize of equal scores, and comparatorTieSize, of equal score and confidence.

    Scores are from 0 to 1. Groups of equal rows are counted, and their places come from sums over a ten-thousandth of the scores and
    over at most 10,001 of those, so no task has all candidates of ``by``. Equal rows are sorted by id; without ``by_confidence``
    all rows of a score are. Scores and confidences (if there are any) may not be null.
    """
    confidence = [c for c in rows.columns if c == "confidenceScore"]
    part, tied = score_part(score), [*by, "__part", score]
    equal = tied + confidence
    rows = rows.withColumn("__part", part)
    # Keyed on all columns of ``equal``, so that the counts and the rows that get them meet by one exchange each.
    groups = rows.groupBy(*equal).agg(F.count(F.lit(1)).alias("comparatorTieSize"))
    up_to = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    parts = groups.groupBy(*by, "__part").agg(F.sum("comparatorTieSize").alias("__rows"))
    parts = parts.withColumn("__above", none(F.sum("__rows").over(up_to(*by).orderBy("__part")))).drop("__rows")
    same = Window.partitionBy(*tied)
    groups = groups.withColumn("__before", none(F.sum("comparatorTieSize").over(up_to(*by, "__part").orderBy(F.desc(score), *map(F.desc, confidence)))))
    groups = groups.withColumns({"__first": F.min("__before").over(same), "tieSize": F.sum("comparatorTieSize").over(same)}).join(parts, [*by, "__part"])
    within = equal if by_confidence else tied
    nth = F.row_number().over(Window.partitionBy(*within).orderBy("DepMap_ID"))
    least, start = F.col("__above") + F.col("__first") + 1, F.col("__above") + F.col("__before" if by_confidence else "__first")
    placed = rows.withColumn("__nth", nth).join(groups, equal).withColumns({"rank": start + F.col("__nth"), "rankMin": least})
    placed = placed.withColumns({"rankMid": F.col("rankMin") + (F.col("tieSize") - 1) / 2.0, "rankMax": F.col("rankMin") + F.col("tieSize") - 1})
    return placed.select(*(c for c in rows.columns if c != "__part"), "rank", "rankMin", "tieSize", "comparatorTieSize", "rankMid", "rankMax")


def top_with_ties(ranked: DataFrame, k: int) -> DataFrame:
    """The k best and all that tie with the last of them."""
    return ranked.where(F.col("rankMin") <= k)


def compared(ranked: DataFrame, baseline: str, by: list[str], k: int = 10) -> DataFrame:
    """Each configuration against the baseline, by query: Jaccard of the top k, entered and left, changed top,
    rank correlation, mean and largest rank change, and candidates in common."""
    keep = [*by, "DepMap_ID"]
    sides = lambda df, s, *more: df.select(*more, *keep, F.col("rankMid").alias(f"mid{s}"), F.col("finalScore").alias(f"score{s}"), F.col("rank").alias(f"rank{s}"), (F.col("rankMin") <= k).alias(f"top{s}"))
    base = sides(ranked.where(F.col("config") == baseline), "0")
    mine = sides(ranked, "1", "config")
    names = ranked.select("config").distinct()
    full = mine.join(base.crossJoin(F.broadcast(names)), ["config", *keep], "full")
    first = lambda s: F.max(F.when(F.col(f"rank{s}") == 1, F.col("DepMap_ID")))
    return comparison(full, by, F.coalesce(first("1") != first("0"), F.lit(True)))


def compared_scores(rows: DataFrame, configs: DataFrame, baseline: str, by: list[str], k: int = 10) -> DataFrame:
    """``compared`` for the controlled study, straight from its candidates: a candidate's score under the baseline is a column beside
    its other scores, and places are looked up by score, so rows are neither sorted nor joined with each other.

    A candidate is one row. Where rows have ``copies``, it counts as so many rows of one id: places count all of them, and each
    copy is paired with each copy under the baseline.
    """
    group = ["config", *by]
    rows = scaled(rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long")), by)
    others = tuple(c for c in rows.columns if c not in (*by, "DepMap_ID"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # All passes start from these rows. A score is null where there is none.
    base = sweep_scores(rows, configs.where(F.col("config") == baseline), by, True, keep=others, unscored=True)
    rows = materialised(base.select(*by, "DepMap_ID", *others, F.col("finalScore").alias("score0")))
    # A handful of configurations and queries with 10,001 scores at most.
    ranks = materialised(places(sweep_scores(rows, configs, by, True, keep=("copies",)), group, copies="copies"))
    sides = lambda s: (F.col("finalScore").alias(f"score{s}"), F.col("rankMid").alias(f"mid{s}"), (F.col("rankMin") <= k).alias(f"top{s}"))
    pairs = sweep_scores(rows, configs, by, True, keep=("score0", "copies"), unscored=True).withColumnRenamed("finalScore", "score1")
    pairs = pairs.where("scored or score0 is not null").join(F.broadcast(ranks.select("config").distinct()), "config", "left_semi")
    pairs = pairs.join(F.broadcast(ranks.select(*group, *sides("1"))), [*group, "score1"], "left")
    pairs = pairs.join(F.broadcast(ranks.where(F.col("config") == baseline).select(*by, *sides("0"))), [*by, "score0"], "left")
    best = sweep_scores(rows, configs, by, True).join(F.broadcast(ranks.where("rankMin = 1").select(*group, "finalScore")), [*group, "finalScore"], "left_semi")
    first = materialised(best.groupBy(*group).agg(F.min_by("DepMap_ID", F.struct(-F.col("confidenceScore"), F.col("DepMap_ID"))).alias("__first")))
    of_base = first.where(F.col("config") == baseline).select(*by, F.col("__first").alias("__first0"))
    both = F.col("scored") & F.col("score0").isNotNull()
    out = comparison(pairs, by, F.lit(None).cast("boolean"), F.when(both, F.col("copies") * F.col("copies")).otherwise(F.col("copies")))
    changed = F.coalesce(F.col("__first") != F.col("__first0"), F.lit(True))
    return out.join(F.broadcast(first), group, "left").join(F.broadcast(of_base), by, "left").withColumn("top1_changed", changed).select(*out.columns)


def comparison(full: DataFrame, by: list[str], top1_changed: Column, times: Column | None = None) -> DataFrame:
    """Sums of ``compared`` over pairs of a configuration's (1) and the baseline's (0) mid-rank, score and place in the top.

    A pair counts ``times`` times, once if that isn't given.
    """
    times = F.lit(1).cast("long") if times is None else times
    in1, in0 = F.coalesce("top1", F.lit(False)), F.coalesce("top0", F.lit(False))
    both = F.col("mid1").isNotNull() & F.col("mid0").isNotNull()
    same = F.max(F.when(both, F.abs(F.col("mid1") - F.col("mid0"))))
    count = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    n, x, y = count(both), F.col("mid1"), F.col("mid0")
    mean = lambda c: F.try_divide(F.sum(F.when(both, c * times)), n)
    cov = mean(x * y) - mean(x) * mean(y)
    var = (mean(x * x) - mean(x) * mean(x)) * (mean(y * y) - mean(y) * mean(y))
    spearman = F.when(same == 0, 1.0).when(var > 1e-9, cov / F.sqrt(var))
    return full.groupBy("config", *by).agg(
        n.alias("n_common"),
        F.try_divide(count(in1 & in0).cast("double"), count(in1 | in0)).alias("jaccard"),
        count(in1 & ~in0).alias("n_entered"),
        count(in0 & ~in1).alias("n_left"),
        top1_changed.alias("top1_changed"),
        spearman.alias("spearman"),
        mean(F.abs(x - y)).alias("mean_rank_change"),
        same.alias("max_rank_change"),
        count(both & (F.col("score1") > F.col("score0"))).alias("n_up"),
        count(both & (F.col("score1") < F.col("score0"))).alias("n_down"),
    )


def monotone_violations(ranked: DataFrame, caps: DataFrame, by: list[str]) -> DataFrame:
    """The largest rise of a score with its cap (config, cap), by query; 0 if scores never rise."""
    rows = ranked.join(F.broadcast(caps), "config")
    before = F.lag("finalScore").over(Window.partitionBy(*by, "DepMap_ID").orderBy("cap"))
    rise = F.greatest(F.coalesce(F.col("finalScore") - before, F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("rise", rise).groupBy(*by).agg(F.max("rise").alias("max_rise"), F.count(F.lit(1)).alias("n_rows"))


def renormalised(*weights: Column) -> list[Column]:
    """Weights as shares of their sum; null where that is 0."""
    total = sum(weights, F.lit(0.0))
    return [F.try_divide(w, total) for w in weights]
