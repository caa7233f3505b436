"""Known answers and properties of scores, sweeps and metrics on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators.metrics import evaluate
from rankloom.operators.scoring import ScoringConfig, scale, scored
from rankloom.operators.sweeps import CONTROLLED, LABELLED, SweepConfig, config_table, penalty_profiles, sweep, tie_ranks, top_with_ties, weight_grid

SCHEMA = (
    "DepMap_ID string, cellLine string, rnaExpr double, protExpr double, exclusionExpr double, nRna int, nProt int, nExclusion int, "
    "hasDepMapRNA boolean, hasHpaRNA boolean, hasGeoRNA boolean, hasProteomics boolean"
)
A = ("ACH-A", "A", 100.0, 10.0, 0.0, 1, 1, 1, True, False, False, True)
B = ("ACH-B", "B", 0.0, 1.0, 0.0, 1, 1, 1, True, False, False, True)
THREE = [
    ("ACH-1", "1", 10.0, 0.0, None, 3, 1, 0, True, True, True, True),
    ("ACH-2", "2", 3.0, 10.0, None, 3, 1, 0, True, True, True, True),
    ("ACH-3", "3", 0.0, 0.0, None, 1, 1, 0, True, False, False, True),
]


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_protein_only_formula(spark):
    for r in scored(rows(spark, [A, B]), "PROTEIN_ONLY").collect():
        expected = 0.85 * r["proteinScore"] + 0.15 * r["confidenceScore"] - r["exclusionPenalty"]
        assert r["biologicalScore"] == r["proteinScore"] and abs(r["finalScore"] - max(0, min(1, expected))) < 1e-4


def test_protein_only_rejects_missing_protein(spark):
    gone = (*A[:3], None, *A[4:6], 0, *A[7:11], False)
    assert [r["DepMap_ID"] for r in scored(rows(spark, [gone, B]), "PROTEIN_ONLY").collect()] == ["ACH-B"]


def test_missing_layer_gives_its_weight_away(spark):
    gone = (*A[:3], None, *A[4:6], 0, *A[7:11], False)
    top = scored(rows(spark, [gone, B]), "GENE_MULTIOMICS").where("DepMap_ID = 'ACH-A'").first()
    assert top["biologicalScore"] == 1.0 and top["proteinScore"] is None and top["rnaProteinConsistencyScore"] == 0.5


@pytest.mark.parametrize(("values", "penalties"), [([0.0, 5.0, 10.0, None], [0, 0.15, 0.30, 0]), ([2.0, 2.0, 2.0, 2.0], [0.3] * 4), ([0.0] * 4, [0] * 4), ([-2.0] * 4, [0] * 4)])
def test_exclusion_penalty(spark, values, penalties):
    data = [(f"ACH-{i}", "x", 1.0, 1.0, v, 1, 1, int(v is not None), True, True, True, True) for i, v in enumerate(values)]
    got = {r["DepMap_ID"]: r["exclusionPenalty"] for r in scored(rows(spark, data), "GENE_MULTIOMICS").collect()}
    assert [got[f"ACH-{i}"] for i in range(4)] == pytest.approx(penalties)


def test_order_of_input_does_not_matter(spark):
    data = [(f"ACH-{i:02}", "x", float(i * 7 % 5), float(i % 3), None, 1, 1, 0, True, i % 2 == 0, False, True) for i in range(20)]
    first, second = (sorted((r["rank"], r["DepMap_ID"], r["finalScore"]) for r in scored(rows(spark, d), "COMBINED").collect()) for d in (data, data[::-1]))
    assert first == second and all(0 <= s <= 1 for _, _, s in first)


def test_empty_candidates(spark):
    assert scored(rows(spark, []), "GENE_MULTIOMICS").count() == 0


def test_config_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        ScoringConfig(rna_weight=0.9)
    with pytest.raises(ValueError):
        SweepConfig("x", w_support=0.9)


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", -1.0), ("b", None), ("c", 1.0), ("c", 3.0)], "k string, v double")
    sign = scale(df, ["k"], {"s": "v"}).groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("s"))
    assert {r["k"]: r["s"] for r in sign.collect()} == {"a": [1.0, 1.0], "b": [0.0], "c": [0.0, 1.0]}
    zero = scale(df, ["k"], {"s": "v"}, constant="zero").where("k = 'a'").collect()
    assert {r["s"] for r in zero} == {0.0}


def swept(spark, configs, data=THREE, correlation=None, controlled=True):
    df = rows(spark, data).withColumns({"query": F.lit("Q"), "correlation": F.lit(correlation).cast("double")})
    return sweep(df, config_table(spark, configs), ["query"], controlled)


def test_baseline_of_the_sweep_is_the_production_score(spark):
    ours = {r["DepMap_ID"]: (r["rank"], r["finalScore"]) for r in scored(rows(spark, THREE), "GENE_MULTIOMICS").collect()}
    base = {r["DepMap_ID"]: (r["rank"], r["finalScore"]) for r in swept(spark, [CONTROLLED[1]]).collect()}
    assert ours == base


def test_adaptive_trust(spark):
    def final(config, correlation):
        return {r["DepMap_ID"]: r["finalScore"] for r in swept(spark, [c for c in CONTROLLED if c.config == config], correlation=correlation).collect()}

    assert final("A4_adaptive_trust", 0.9) == final("A0_team_baseline", 0.9)
    assert final("A4_adaptive_trust", 0.1) != final("A0_team_baseline", 0.1)


def test_no_protein_evidence_ignores_protein(spark):
    changed = [(*r[:3], 5.0 - i, *r[4:]) for i, r in enumerate(THREE)]
    config = [c for c in CONTROLLED if c.config == "A1b_no_protein_evidence"]
    assert sorted(map(tuple, swept(spark, config).select("DepMap_ID", "finalScore").collect())) == sorted(map(tuple, swept(spark, config, changed).select("DepMap_ID", "finalScore").collect()))


def test_rows_without_rna(spark):
    data = [*THREE, ("ACH-4", "4", None, 3.0, None, 0, 1, 0, False, False, False, True)]
    count = lambda configs, controlled: swept(spark, [configs[0]], data, controlled=controlled).count()
    assert (count(CONTROLLED, True), count(LABELLED, False)) == (3, 4)


def test_scores_fall_with_the_cap(spark):
    data = [(f"ACH-{i}", "x", float(i), float(i % 2), float(i * 3 % 4), 1, 1, 1, True, True, True, True) for i in range(6)]
    scores = {}
    for r in swept(spark, penalty_profiles(), data, controlled=False).collect():
        scores.setdefault(r["DepMap_ID"], {})[r["config"]] = r["finalScore"]
    for s in scores.values():
        assert s["P00"] >= s["P15"] >= s["P30"] >= s["P45"]
        if s["P45"] > 0:
            assert s["P00"] - s["P30"] == pytest.approx(2 * (s["P00"] - s["P15"])) and s["P00"] - s["P45"] == pytest.approx(3 * (s["P00"] - s["P15"]))


def test_grid():
    grid = weight_grid()
    assert len(grid) == 32 and {"W_rna0.55_protein0.30_confidence0.15", "W_rna0.85_protein0.00_confidence0.15"} <= {c.config for c in grid}


def ranking(spark, scores):
    df = spark.createDataFrame([("Q", k, float(v)) for k, v in scores.items()], "query string, DepMap_ID string, finalScore double")
    return tie_ranks(df, ["query"])


def marks(spark, **relations):
    return spark.createDataFrame([("Q", k, v) for k, v in relations.items()], "query string, DepMap_ID string, relation string")


def test_tied_pair(spark):
    out = evaluate(ranking(spark, {"POS": 1, "TIE": 1, "LOW": 0}), marks(spark, POS="positive", MISSING="positive", LOW="negative"), ["query"], ks=(1,)).first()
    assert (out["p_at_1"], out["recall_at_1"], out["neg_sink"]) == (0.5, 0.25, 1.0) and out["mrr"] == pytest.approx(2 / 3)


def test_cut_off_tie(spark):
    scores = {f"R{i:02}": 1 - i / 10 for i in range(9)} | {"T1": 0.1, "T2": 0.1, "Z": 0.0}
    kept = top_with_ties(ranking(spark, scores), 10)
    tied = kept.where("DepMap_ID in ('T1', 'T2')").collect()
    assert kept.count() == 11 and {(r["rankMin"], r["rankMid"], r["rankMax"], r["tieSize"]) for r in tied} == {(10, 10.5, 11, 2)}


def test_ranks_and_ties_against_sorting(spark):
    """Ordinal and tie ranks by score alone and by score and confidence, over rows that tie in either."""
    rows = [("Q%d" % (i % 2), f"E{i:03}", (i * 7 % 11) / 11 / (1 + i % 3), (i * 5 % 4) / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "query string, DepMap_ID string, finalScore double, confidenceScore double")
    for by_confidence in (True, False):
        got = {r["DepMap_ID"]: r for r in tie_ranks(df, ["query"], by_confidence).collect()}
        for q in ("Q0", "Q1"):
            mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], -r[3] if by_confidence else 0, r[1]))
            for nth, (_, i, score, confidence) in enumerate(mine):
                above, same = sum(r[2] > score for r in mine), sum(r[2] == score for r in mine)
                want = (nth + 1, above + 1, above + (same + 1) / 2, above + same, same, sum(r[2:] == (score, confidence) for r in mine))
                assert tuple(got[i][c] for c in ("rank", "rankMin", "rankMid", "rankMax", "tieSize", "comparatorTieSize")) == want


def test_expected_reciprocal_rank(spark):
    out = evaluate(ranking(spark, {"N0": 1, "P1": 0.5, "N1": 0.5, "N2": 0.5}), marks(spark, P1="positive"), ["query"], ks=(2,)).first()
    assert out["expected_rr"] == pytest.approx((1 / 2 + 1 / 3 + 1 / 4) / 3) and out["p_at_2"] * 2 == pytest.approx(1 / 3) and out["mrr"] == pytest.approx(1 / 3)


@pytest.mark.parametrize(("relations", "expected"), [({"P1": "positive"}, (1 / 3, 1.0, 1.0)), ({"MISSING": "positive"}, (0.0, 0.0, 0.0))])
def test_perfect_and_no_hit(spark, relations, expected):
    out = evaluate(ranking(spark, {"P1": 3, "N1": 2, "N2": 1}), marks(spark, **relations), ["query"], ks=(3,)).first()
    assert (out["p_at_3"], out["ndcg_at_3"], out["expected_rr"]) == pytest.approx(expected)


def test_expected_rr_against_enumeration(spark):
    from itertools import permutations

    tied, positives, before = ["a", "b", "c", "d"], {"a", "b"}, 1
    places = [next(i for i, x in enumerate(p) if x in positives) for p in permutations(tied)]
    expected = sum(1 / (before + 1 + i) if before + 1 + i <= 3 else 0 for i in places) / math.factorial(4)
    out = evaluate(ranking(spark, {"top": 9} | dict.fromkeys(tied, 1)), marks(spark, a="positive", b="positive"), ["query"], ks=(3,), rr_k=3).first()
    assert out["expected_rr"] == pytest.approx(expected)


def test_merged_ties_do_not_hang_on_the_last_bits(spark):
    """Scores that differ by the order of a sum's terms are ties, which go by id."""
    noisy = [("ACH-1", 3.0), ("ACH-2", 3.0 + 4e-16 * 2), ("ACH-3", 10.0), ("ACH-4", 0.0)]
    data = [(i, i, v, None, None, 1, 0, 0, True, False, False, False) for i, v in noisy]
    got = {r["DepMap_ID"]: r["rank"] for r in scored(rows(spark, data), "GENE_MULTIOMICS", merged=True).collect()}
    assert noisy[0][1] != noisy[1][1] and got == {"ACH-3": 1, "ACH-1": 2, "ACH-2": 3, "ACH-4": 4}


def test_leading_rows_and_places_are_those_of_all_rows(spark):
    """Pruned rows get the ranks that they have among all, and places by score are those of ranked rows."""
    from rankloom.operators.sweeps import compared, compared_scores, leading, places, sweep_scores

    data = [(f"ACH-{i:03}", "x", float(i * 7 % 23), None if i % 4 == 0 else float(i % 5), None, 1, 1, 0, True, i % 2 == 0, False, i % 4 != 0) for i in range(60)]
    data += [("ACH-900", "x", None, 2.0, None, 0, 1, 0, False, False, False, True)]
    df = rows(spark, data).withColumns({"query": F.lit("Q"), "correlation": F.lit(0.3).cast("double")})
    configs, by = config_table(spark, CONTROLLED), ["config", "query"]
    full, scores = sweep(df, configs, ["query"], True), sweep_scores(df, configs, ["query"], True)
    plain = lambda d: sorted(map(str, d.collect()))
    assert plain(top_with_ties(tie_ranks(leading(scores, by, 3), by, True), 3)) == plain(top_with_ties(full, 3))
    assert leading(scores, by, 3).count() < scores.count() == full.count()
    shown = [*by, "finalScore", "rankMin", "rankMid", "rankMax", "tieSize"]
    assert plain(places(scores, by).select(*shown)) == plain(full.select(*shown).distinct())
    assert plain(compared_scores(df, configs, "A0_team_baseline", ["query"], 3)) == plain(compared(full, "A0_team_baseline", ["query"], 3))
    labels = df.select("query", "DepMap_ID", F.when(F.col("rnaExpr") > 18, "positive").otherwise("negative").alias("relation"))
    some = evaluate(scores, labels, by, (3, 5), 5, first_places=True)
    assert plain(some) == plain(evaluate(full, labels, by, (3, 5), 5).select(*some.columns))


def test_leading_rows_are_not_filtered_by_their_whole_score(spark):
    """A filter on the part of a score is pushed below all it comes from, as one expression too long to be compiled."""
    from rankloom.operators.sweeps import leading, sweep_scores

    df = rows(spark, [("ACH-1", "x", 1.0, 2.0, None, 1, 1, 0, True, False, False, True)]).withColumns({"query": F.lit("Q"), "correlation": F.lit(0.3).cast("double")})
    plan = leading(sweep_scores(df, config_table(spark, CONTROLLED), ["query"], True), ["config", "query"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan and not any("FLOOR" in line for line in plan.splitlines() if "Join " in line or "Filter " in line)


def test_comparison_counts_copies(spark):
    """A candidate with copies counts as so many rows, each paired with each."""
    from rankloom.operators.sweeps import compared, compared_scores

    data = [(f"ACH-{i:03}", "x", float(i * 7 % 23), None if i % 4 == 0 else float(i % 5), None, 1, 1, 0, True, i % 2 == 0, False, i % 4 != 0) for i in range(40)]
    data += [("ACH-900", "x", None, 2.0, None, 0, 1, 0, False, False, False, True)]
    df = rows(spark, data).withColumns({"query": F.lit("Q"), "correlation": F.lit(0.3).cast("double"), "copies": F.substring("DepMap_ID", 7, 1).cast("long") % 3 + 1})
    configs = config_table(spark, CONTROLLED)
    repeated = df.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("nth", "copies")
    got, want = ({r["config"]: r.asDict() for r in d.collect()} for d in (compared_scores(df, configs, "A0_team_baseline", ["query"], 9), compared(sweep(repeated, configs, ["query"], True), "A0_team_baseline", ["query"], 9)))
    assert len(got) == len(CONTROLLED) and got.keys() == want.keys()
    for config, row in want.items():
        assert got[config] == {c: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for c, v in row.items()}
