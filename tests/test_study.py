"""Lookups, saved runs and study checks against hand-made cases."""

import hashlib
import json
from statistics import mean

import pytest
from pyspark.sql import functions as F

from rankloom.functions.contexts import clean_request
from rankloom.functions.scalar import candidate_key
from rankloom.operators import checks, lookups
from rankloom.operators.explain import normal_claims
from rankloom.operators.metrics import bootstrap
from rankloom.operators.panels import largest_n
from rankloom.operators.scoring import ranks, weights_payload
from rankloom.operators.sweeps import renormalised
from rankloom.plans.recommend import EvidenceStore
from rankloom.sources import sinks

LONG = "DepMap_ID string, gene_symbol string, source string, value_raw double"


def mulberry32(seed):
    """The generator step by step, as it is published."""
    while True:
        seed = (seed + checks.STEP) % checks.WORD
        v = (seed ^ seed >> 15) * (seed | 1) % checks.WORD
        v = (v + (v ^ v >> 7) * (v | 61)) % checks.WORD ^ v
        yield (v ^ v >> 14) / checks.WORD


def seed_of(base, label):
    return base ^ int(hashlib.sha256(label.encode()).hexdigest()[:8], 16)


def quantile(values, q):
    values, at = sorted(values), q * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_draws_are_those_of_the_generator(spark):
    seeds = [0, 1, 4294967295, 123456789]
    rows = spark.createDataFrame([(s, n) for s in seeds for n in range(1, 30)], "s long, n long")
    got = {(r["s"], r["n"]): r["x"] for r in rows.withColumn("x", checks.nth_draw(F.col("s"), F.col("n"))).collect()}
    for s in seeds:
        draws = mulberry32(s)
        assert [got[s, n] for n in range(1, 30)] == [next(draws) for _ in range(1, 30)]


def test_paired_bootstrap_is_that_of_the_generator(spark):
    rows = {"c1": [0.5, -0.25, 0.125, 0.0], "zero": [0.0, 0.0, 1e-13, 0.0]}
    df = spark.createDataFrame([(c, f"q{i}", d) for c, ds in rows.items() for i, d in enumerate(ds)], "config string, query string, d double")
    got = {r["config"]: r for r in checks.paired_bootstrap(df, "config", "query", "d", 50, 99).collect()}
    draws, d = mulberry32(seed_of(99, "c1")), rows["c1"]
    means = [sum(d[int(next(draws) * 4)] for _ in d) / 4 for _ in range(50)]
    assert got["c1"]["mean_delta"] == mean(d) and got["c1"]["low"] == pytest.approx(quantile(means, 0.025)) and got["c1"]["high"] == pytest.approx(quantile(means, 0.975))
    assert (got["zero"]["low"], got["zero"]["high"]) == (0, 0)


def test_hashed_bootstrap_resamples_units(spark):
    """Means of resampled differences, against draws by hand."""
    d = [0.5, -0.25, 0.125]
    rows = [("base", f"q{i}", 0.0) for i in range(3)] + [("c", f"q{i}", x) for i, x in enumerate(d)]
    out = {r["config"]: r for r in bootstrap(spark.createDataFrame(rows, "config string, query string, m double"), "base", "m", "query", 40, 7).collect()}
    slots = spark.range(1, 41).select(*(F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("int"), F.lit(s)), F.lit(3)).alias(f"s{s}") for s in (1, 2, 3))).collect()
    means = [sum(d[x] for x in r) / 3 for r in slots]
    assert (out["c"]["low"], out["c"]["high"]) == (pytest.approx(quantile(means, 0.025)), pytest.approx(quantile(means, 0.975)))
    assert out["c"]["mean_delta"] == pytest.approx(mean(d)) and out["base"]["high"] == 0


def test_ranks_in_parts(spark):
    rows = [(q, f"ACH-{i:03}", s, c) for q in ("x", None) for i, (s, c) in enumerate([(0.5, 0.1), (0.9, 0.2), (0.5, 0.3), (None, 0.1), (0.9, 0.2), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "query string, DepMap_ID string, finalScore double, confidenceScore double")
    order = [F.desc("finalScore"), F.desc("confidenceScore"), F.asc("DepMap_ID")]
    for by in ([], ["query"]):
        got = {(r["query"], r["DepMap_ID"]): r["rank"] for r in ranks(df, by, order).collect()}
        expected = {}
        for q in ([None] if not by else ["x", None]):
            mine = sorted((r for r in rows if not by or r[0] == q), key=lambda r: (r[2] is None, -(r[2] or 0), -r[3], r[1]))
            expected |= {(r[0], r[1]): i + 1 for i, r in enumerate(mine)}
        if by:
            assert got == expected
        else:
            assert sorted(got.values()) == list(range(1, 13))
    assert ranks(df.limit(0), [], order).count() == 0


def test_lookups(spark):
    long = spark.createDataFrame([("A", "X1", "rna", 1.0), ("B", "X1", "rna", None), ("A", "Y", "protein", 2.0)], LONG)
    assert {tuple(r) for r in lookups.feature_values(long, "x1", "rna").collect()} == {("A", 1.0), ("B", None)}
    with pytest.raises(KeyError):
        lookups.feature_values(long, "y", "rna")
    assert {r[0] for r in lookups.feature_names(long).collect()} == {"X1", "Y"}
    events = spark.createDataFrame([("A", "x1", "lost"), ("A", "X1", None), ("B", "Y", None)], "DepMap_ID string, symbol string, lof string")
    assert sorted(tuple(r) for r in lookups.event_records(events, "X1", "symbol", ["DepMap_ID"], "lof").collect()) == [("A", False), ("A", True)]
    spine = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "DepMap_ID string")
    rna = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "DepMap_ID string, value double")
    protein = spark.createDataFrame([("C", 5.0)], "DepMap_ID string, value double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "DepMap_ID string")
    got = [tuple(r) for r in lookups.feature_profile(spine, rna, protein, ids("A", "A"), ids("C"), ids("B", "D")).collect()]
    assert got == [("B", 3.0, None, False, False, True), ("A", 1.0, None, True, False, False), ("C", None, 5.0, False, True, False)]
    top = spark.createDataFrame([("A", [("m", 1.5)])], "DepMap_ID string, top array<struct<feature:string,value:double>>")
    rows = lookups.supplementary(ids("A", "B"), {"metabolites": top}).withColumn("text", lookups.context_text("DepMap_ID", "metabolites"))
    assert {r["DepMap_ID"]: json.loads(r["text"]) for r in rows.collect()} == {"A": {"DepMap_ID": "A", "metabolites": [{"feature": "m", "value": 1.5}]}, "B": {"DepMap_ID": "B", "metabolites": []}}


def test_saved_runs(spark, tmp_path):
    run = spark.createDataFrame([("A", 1, 0.5), ("B", 2, float("nan"))], "DepMap_ID string, rank long, finalScore double")
    sinks.save_run(run, str(tmp_path), "run_1")
    back = sinks.load_run(spark, str(tmp_path), "run_1")
    assert [(r["DepMap_ID"], r["finalScore"]) for r in sinks.candidate_detail(back, 2).collect()] == [("B", None)]
    context = spark.createDataFrame([("A", "c")], "DepMap_ID string, context string")
    assert sinks.candidate_detail(back, 1, context).first()["context"] == "c" and sinks.candidate_detail(back, 9).isEmpty()
    with pytest.raises(ValueError):
        sinks.load_run(spark, str(tmp_path), "../x")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.save_run(run, str(tmp_path), "run_1")


def test_checks(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-13), ("y", None), ("w", 2.0)], "k string, v double")
    assert tuple(checks.parity(a, b, ["k"], ["v"], 1e-12).first()) == (1, 1, 0) and checks.parity(a, b, ["k"], ["v"]).first()["different"] == 1
    bad = spark.createDataFrame([("x", 1.0), ("x", float("inf")), ("y", None)], "k string, v double")
    sound = checks.unique_finite(bad, ["k"], ["v"])
    assert tuple(sound.first()) == (3, 1, 2)
    assert tuple(checks.check_row("s", "c", sound, "n_repeated").first()) == ("s", "c", "FAIL", 1, 0)
    ranked = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2), ("q", "c", 0.5 - 1e-13, 3), ("q", "d", 0.4, 4), ("p", "a", 0.1, 1)], "query string, DepMap_ID string, finalScore double, rank int")
    assert {tuple(r)[:2] for r in checks.top_with_tolerance(ranked, ["query"], 2).collect()} == {("q", "a"), ("q", "b"), ("q", "c"), ("p", "a")}


def test_requests_weights_and_claims(spark):
    with pytest.raises(ValueError):
        clean_request({"target_gene": "A#B", "disease": "x"})
    assert clean_request({"target_gene": "a", "context": " lung "}) == {"target_gene": "A", "target_protein": None, "exclusion_gene": None, "context": "lung", "top_n": 10}
    assert {k: v for k, v in weights_payload("PROTEIN_ONLY").items() if k != "note"} == {"rna": 0.0, "protein": 0.85, "confidence": 0.15, "exclusion_penalty_max": 0.3} and weights_payload("COMBINED")["rna"] == 0.55
    assert "only directly scored" in weights_payload("PROTEIN_ONLY")["note"] and "redistributed" in weights_payload("GENE_MULTIOMICS")["note"]
    for blank in (None, ""):
        with pytest.raises(ValueError, match="integer"):
            clean_request({"target_gene": "a", "disease": "lung", "top_n": blank})
    claims = spark.createDataFrame([(" t ", " gap", ["e", None]), (None, None, None)], "text string, claim_type string, evidence_ids array<string>")
    assert [tuple(r) for r in normal_claims(claims).collect()] == [("t", "GAP", ["e"]), ("", "SUPPORT", [])]
    long = spark.createDataFrame([], "DepMap_ID string, gene_symbol string, ensembl_id string, omics_layer string, value_raw double, value_unit string, source string, source_version string")
    twice = spark.createDataFrame([("A", "d", "l"), ("A", "d", "l")], "DepMap_ID string, primary_disease string, lineage string")
    # Repeated annotations are no error any more (test_curation: they don't multiply candidates).
    with pytest.raises(LookupError, match="no evidence"):
        EvidenceStore(long, twice.select("DepMap_ID"), twice).recommend({"target_gene": "x", "disease": "d"})


def test_small_helpers(spark):
    rows = spark.createDataFrame([("x", 0.1, 5), ("x", 0.3, 9), ("x", 0.2, 9), ("y", None, None)], "feature string, correlation double, n int")
    assert {tuple(r) for r in largest_n(rows).collect()} == {("x", 0.3, 9), ("y", None, None)}
    one = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    assert tuple(one.select(*renormalised(F.col("a"), F.col("b"))).first()) == (0.25, 0.75)
    assert tuple(one.select(*renormalised(F.col("a") * 0, F.col("b") * 0)).first()) == (None, None)
    keys = spark.createDataFrame([(" ach-000001 ", "n"), (None, "Hela S-3"), ("", "a b")], "e string, n string").select(candidate_key(F.col("e"), F.col("n"))).collect()
    assert keys[0][0] == "ACH-000001" and all(k[0].startswith("NAME:") for k in keys[1:])
