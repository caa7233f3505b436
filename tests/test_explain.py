"""Cards, claims and their grounding; labels and panels."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators.explain import alternatives, fingerprint, masked, merged_alternatives, merged_trace, numbers_in, reasons, verify
from rankloom.operators.panels import percentile_rank, stratum
from rankloom.operators.reviews import assert_blinded

CARD = "evidence_id string, card_type string, text string, source string, DepMap_ID string, cellLine string, target string, values array<double>"
CLAIM = "position int, text string, claim_type string, evidence_ids array<string>"


@pytest.fixture
def cards(spark):
    return spark.createDataFrame([("known", "RANKING", "t", "s", "ACH-000001", "HCS2", "gene EGFR", [0.91]), ("other", "RANKING", "t", "s", "ACH-000002", "CASKI", "gene EGFR", [0.88])], CARD)


@pytest.mark.parametrize(
    ("text", "ids", "mode", "layer"),
    [
        ("Score is 0.91.", ["invented"], "l1l2", "L1_citation"),
        ("Score is 7.30.", ["known"], "l1l2", "L2_numeric"),
        ("HCS2 (ACH-000001) scores 0.91 in log2(TPM+1).", ["known"], "l1l2", None),
        ("No citation.", [], "l1l2", "L1_citation"),
        ("CASKI is better.", ["known"], "full", "L3_entity"),
        ("HCS2 is good.", ["known"], "full", None),
        ("Score is 7.30.", ["invented"], "none", None),
    ],
)
def test_verdicts(spark, cards, text, ids, mode, layer):
    claims = spark.createDataFrame([(1, text, "SUPPORT", ids)], CLAIM)
    row = verify(claims, cards, mode).first()
    assert (row["failed_layer"], row["ok"]) == (layer, layer is None)


def test_numbers_and_masks(spark):
    df = spark.createDataFrame([("A1 has -2.5, +3 and B-4; C.x (9)", ["c.X", "b"])], "t string, n array<string>")
    assert df.select(numbers_in(F.col("t"))).first()[0] == [-2.5, 3.0, 4.0, 9.0] or df.select(numbers_in(F.col("t"))).first()[0] == [-2.5, 3.0, -4.0, 9.0]
    assert df.select(masked(F.col("t"), F.col("n"))).first()[0] == "A1 has -2.5, +3 and  -4;   (9)"


def test_fingerprint_follows_the_ranking_only(spark):
    schema = "rank int, DepMap_ID string, cellLine string, finalScore double, confidenceScore double, recommendationLevel string, more int"
    a = spark.createDataFrame([(1, "x", "X", 0.9, 0.5, "R", 1), (2, "y", "Y", 0.8, 0.5, "R", 2)], schema)
    same = fingerprint(a.orderBy(F.desc("rank")).withColumn("more", F.lit(0))).first()
    assert same == fingerprint(a).first() and fingerprint(a.withColumn("finalScore", F.lit(0.7))).first() != same


def test_reasons(spark):
    df = spark.createDataFrame([(0.75, None, "FUSION", 0.2)], "rnaScore double, proteinScore double, alterationStatus string, exclusionPenalty double")
    said = df.select(reasons("GENE_MULTIOMICS", "G", None, "E", None)).first()[0]
    assert len(said) == 5 and said[1] == "Strong RNA expression evidence for G." and said[0].startswith("The cell line was ranked across")


def test_strata(spark):
    rows = [(3, 20, 0.6, 20), (3, 20, 0.1, 20), (3, 20, 0.3, None), (3, 20, None, 20), (3, 20, 0.6, 5), (2, 3, None, 0), (1, 3, None, 0), (0, 3, None, 0), (1, 20, 0.6, 20)]
    df = spark.createDataFrame(rows, "rna_sources int, protein_n int, correlation double, correlation_n int")
    expected = ["protein_corr_high", "protein_corr_low", "protein_corr_mid", "protein_no_reliable_corr", "protein_no_reliable_corr", "multisource_rna_no_protein", "depmap_rna_only", "not_selected_pool", "not_selected_pool"]
    assert [r[0] for r in df.select(stratum()).collect()] == expected


def test_percentile_rank(spark):
    df = spark.createDataFrame([("q", 1.0), ("q", 2.0), ("q", 2.0), ("q", None)], "q string, v double")
    out = sorted(r[0] or 0 for r in df.select(percentile_rank("v", ["q"])).collect())
    assert out == pytest.approx([0, 1 / 3, 5 / 6, 5 / 6])


def test_review_sheets_tell_nothing(spark):
    good = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, DepMap_ID string")
    assert_blinded(good)
    with pytest.raises(ValueError):
        assert_blinded(good.withColumn("min_rank", F.lit(1)))
    with pytest.raises(ValueError):
        assert_blinded(good.union(good))


SCORED = "DepMap_ID string, cellLine string, rank long, finalScore double, confidenceScore double, recommendationLevel string, rnaScore double, proteinScore double, biologicalScore double, exclusionPenalty double, completenessScore double, sourceSupportScore double, targetGeneLabel string, depmapRnaRaw double, hpaRnaRaw double, geoRnaRaw double, proteinRaw double, mutationRaw double, fusionRaw double, fusionConfidenceRaw double, hasMutation boolean, hasHighImpactMutation boolean, hasFusion boolean, hasDepMapRNA boolean, hasHpaRNA boolean, hasGeoRNA boolean, hasProteomics boolean"


def short_list(spark, *ids):
    rows = [(i, f"Line{n}", n, 1.0 - n / 10, 0.5, "Recommended", 0.9 - n / 10, None, 0.5, 0.0, 0.5, 0.25, "G", 1.5, None, None, None, 2.0, None, None, True, False, False, True, False, False, False) for n, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, SCORED)


def context_of(spark, rows, signatures):
    from rankloom.operators.lookups import entity_context

    tops = spark.createDataFrame([("ACH-1", [("m", 2.0)])], "DepMap_ID string, top array<struct<feature:string,value:double>>")
    return entity_context(rows.select("DepMap_ID"), signatures, tops, tops.limit(0))


def test_contexts_show_what_there_is(spark):
    nan = float("nan")
    signatures = spark.createDataFrame([("ACH-1", 1.5, nan, 3), ("ACH-2", None, nan, None)], "DepMap_ID string, CIN double, Ploidy double, WGD int")
    rows = {r["DepMap_ID"]: r for r in context_of(spark, short_list(spark, "ACH-1", "ACH-2", "ACH-3"), signatures).collect()}
    assert rows["ACH-1"]["global_signatures"] == {"CIN": 1.5, "WGD": 3.0} and rows["ACH-2"]["global_signatures"] == {} == rows["ACH-3"]["global_signatures"]
    assert [x["feature"] for x in rows["ACH-1"]["top_mirna"]] == ["m"] and rows["ACH-3"]["top_mirna"] == []
    assert [len(rows[i]["notes"]) for i in ("ACH-1", "ACH-2", "ACH-3")] == [1, 2, 3] and "File 14" in rows["ACH-3"]["notes"][0]


def test_supplementary_cards_and_details_of_a_saved_run(spark, tmp_path):
    from rankloom.operators.explain import cards, explain_run, run_detail
    from rankloom.sources.sinks import load_run, save_run

    ranked = short_list(spark, "ACH-1", "ACH-2")
    context = context_of(spark, ranked, spark.createDataFrame([("ACH-1", 1.5)], "DepMap_ID string, CIN double"))
    made = [c for c in cards(ranked, "GENE_MULTIOMICS", "G", None, context).collect() if c["card_type"] == "SUPPLEMENTARY"]
    assert [(c["text"], c["source"], list(c["values"])) for c in made] == [("Supplementary global signatures are available for Line1; they are context only and were not used in scoring.", "File 14", [1.5])]
    bare = context_of(spark, ranked, spark.createDataFrame([("ACH-2", 1.5)], "DepMap_ID string, CIN double"))
    assert cards(ranked, "GENE_MULTIOMICS", "G", None, bare).where("card_type = 'SUPPLEMENTARY'").count() == 0

    save_run(ranked, str(tmp_path), "run")
    read = lambda: load_run(spark, str(tmp_path), "run", ranked.schema)
    detail = run_detail(read(), 2, "GENE_MULTIOMICS", "G", context).first()
    assert detail["candidate"]["cellLine"] == "Line2" and [t["dataset"] for t in detail["evidence_trace"]] == ["DepMap_RNAseq", "DepMap_Mutation"]
    assert detail["supplementary"]["global_signatures"] == {} and len(detail["data_gaps"]) == 3 and '"note"' in detail["weights"]
    with pytest.raises(LookupError, match="rank 9"):
        run_detail(read(), 9, "GENE_MULTIOMICS", "G", context)

    claims, prints = explain_run(read(), "GENE_MULTIOMICS", "G", None, context=context, reread=read)
    assert prints.first()["unchanged"] and {r["claim_type"] for r in claims.collect()} == {"SUPPORT", "LIMITATION", "ALTERNATIVE", "CONTEXT"}
    assert prints.first()["fingerprint"] == detail["ranking_fingerprint"]
    # A list that isn't what it was when the writer began is noticed.
    changed = ranked.withColumn("finalScore", F.col("finalScore") + F.when(F.col("rank") == 2, 0.01).otherwise(0.0))
    assert not explain_run(read(), "GENE_MULTIOMICS", "G", None, reread=lambda: changed)[1].first()["unchanged"]


SEEN = "DepMap_ID string, rank long, cellLine string, lineage string, disease string, rnaScore double, proteinScore double, finalScore double, targetGeneLabel string"


def test_merged_alternatives_keep_the_order_of_ranks(spark):
    rows = [("A", 1, "a", "l", "d", 0.5, None, 0.9, "G"), ("Z", 2, "z", "l", "d", 0.4, 0.1, 0.8, "G"), ("B", 3, "b", None, None, 0.6, None, 0.8, "G"), ("C", 4, "c", "l", "d", None, 0.7, 0.7, "G")]
    df = spark.createDataFrame(rows, SEEN)
    got = [(r["DepMap_ID"], r["similarityScore"], r["lineage"]) for r in merged_alternatives(df).collect()]
    assert got == [("Z", 0.9, "l"), ("B", 0.9, None), ("C", 0.0, "l")]
    assert [r["DepMap_ID"] for r in alternatives(df, 2).collect()] == ["B", "Z"] and merged_alternatives(df.where("rank = 1")).count() == 0


def test_merged_trace_names_no_role(spark):
    schema = "depmapRnaRaw double, hpaRnaRaw double, geoRnaRaw double, proteinRaw double, hasMutation boolean, hasHighImpactMutation boolean, mutationRaw double, hasFusion boolean, fusionRaw double, fusionConfidenceRaw double"
    df = spark.createDataFrame([(1.0, None, 2.0, 3.0, True, True, 4.0, True, 1.0, None), (None, None, None, None, False, False, None, False, None, 3.0), (None, 0.0, None, None, True, False, 1.0, True, 2.0, 3.0)], schema)
    got = [[(t["dataset"], t["type"], t["value"]) for t in r[0]] for r in df.select(merged_trace()).collect()]
    assert got == [
        [("DepMap_RNAseq", "rna_expression", 1.0), ("GEO_RNA", "rna_expression", 2.0), ("CCLE_Gygi_Proteomics", "protein_expression", 3.0), ("DepMap_Mutation", "high_impact_mutation", 4.0), ("DepMap_Fusion", "fusion", 1.0)],
        [],
        [("HPA_RNAseq", "rna_expression", 0.0), ("DepMap_Mutation", "mutation", 1.0), ("DepMap_Fusion", "fusion", 2.0), ("DepMap_Fusion", "fusion_confidence", 3.0)],
    ]
    assert {t["unit"] for t in df.select(merged_trace()).first()[0]} == {"log2(TPM+1)", "log2(intensity+1)", "log2 MS intensity", "event count", "event evidence"}
