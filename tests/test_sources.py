"""Readers, adapters, resolvers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scalar as S
from rankloom.functions.contexts import clean_request, context_aliases, query_mode
from rankloom.functions.headers import find_column, match_feature, require_columns
from rankloom.operators.evidence import long_table, standardise
from rankloom.operators.scoring import ScoringConfig
from rankloom.plans.recommend import EvidenceStore
from rankloom.sources import adapters, files, sinks
from rankloom.sources.resolve import duplicated, entity_map, first_per_key, last_per_key, name_map, resolve_names, symbol_maps


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def bridge(spark):
    return spark.createDataFrame([("PR-1", "ACH-000001"), ("PR-2", "ACH-000002")], "profile string, entity string")


@pytest.fixture
def registry(spark):
    names = spark.createDataFrame([("LINEA", "CVCL_1"), ("LINEB", "CVCL_2")], "name_key string, accession string")
    entities = spark.createDataFrame([("CVCL_1", "ACH-000001"), ("CVCL_2", "ACH-000002")], "accession string, entity string")
    return names, entities


def test_rna_matrix(spark, tmp_path, bridge):
    path = write(tmp_path / "m.csv", ",TP53 (ENSG00000141510),EGFR (ENSG00000146648)\nPR-1,1.5,NaN\nPR-2,,2.5\nPR-9,9,9\n")
    rows = adapters.rna_matrix(spark, path, bridge).select("DepMap_ID", "gene_symbol", "ensembl_id", "value_raw", "source")
    assert got(rows) == [("ACH-000001", "TP53", "ENSG00000141510", 1.5, "depmap_rna"), ("ACH-000002", "EGFR", "ENSG00000146648", 2.5, "depmap_rna")]
    assert adapters.rna_matrix(spark, path, bridge, ["egfr"]).count() == 1
    assert adapters.rna_matrix(spark, path, bridge, ["none"]).count() == 0


def test_protein_matrix_keeps_nulls(spark, tmp_path):
    path = write(tmp_path / "p.csv", "id,P04637 (TP53)\nACH-000001,\nACH-000002,3.25\n")
    assert got(adapters.protein_matrix(spark, path).select("DepMap_ID", "gene_symbol", "value_raw")) == [("ACH-000001", "TP53", None), ("ACH-000002", "TP53", 3.25)]


def test_gct(spark, tmp_path):
    path = write(tmp_path / "m.gct", "#1.2\n2\t2\nName\tDescription\tA_X\tB_X\nmir1\td\t1\t2\nmir2\td\tNA\t4\n")
    assert got(files.read_gct(spark, path)) == [("mir1", "A_X", 1.0), ("mir1", "B_X", 2.0), ("mir2", "A_X", None), ("mir2", "B_X", 4.0)]


def test_long_rna(spark, tmp_path, registry):
    path = write(tmp_path / "h.tsv", "Gene\tGene name\tCell line\tnTPM\nENSG1.2\tTP53\tline a\t3\nENSG1.2\tTP53\tLine-B\t-1\nENSG2\tEGFR\tnobody\t1\n")
    described = spark.createDataFrame([("line a", "CVCL_2")], "name string, accession string")
    rows = adapters.rna_long(spark, path, described, *registry, features=["TP53"]).select("DepMap_ID", "ensembl_id", "value_raw")
    assert got(rows) == [("ACH-000002", "ENSG1", 0.0), ("ACH-000002", "ENSG1", 2.0)]


def test_sample_matrix(spark, tmp_path):
    path = write(tmp_path / "g.csv", "gene,GSM1,GSM2,GSM3\nENSG1.4,1,3,5\nEGFR,7,,1\n")
    samples = spark.createDataFrame([("GSM1", "ACH-000001"), ("GSM2", "ACH-000002")], "sample string, entity string")
    symbols = spark.createDataFrame([("ENSG1", "TP53")], "ensembl string, symbol string")
    rows = adapters.rna_samples(spark, path, samples, symbols).select("DepMap_ID", "gene_symbol", "value_raw")
    assert got(rows) == [("ACH-000001", "EGFR", 3.0), ("ACH-000001", "TP53", 1.0), ("ACH-000002", "TP53", 2.0)]


def test_event_files(spark, tmp_path, bridge):
    path = write(tmp_path / "e.csv", "ProfileID,HugoSymbol,LikelyLoF,VepImpact\nPR-1,tp53,False,LOW\nPR-1,TP53,true,LOW\nPR-2,TP53,,MODERATE\nPR-8,TP53,,HIGH\n")
    count, high = adapters.mutations(spark, path, bridge)
    assert got(count.select("DepMap_ID", "value_raw")) == [("ACH-000001", 2.0), ("ACH-000002", 1.0)]
    assert got(high.select("DepMap_ID", "value_raw")) == [("ACH-000001", 1.0), ("ACH-000002", 0.0)]
    path = write(tmp_path / "f.csv", "ModelID,Gene1,Gene2,confidence\nACH-000001,DLG1 (ENSG00000075711.21),BCL6,high\nACH-000001,DLG1 (ENSG00000075711.21),AAA,low\n")
    count, best = adapters.fusions(spark, path, ["DLG1", "BCL6"])
    assert got(count.select("gene_symbol", "value_raw")) == [("BCL6", 1.0), ("DLG1", 2.0)] and got(best.select("gene_symbol", "value_raw")) == [("BCL6", 3.0), ("DLG1", 3.0)]


def test_encodings_and_missing_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("name,note\nA,caf\xe9\n".encode("windows-1252"))
    assert got(files.read_table_any_encoding(spark, str(tmp_path / "x.csv"), {"note": ["note"]})) == [("café",)]
    with pytest.raises(KeyError):
        files.read_table(spark, str(tmp_path / "x.csv"), {"z": ["absent"]})


def test_resolvers(spark):
    reg = spark.createDataFrame([(0, "CVCL_1", "Line-A", "shared||LA"), (1, "CVCL_2", "Line B", "Shared; LB"), (2, "CVCL_3", None, None)], "nth int, accession string, name string, synonyms string")
    names = name_map(reg)
    assert dict(got(names)) == {"LINEA": "CVCL_1", "LINEB": "CVCL_2", "SHARED": "CVCL_1", "LA": "CVCL_1", "LB": "CVCL_2"}
    first = spark.createDataFrame([(0, "CVCL_1", "ACH-000009"), (1, "CVCL_2", None)], "nth int, accession string, entity string")
    second = spark.createDataFrame([(0, "CVCL_1", "ACH-000001"), (1, "CVCL_2", "ACH-000002")], "nth int, accession string, entity string")
    entities = entity_map(first, second)
    assert dict(got(entities)) == {"CVCL_1": "ACH-000009", "CVCL_2": "ACH-000002"}
    asked = spark.createDataFrame([("l a",), ("line b",), ("ACH-000777",), ("x",), (None,)], "n string")
    assert got(resolve_names(asked, "n", names, entities).select("n", "entity")) == got(spark.createDataFrame([("l a", "ACH-000009"), ("line b", "ACH-000002"), ("ACH-000777", "ACH-000777"), ("x", None), (None, None)], "n string, e string"))
    pairs = spark.createDataFrame([(0, "a", 1), (1, "a", 2)], "o int, k string, v int")
    assert got(first_per_key(pairs, "k", "v", F.col("o"))) == [("a", 1)] and got(last_per_key(pairs, "k", "v", F.col("o"))) == [("a", 2)]
    genes = spark.createDataFrame([(0, "ENSG1.3", "tp53"), (1, "ENSG1.4", "P53"), (2, "ENSG2", "TP53")], "nth int, ensembl string, symbol string")
    forward, back = symbol_maps(genes)
    assert dict(got(forward)) == {"ENSG1": "TP53", "ENSG2": "TP53"} and dict(got(back)) == {"TP53": "ENSG1", "P53": "ENSG1"}
    assert got(duplicated(pairs, "k")) == [("a", 2)]


def test_headers():
    assert find_column(["Cell Line", "Cell line name"], ["cell line"]) == "Cell Line"
    assert find_column(["my_cell_line_x"], ["cell line"]) == "my_cell_line_x" and find_column(["a"], ["b"], required=False) is None
    assert match_feature(["XTP53", "TP53 (7157)", "A TP53"], "tp53") == "TP53 (7157)" and match_feature(["A-TP53-B"], "TP53") == "A-TP53-B"
    with pytest.raises(ValueError):
        require_columns(["a"], ["a", "b"])


def test_contexts():
    assert "nsclc" in context_aliases("lung cancer") and context_aliases("cancer") == ["cancer"]
    assert context_aliases("NSCLC")[:2] == ["nsclc", "lung"] and "stomach" in context_aliases("gastric") and context_aliases("gastric", merged=True) == ["gastric"]
    assert context_aliases("", merged=True) == []
    with pytest.raises(ValueError):
        context_aliases(" ")
    assert [query_mode("a", None), query_mode(None, "b"), query_mode("a", "b")] == ["GENE_MULTIOMICS", "PROTEIN_ONLY", "COMBINED"]
    assert clean_request({"target_protein": "her2", "disease": "breast", "top_n": "5"})["target_protein"] == "ERBB2"
    for bad in ({"disease": "x"}, {"target_gene": "a b", "disease": "x"}, {"target_gene": "a", "disease": ""}, {"target_gene": "a", "disease": "x", "top_n": 51}, {"target_gene": "a", "disease": "x", "top_n": "n"}):
        with pytest.raises(ValueError):
            clean_request(bad)


def test_null_and_nan_rules(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.5,)], "x double")
    out = df.select(S.clip01(S.finite(F.col("x"))), S.safe_double(F.col("x"), 7.0), S.log2_plus_one(S.finite(F.col("x"))))
    assert got(out) == got(spark.createDataFrame([(None, 7.0, None)] * 3 + [(1.0, 1.5, 1.3219280948873624)], "a double, b double, c double"))


def test_store_and_request(spark):
    one = lambda e, g, s, v: (e, g, None, {"depmap_rna": "rna"}.get(s, "protein"), v, "u", s, "1")
    schema = "DepMap_ID string, gene_symbol string, ensembl_id string, omics_layer string, value_raw double, value_unit string, source string, source_version string"
    long = standardise(long_table([spark.createDataFrame([one("ACH-1", "X", "depmap_rna", 1.0), one("ACH-1", "X", "depmap_rna", 3.0), one("ACH-2", "X", "depmap_rna", 8.0), one("ACH-2", "X", "ccle_gygi_protein", 1.0)], schema)]))
    spine = spark.createDataFrame([("ACH-1",), ("ACH-2",), ("ACH-3",)], "DepMap_ID string")
    notes = spark.createDataFrame([("ACH-1", "Lung Cancer", "lung", " A "), ("ACH-2", "Lung", None, None)], "DepMap_ID string, primary_disease string, lineage string, cell_line_name string")
    store = EvidenceStore(long, spine, notes)
    rows = store.recommend({"target_gene": "x", "disease": "lung"}).collect()
    assert [(r["rank"], r["DepMap_ID"], r["cellLine"]) for r in rows] == [(1, "ACH-2", "ACH-2"), (2, "ACH-1", "A")]
    assert store.recommend({"target_gene": "x", "disease": "skin"}).count() == 0
    with pytest.raises(LookupError):
        store.recommend({"target_gene": "y", "disease": "lung"})
    with pytest.raises(LookupError):
        store.recommend({"target_protein": "y", "disease": "lung"})
    assert store.long.where("source = 'ccle_gygi_protein'").first()["value_std"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", float("nan")), (1, "a", 0.5)], "rank int, id string, x double")
    assert sinks.save_ranked(df, str(tmp_path / "r"), ["rank", "id"]) and not sinks.save_ranked(df.where("rank > 9"), str(tmp_path / "e"), ["id"])
    text = next((tmp_path / "r").glob("part-*")).read_text(encoding="utf-8")
    assert text == "﻿rank,id\n1,a\n2,b\n" and not (tmp_path / "e").exists()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.save_ranked(df, str(tmp_path / "r"), ["rank"])
    doc = json.loads(sinks.payload(F.lit("q"), df, ["id", "x"]).first()["value"])
    assert doc == {"schemaVersion": "1.0", "query": "q", "nResults": 2, "results": [{"id": "a", "x": 0.5}, {"id": "b", "x": None}]}
    cache = spark.createDataFrame([("g1", 1), ("g2", 2)], "gene_symbol string, v int")
    sinks.cache_features(cache, str(tmp_path / "c"))
    sinks.cache_features(cache.where("gene_symbol = 'g1'").withColumn("v", F.lit(5)), str(tmp_path / "c"))
    assert got(sinks.cached_features(spark, str(tmp_path / "c"), ["g1", "g2"]).select("gene_symbol", "v")) == [("g1", 5), ("g2", 2)]
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.txt", "1\n2\n")
    assert got(sinks.file_manifest(spark, str(tmp_path / "d")).select("name", "bytes", "lines")) == [("a.txt", 4, 2)]
    write(tmp_path / "cfg.json", json.dumps({"name": "n", "max_exclusion_penalty": 0.1}))
    assert files.load_config(str(tmp_path / "cfg.json"), ScoringConfig).max_exclusion_penalty == 0.1
    write(tmp_path / "cfg.json", json.dumps({"nme": 1}))
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "cfg.json"), ScoringConfig)


@pytest.mark.parametrize("name", ["resolve_accessions", "resolve_names"])
def test_accessions_of_many_entities_are_whole(spark, tmp_path, name):
    """Keys of more than five digits don't get the accession of a shorter one, and every row asked for is there once."""
    import duckdb

    from rankloom.queries import ORACLE_SQL, QUERIES

    keys = [10000, 10001, 100001, 100003, 100014, 120000, 120002]
    tables = {
        "customer": (spark.createDataFrame([(k, f"Customer#{k:09}") for k in keys], "c_custkey long, c_name string")),
        "supplier": (spark.createDataFrame([(5000,), (5007,), (60000,), (60001,)], "s_suppkey long")),
        "orders": (spark.createDataFrame([(i * 5 + j, k) for i, k in enumerate(keys) for j in range(5)], "o_orderkey long, o_custkey long")),
    }
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(con.sql(ORACLE_SQL[name]).fetchall(), key=key)
    assert len(rows) == tables["supplier" if name == "resolve_accessions" else "orders"].count()
    if name == "resolve_accessions":
        assert dict(rows)[60000] == "ACH-120000" and dict(rows)[60001] == "ACH-120003" and dict(rows)[5000] is None
