"""Labels by name, rules, digests, stacked tables, panels, annotations and matrices against hand-made cases."""

import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankloom.functions.headers import exact_column
from rankloom.functions.scalar import list_texts, rounded_epsilon, symbol_in_last_parens
from rankloom.operators import rules
from rankloom.operators.detect import containing, detect, pieces_like, ranged_ranks
from rankloom.operators.evidence import packed, panel_rows, stacked
from rankloom.operators.reviews import known_rows
from rankloom.operators.scoring import prepared_annotations
from rankloom.plans.recommend import EvidenceStore
from rankloom.sources import digests, sinks
from rankloom.sources.files import read_matrix_of
from rankloom.sources.sinks import EXPORTED, read_export, save_export

LABELS = "query string, DepMap_ID string, name string, relation string"


def test_ranks_in_ranges_against_sorting(spark):
    rows = [(q, f"E{i:04}", float((i * 37) % 100 // (1 + i % 3))) for q in ("a", "b") for i in range(700 if q == "a" else 3)]
    got = {(r["q"], r["id"]): (r["rank"], r["n"]) for r in ranged_ranks(spark.createDataFrame(rows, "q string, id string, v double"), ["q"], "v", "id", parts=8).collect()}
    for q in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[q, r[1]] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]


def test_containing_against_all_pairs(spark):
    names = ["hela", "helas3", "mcf7", "mcf10a", "a549", "a", "ab", "bab", "abab"]
    needles = ["hel", "mcf", "a", "ab", "7", "hela", "zzz", "bab", "f1"]
    got = {tuple(r) for r in containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(n, n) for n in names], "DepMap_ID string, name string")).collect()}
    assert got == {(x, n) for x in needles for n in names if x in n}


def test_lookups_of_needles_grow_with_names_only(spark):
    """All names share their three-letter pieces with many needles; what meets is a few rows a name, however many needles there are."""
    names = spark.createDataFrame([(f"ACH-{i}", f"customer{i:09}") for i in range(1000)], "DepMap_ID string, name string")
    for n in (100, 1000):
        needles = spark.createDataFrame([(f"tomer{i:09}",) for i in range(n)] + [(f"{i:03}",) for i in range(n)], "needle string")
        assert pieces_like(needles, names).count() <= 1000 * (4 + 15)
        pairs = containing(needles, names).where("length(needle) > 3").collect()
        assert sorted((r["needle"], r["DepMap_ID"]) for r in pairs) == sorted((f"tomer{i:09}", f"ACH-{i}") for i in range(n))


def test_best_of_many_entities_of_a_needle(spark):
    """Shared names, pieces in all names and needles of another feature, against comparing all pairs."""
    names = [(f"ACH-{i}", f"Line {i % 7}{i % 11:03}") for i in range(120)] + [("ACH-3", "Line other")]
    values = [(q, f"ACH-{i}", float((i * k) % 50)) for q, k in (("G", 37), ("H", 23)) for i in range(0, 120, 2)]
    labels = [(q, None, x, "positive") for q in ("G", "H", "none") for x in ("line 4-004", "000", "LINE", "10", "other", "0" * 30, "e5")]
    rows = detect(spark.createDataFrame(labels, LABELS), spark.createDataFrame(values, "query string, DepMap_ID string, value double"), spark.createDataFrame(names, "DepMap_ID string, name string")).collect()
    norm = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    expected = set()
    for q, _, x, _ in labels:
        order = sorted((r for r in values if r[0] == q), key=lambda r: (-r[2], r[1]))
        place = {r[1]: i + 1 for i, r in enumerate(order)}
        same = [(place[i], i) for i, n in names if i in place and norm(n) == norm(x)]
        part = [(place[i], i) for i, n in names if i in place and norm(x) in norm(n)]
        how = "name" if same else "contained name" if part else None
        expected.add((q.upper(), x, how, *min(same or part or [(None, None)])))
    assert {(r["query"], r["name"], r["match_by"], r["rank"], r["found_id"]) for r in rows} == expected and len(rows) == len(labels)


def test_labels_by_id_name_and_part(spark):
    names = spark.createDataFrame([("ACH-1", "HeLa"), ("ACH-2", "HeLa S3"), ("ACH-3", "MCF-7"), ("ACH-4", "A-549"), ("ACH-5", None)], "DepMap_ID string, name string")
    values = [("G", f"ACH-{i}", v) for i, v in ((1, None), (2, 5.0), (3, 4.0), (4, 3.0), (5, 1.0))]
    labels = [
        ("g ", "ach-3", "whatever", "Positive"),
        ("G", "ACH-1", None, "positive"),
        ("G", "ACH-9", None, "positive"),
        ("G", None, "hela s-3", "positive"),
        ("G", " ", "hela", "positive"),  # HeLa has no value, so the names that contain it count
        ("G", None, "549", "negative"),
        ("G", None, "nothing", "positive"),
        ("G", None, " ", "positive"),
        ("G", None, None, "positive"),
        ("H", None, "hela", "positive"),
        ("G", "ACH-5", None, "negative"),
        ("G", "ACH-5", None, "negative"),
    ]
    rows = detect(spark.createDataFrame(labels, LABELS), spark.createDataFrame(values, "query string, DepMap_ID string, value double"), names).collect()
    got = sorted((r["query"], r["DepMap_ID"] or "", r["name"] or "", r["match_by"] or "", r["status"], r["rank"] or 0, r["found_id"] or "") for r in rows)
    assert got == sorted([
        ("G", "ACH-3", "whatever", "id", "WEAK", 2, "ACH-3"),
        ("G", "ACH-1", "", "id", "VALUE MISSING", 0, ""),
        ("G", "ACH-9", "", "id", "NOT FOUND", 0, ""),
        ("G", "", "hela s-3", "name", "OK", 1, "ACH-2"),
        ("G", "", "hela", "contained name", "OK", 1, "ACH-2"),
        ("G", "", "549", "contained name", "WEAK", 3, "ACH-4"),
        ("G", "", "nothing", "", "NOT FOUND", 0, ""),
        ("G", "", " ", "", "NOT FOUND", 0, ""),
        ("G", "", "", "", "NOT FOUND", 0, ""),
        ("H", "", "hela", "", "NOT IN PANEL", 0, ""),
        ("G", "ACH-5", "", "id", "OK", 4, "ACH-5"),
        ("G", "ACH-5", "", "id", "OK", 4, "ACH-5"),
    ])
    assert detect(spark.createDataFrame([], LABELS), spark.createDataFrame(values, "query string, DepMap_ID string, value double"), names).count() == 0


def found(report):
    return {r["rule"]: (r["n"], r["example"]) for r in report.collect() if r["n"]}


def test_rules_name_the_rows_that_break_them(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", -3), ("d", 5)], "k string, v int")
    report = rules.violations(rows, ["k"], {"positive": F.col("v") > 0, "small": F.col("v") < 100}, totals={"rows": (F.count(F.lit(1)), 5), "sum": (F.sum("v"), 9)})
    assert found(report) == {"positive": (2, "b"), "small": (1, "b"), "repeated key": (1, "a"), "sum": (1, "4 not 9")}
    with pytest.raises(ValueError, match=r"positive \(2\): b"):
        rules.save_checked(rows, report, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    with pytest.raises(Exception, match=r"positive \(2\): b"):
        rules.kept_or_refused(rows, report).collect()
    good = rows.where("k = 'd'")
    fine = rules.violations(good, ["k"], {"positive": F.col("v") > 0})
    assert rules.kept_or_refused(good, fine).collect() == good.collect()
    rules.save_checked(good, fine, str(tmp_path / "yes"))
    assert spark.read.parquet(str(tmp_path / "yes")).collect() == good.collect()
    assert found(rules.violations(rows.limit(0), ["k"], {"positive": F.col("v") > 0}, totals={"rows": (F.count(F.lit(1)), 1)})) == {"rows": (1, "0 not 1")}


POOL = "query string, DepMap_ID string, relation string, verified string, benchmark_role string, source_url string"


def test_development_sets(spark):
    ok = [("g1 ", "ach-000001", "Positive", "YES", " Weight_Tuning", "u"), ("G2", "ACH-000002", "negative", "yes", "weight_tuning", "u"), ("G2", "ACH-000003", "positive", "yes", "weight_tuning", "u"), ("EGFR", "x", "", "yes", "holdout", "")]
    rows = rules.development_rows(spark.createDataFrame(ok, POOL))
    assert found(rules.development_report(rows, 3, 2, 2, 1)) == {}
    assert sorted(map(tuple, rules.development_set(rows).collect())) == [("G1", "ACH-000001", "positive"), ("G2", "ACH-000002", "negative"), ("G2", "ACH-000003", "positive")]
    bad = [*ok[:3], ("egfr", "ACH-000001", "positive", "no", "weight_tuning", ""), ("G3", "ACH-1", "maybe", "yes", "weight_tuning", None), ("G1", "ACH-000001", "positive", "no", "weight_tuning", None)]
    report = rules.development_report(rules.development_rows(spark.createDataFrame(bad, POOL)), 3, 2, 2, 1)
    assert found(report) == {"classic feature": (1, "EGFR|ACH-000001"), "relation": (1, "G3|ACH-1"), "malformed id": (1, "G3|ACH-1"), "no source": (1, "G3|ACH-1"), "repeated key": (1, "G1|ACH-000001"), "rows": (1, "4 not 3"), "queries": (1, "3 not 2")}
    with pytest.raises(ValueError, match="benchmark_role"):
        rules.development_rows(spark.createDataFrame(ok, POOL).drop("benchmark_role"))


def test_query_tables(spark):
    columns = "query_id string, target_gene string, exclusion_gene string, disease string, query_mode string, expected_candidates string, expected_exclusion_observed string"
    good = [(" Q1", "a", "B", "d", "GENE_MULTIOMICS ", "10", "3")]
    assert found(rules.query_report(rules.query_table(spark.createDataFrame(good, columns)))) == {}
    bad = [*good, ("Q1", "x", " X", "d", "OTHER", "9", "many"), ("Q2", "x", "y", "d", "GENE_MULTIOMICS", "1e1", None)]
    assert found(rules.query_report(rules.query_table(spark.createDataFrame(bad, columns)))) == {"repeated key": (1, "Q1"), "target is excluded": (1, "Q1"), "mode": (1, "Q1"), "candidates": (2, "Q1"), "observed": (2, "Q1")}


def test_schemas_judgements_and_known_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("x", 1, 2.0)], "s string, i long, d double")
    assert rules.schema_differences(a, a.select("s", "i")) == [] and rules.schema_differences(a, b) == ["d: absent, double", "i: int, bigint"]
    reviews = spark.createDataFrame([("g", " Positive", "yes"), ("g", "positive", "no"), ("h", None, None)], "q string, judgement string, verified string")
    assert sorted(map(tuple, rules.judgements(reviews, ["q"]).collect())) == [("g", "positive", 2, 1), ("h", "", 1, 0)]
    keys = spark.createDataFrame([("ACH-1",), ("ACH-2",), ("ACH-2",)], "DepMap_ID string")
    assert found(rules.all_known(keys, keys.where("DepMap_ID = 'ACH-1'"))) == {"unknown key": (2, "ACH-2")} and found(rules.all_known(keys, keys)) == {}


def test_digests_see_one_changed_cell(spark):
    rows = [(1, "a", [1, 2], 1.5, b"x"), (2, None, None, None, None), (2, None, None, None, None), (3, "", [], 0.1, b"")]
    kind = "i long, s string, l array<int>, d double, b binary"
    of = lambda rows, kind=kind: tuple(digests.table_digest(spark.createDataFrame(rows, kind)).first())
    base = of(rows)
    assert base[0] == 4 and of(rows[::-1]) == base == tuple(digests.table_digest(spark.createDataFrame(rows, kind).select("b", "d", "l", "s", "i").repartition(3)).first())
    changed = [[(1, "a", [1, 3], 1.5, b"x"), *rows[1:]], [*rows[:3], (3, None, [], 0.1, b"")], rows[:3], [*rows, rows[1]], [rows[0], rows[0], rows[1], rows[3]]]
    assert len({base, *map(of, changed)}) == len(changed) + 1
    assert of([("a", "b:c")], "x string, y string") != of([("a1", "b:c"[1:])], "x string, y string") and of([], "x string") != of([], "y string")


def test_frozen_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20).withColumn("v", F.col("id") * 2)
    digest = digests.freeze(rows, path)
    assert digests.freeze(rows.orderBy(F.desc("id")), path) == digest and digests.frozen(spark, path).count() == 20
    with pytest.raises(ValueError, match="new version"):
        digests.freeze(rows.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), path)
    rows.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="frozen were 20"):
        digests.frozen(spark, path)
    with pytest.raises(ValueError, match="no digest"):
        digests.frozen(spark, str(tmp_path / "none"))


def test_files_that_differ_from_a_manifest(spark, tmp_path):
    for name, text in (("a", "1\n"), ("b", "2\n"), ("c", "3\n")):
        (tmp_path / name).write_text(text)
    stated = spark.createDataFrame([tuple(r) for r in sinks.file_manifest(spark, str(tmp_path)).select("name", "bytes", "sha256").collect()], "name string, bytes long, sha256 string")
    assert digests.changed_files(stated, sinks.file_manifest(spark, str(tmp_path))).count() == 0
    (tmp_path / "a").write_text("4\n")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("5\n")
    assert sorted(map(tuple, digests.changed_files(stated, sinks.file_manifest(spark, str(tmp_path))).collect())) == [("a", "changed"), ("b", "missing"), ("d", "new")]


def test_stacked_tables(spark):
    a = spark.createDataFrame([(True, 1, "x", 1)], "has_a boolean, i int, s string, m int")
    b = spark.createDataFrame([(2.5, 3, "y")], "i double, n long, m string").withColumn("void", F.lit(None))
    out = stacked([a, b, a])
    assert out.dtypes == [("i", "double"), ("s", "string"), ("m", "string"), ("n", "bigint"), ("void", "void"), ("has_a", "boolean")]
    assert [tuple(r) for r in out.collect()] == [(1.0, "x", "1", None, None, True), (2.5, None, "y", 3, None, None), (1.0, "x", "1", None, None, True)]
    with pytest.raises(ValueError, match="no tables"):
        stacked([])


def test_panels(spark):
    long = spark.createDataFrame([("ach-1", "g1 ", 1.0), ("ACH-1", "G2", 2.0), ("ACH-9", "G2", 3.0), ("ACH-9", "G3", 4.0), ("ACH-1", "G9", 5.0)], "DepMap_ID string, gene_symbol string, value_raw double")
    panel, known = spark.createDataFrame([("G1",), ("g2",), ("G3",)], "gene_symbol string"), spark.createDataFrame([("ACH-1",), ("ACH-1",), ("ACH-2",)], "DepMap_ID string")
    kept, audit = panel_rows(long, panel, known)
    assert sorted(map(tuple, kept.collect())) == [("ACH-1", "G1", 1.0), ("ACH-1", "G2", 2.0)]
    assert tuple(audit.first()) == (4, 2, 2, 1, 2, 1, "G3")
    assert tuple(panel_rows(long.limit(0), panel, known)[1].first()) == (0, 0, 0, 0, 0, 3, "G1")
    with pytest.raises(ValueError, match="once"):
        panel_rows(long, panel.union(panel), known)


def test_annotations(spark):
    rows = spark.createDataFrame([("A", "z", "b"), ("A", "y", "c"), ("B", None, None), (None, "x", "d"), ("B", None, None)], "DepMap_ID string, CCLE_Name string, lineage string")
    got = lambda df: sorted((r["DepMap_ID"], r["stripped_cell_line_name"], r["lineage"]) for r in df.collect())
    assert got(prepared_annotations(rows)) == [("A", "y", "c"), ("B", None, None)]
    assert got(prepared_annotations(rows, ["lineage"])) == [("A", "z", "b"), ("B", None, None)]
    named = rows.withColumn("stripped_cell_line_name", F.when(F.col("CCLE_Name") == "y", "short"))
    assert got(prepared_annotations(named)) == [("A", "short", "c"), ("B", None, None)]
    blank = rows.withColumn("stripped_cell_line_name", F.lit(None).cast("string")).withColumn("cell_line_name", F.lit("n"))
    assert got(prepared_annotations(blank)) == [("A", "n", "c"), ("B", "n", None)]
    assert prepared_annotations(rows.select("DepMap_ID")).columns == ["DepMap_ID", "stripped_cell_line_name", "lineage", "primary_disease"]


def test_repeated_annotations_do_not_multiply_candidates(spark):
    long = spark.createDataFrame([(f"ACH-{i}", "G", "depmap_rna", float(i)) for i in range(4)], "DepMap_ID string, gene_symbol string, source string, value_raw double")
    spine = long.select("DepMap_ID")
    notes = spine.select("DepMap_ID", F.lit("lung").alias("primary_disease"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("lineage"))
    store = EvidenceStore(long, spine, notes)
    assert [(r["DepMap_ID"], r["lineage"]) for r in store.rank("G", merged=True).orderBy("rank").collect()] == [(f"ACH-{i}", "a") for i in (3, 2, 1, 0)]
    assert store.recommend({"target_gene": "G", "context": "lung", "top_n": 3}).count() == 3


def test_reviewed_labels_are_kept(spark, tmp_path):
    path = str(tmp_path / "sheet")
    fresh = spark.createDataFrame([("r1", "unknown", "no", "", None)], "review_id string, judgement string, verified string, source_url string, review_notes string")
    sinks.save_labels(fresh, path)
    sinks.save_labels(fresh, path)
    for column, value in (("judgement", "positive"), ("verified", "Yes"), ("source_url", "u"), ("review_notes", "n")):
        touched = str(tmp_path / column)
        sinks.save_labels(fresh.withColumn(column, F.lit(value)), touched)
        with pytest.raises(ValueError, match="reviewed"):
            sinks.save_labels(fresh, touched)


def test_caches_need_evidence(spark, tmp_path):
    long = spark.createDataFrame([("G", None), ("H", 1.0)], "gene_symbol string, value_raw double")
    assert not sinks.cache_features(long.where("gene_symbol = 'G'"), str(tmp_path / "c")) and not (tmp_path / "c").exists()
    assert sinks.cache_features(long, str(tmp_path / "c")) and sinks.cached_features(spark, str(tmp_path / "c"), ["H"]).count() == 1


def test_matrices_are_re_keyed(spark, tmp_path):
    (tmp_path / "m.gct").write_text('#1.2\n2\t3\nName\tDescription\tDMS53_LUNG\tNOPE\t"SW1_SKIN"\nn1\thsa-1\t1.5\t2\tNA\nn2\thsa-2\t3\t4\t5\n\t\t6\t7\t8\n')
    known = spark.createDataFrame([("DMS53_LUNG", "ACH-2"), ("DMS53_LUNG", "ACH-1"), ("SW1_SKIN", "ACH-3"), ("OTHER", "ACH-4"), (None, "ACH-5")], "name string, id string")
    long, unmatched = read_matrix_of(spark, str(tmp_path / "m.gct"), known, "\t", skip=2, keys=2)
    assert sorted(map(tuple, long.collect()), key=str) == [("n1", "ACH-1", 1.5), ("n1", "ACH-3", None), ("n2", "ACH-1", 3.0), ("n2", "ACH-3", 5.0)]
    assert [r["name"] for r in unmatched.collect()] == ["NOPE"]
    assert re.fullmatch("n[12]", long.first()["row"])


def test_texts_of_a_sheet(spark):
    df = spark.createDataFrame([(None, None, None, None), (["b", None, "a"], float("nan"), True, "x"), ([], 0.5, False, "")], "l array<string>, v double, b boolean, t string")
    got = [tuple(r) for r in df.select(*list_texts(df, "l", "v", "b", "t")).collect()]
    assert got == [("", "", "", ""), ("b;None;a", "", "True", "x"), ("", "0.5", "False", "")]


def test_rounding_with_epsilon(spark):
    values = [0.125, -0.125, 1.005, 0.0, None, float("nan"), float("inf"), 2e14]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded_epsilon(F.col("v"), 2)).collect()]
    assert got == [0.13, -0.12, 1.0 if (1.005 + 2**-52) * 100 < 100.5 else 1.01, 0.0, None, None, None, 2e14]


def test_last_parentheses_and_whole_names(spark):
    df = spark.createDataFrame([("P1 (x) (EGFR) ",), ("EGFR",), ("(A) b",)], "h string")
    assert [r[0] for r in df.select(symbol_in_last_parens(F.col("h"))).collect()] == ["EGFR", None, None]
    assert exact_column(["Gene name", "gene_symbol"], ["symbol", "GENE SYMBOL"]) == "gene_symbol"
    with pytest.raises(KeyError):
        exact_column(["gene_symbol_2"], ["gene symbol"])
    with pytest.raises(ValueError, match="all called"):
        exact_column(["a b", "A_B"], ["ab"])


def test_unknown_entities_are_removed_and_counted(spark):
    known = spark.createDataFrame([("ach-1 ",), ("ACH-1",), (None,)], "DepMap_ID string")
    kept, audit = known_rows(spark.createDataFrame([(" ACH-1", 1), ("ACH-2", 2), ("ACH-2", 3), (None, 4), ("", 5)], "DepMap_ID string, v int"), known)
    assert [tuple(r) for r in kept.collect()] == [(" ACH-1", 1)] and tuple(audit.first()) == (5, 1, 4, 1, "ACH-2")
    kept, audit = known_rows(spark.createDataFrame([], "DepMap_ID string, v int"), known)
    assert kept.count() == 0 and tuple(audit.first()) == (0, 0, 0, 0, None)


def test_dropped_rows_are_counted_on_the_way(spark):
    seen = Observation("packed")
    rows = spark.createDataFrame([("A", " g ", 1.0), (None, "g", 2.0), ("B", None, 3.0), ("C", "h", None)], "id string, g string, v double")
    assert packed(rows, "depmap_rna", "id", F.col("g"), F.col("v"), "u", "1", seen=seen).count() == 2 and seen.get == {"rows": 4, "dropped": 2}


def test_exports_have_seventeen_columns(spark, tmp_path):
    row = spark.createDataFrame([(1, "ACH-1", "a, b", None, "d", "m", "G", None, 0.5, 0.4, "r", None, 0.2, 0.3, 0.0, 1.0, 0.75, "more")], ", ".join(f"`{c}` {t}" for c, t in EXPORTED.items()) + ", more string")
    assert save_export(row, f"{tmp_path}/x") and read_export(spark, f"{tmp_path}/x").collect() == row.drop("more").collect()
    (raw,) = (p.read_bytes() for p in (tmp_path / "x").glob("part-*.csv"))
    assert raw.startswith(b"\xef\xbb\xbfrank,DepMap_ID,") and raw.count(b"\r\n") == 2 and len(EXPORTED) == 17
    assert not save_export(row.limit(0), f"{tmp_path}/y") and not (tmp_path / "y").exists()
    row.select("rank", "DepMap_ID").write.option("header", True).csv(f"{tmp_path}/z")
    with pytest.raises(ValueError, match="exported ranking"):
        read_export(spark, f"{tmp_path}/z")
