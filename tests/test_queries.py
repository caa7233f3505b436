"""Every registered query against its SQL in another engine, over the smallest tables."""

import re

import pytest

from rankloom.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF, agree, table_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, QUERIES[name], ORACLE_SQL[name])


def test_entry_gives_ten_ranked_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and 0 < len(rows) <= 10


def test_every_query_is_callable_and_sql_has_a_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and set(QUERIES) <= names


def test_bootstrap_repeats(spark):
    once, twice = (sorted(map(tuple, QUERIES["bootstrap_deltas"](spark, SF).collect())) for _ in range(2))
    assert once == twice and all(r[2] <= r[1] + 1e-6 <= r[3] + 1e-5 or r[1] == 0 for r in once)


def test_numbers_in_all_texts(spark, tmp_path):
    """Every document is there, with letters before digits or without a text."""
    odd = [(1, "ACH-000001 v2 B12 -3.5"), (2, None), (3, ""), (4, "no digits"), (5, "x1.5 7"), (6, "1,234 and +2")]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (SF, str(tmp_path)):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        found = {i: [float(x) for x in re.findall(r"(?<![A-Za-z])[-+]?[0-9]+(?:\.[0-9]+)?", t or "")] for i, t in texts.items()}
        got = {r["doc_id"]: (r["n"], r["most"]) for r in QUERIES["numbers_in_all_texts"](spark, sf).collect()}
        assert got == {i: (len(xs), max(xs, default=None)) for i, xs in found.items()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2] == got[3] == (0, None)


@pytest.mark.parametrize("name", ["replicate_audit", "observed_entities_by_feature", "long_table_coverage"])
def test_evidence_counts_spread_with_the_input(spark, duck, monkeypatch, name):
    """Many rows get more partitions than the session has, and the counts are the same."""
    from rankloom import session
    from rankloom.sources import star

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    agree(spark, duck, QUERIES[name], ORACLE_SQL[name])
    assert star.long_by_entity(spark, SF).rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)


@pytest.mark.parametrize("name", ["sweep_against_baseline", "panel_summary"])
def test_comparison_counts_ids_that_several_keys_share(spark, tmp_path, name):
    """Keys of seven digits are cut to six, so one, two or three customers share an id; counts are those of the SQL."""
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {t}0 AS SELECT * FROM '{SF}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{SF}/{t}.parquet') else ''}'")
    key = lambda c, nth: f"(100000 + {c}) * 10 + {nth} % (1 + {c} % 3)"
    con.execute(f"COPY (SELECT DISTINCT * EXCLUDE (j) REPLACE ({key('c_custkey', 'j')} AS c_custkey) FROM customer0, range(3) t(j)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT * REPLACE ({key('o_custkey', 'o_orderkey')} AS o_custkey) FROM orders0) TO '{tmp_path}/orders.parquet'")
    for t in ("customer", "orders", "lineitem", "part", "nation", "region"):
        if t not in ("customer", "orders"):
            con.execute(f"COPY {t}0 TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert con.execute("SELECT count(DISTINCT n), max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey // 10)").fetchall() == [(3, 3)]
    ours = table_of(r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert ours == table_of(con.sql(ORACLE_SQL[name]).df().astype(object).to_dict("records"))
