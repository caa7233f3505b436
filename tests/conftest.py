import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankloom.session import TABLES, build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4, spark__driver__memory="4g")


@pytest.fixture(scope="session")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def table_of(rows):
    """Rows as sorted tuples of comparable values; columns by name."""

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x != x:
            return ""
        return f"{x:.7g}" if isinstance(x, float) else str(x)

    rows = [dict(r) for r in rows]
    names = sorted(rows[0]) if rows else []
    return names, sorted(tuple(plain(r[n]) for n in names) for r in rows)


def agree(spark, duck, query, sql):
    ours = table_of(r.asDict() for r in query(spark, SF).collect())
    theirs = table_of(duck.sql(sql).df().astype(object).to_dict("records"))
    assert ours == theirs
