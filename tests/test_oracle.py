"""Every query that has SQL gives the same rows in Spark and in DuckDB."""

import glob
import os

import duckdb
import pytest

from codequarry.plans import evidence_queries  # noqa: F401 - adds to the queries
from codequarry.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    """Rows in any order, columns by name."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else int(v)
    return sorted((tuple(value(r[k]) for k in order) for r in data), key=str)


#: What SQL cannot express; tests of their own hold these against brute force.
NO_SQL = {"porter_stem", "label_propagation", "bootstrap_ci"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, D)
    got = df.collect()
    if name not in SQL:
        assert name in NO_SQL and got
        return
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, found.fetchall())
