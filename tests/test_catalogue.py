"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math
import os

import duckdb
import pytest

from sievework.plans import catalogue
from tests.conftest import DATA

D = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, D)
    rel = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    at = {c: i for i, c in enumerate(rel.columns)}
    theirs = sorted(tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, D).count() > 0
