"""Every query of the catalogue against its DuckDB SQL."""

import os

import duckdb
import pytest

from kinfold.plans.catalogue import ORACLE_SQL, QUERIES

D = os.environ.get("CATALOGUE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def canon(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = canon(df.select(*[f"`{c}`" for c in columns]).collect())
    assert name in ORACLE_SQL
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = canon(tuple(r[i] for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
