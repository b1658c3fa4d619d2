"""The registered queries that SQL can express, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from citelode.llm import queries

D = "/root/testdata/sf0.001"


def norm(x):
    return f"{x:.9g}" if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    df = queries.QUERIES[name](spark, D)
    names = sorted(df.columns)
    r = c.sql(queries.ORACLE_SQL[name])
    order = [r.columns.index(n) for n in names]
    a = sorted((tuple(norm(v) for v in x) for x in df.select(*names).collect()), key=str)
    b = sorted((tuple(norm(x[i]) for i in order) for x in r.fetchall()), key=str)
    assert sorted(r.columns) == names and a == b


def test_names():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in e.queries()
