"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from citelode.plans import registry

registry.load_all()
D = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return None if x != x else f"{x:.9g}"
    if isinstance(x, list):
        return tuple(norm(y) for y in x)
    return x


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    names = sorted(df.columns)
    r = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(r.columns) == names
    order = [r.columns.index(n) for n in names]
    a = sorted((tuple(norm(v) for v in x) for x in df.select(*names).collect()), key=str)
    b = sorted((tuple(norm(x[i]) for i in order) for x in r.fetchall()), key=str)
    assert a == b


def test_title_notices_on_odd_texts(spark, tmp_path):
    texts = ["Inözust", "Inßbepf", "In\u0301 x", "the\u0660", "and\ufb01", "in\u4e2d", "the\U00010400", "Theß", "in\u200d", "THE", " \t\r\n\f and", "\x0bthe", "\u00a0the", "\u0085the",
             "the_", "the9", "thea", "and.", "", " ", None, "\u0131n", "\u0130n", "öin", "the", "in-"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/*.parquet'")
    want = dict(c.sql(registry.ORACLE_SQL["p8_title_notices"]).fetchall())
    got = {r["doc_id"]: r["notice"] for r in registry.QUERIES["p8_title_notices"](spark, str(tmp_path)).collect()}
    assert got == want and want[0] is True and want[11] is False and want[20] is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
