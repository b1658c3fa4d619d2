"""Small fixtures with hand-worked results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators import checks, citations, cooccur, counts, distribution, hierarchy, identity, populations, ranking, stats, timeseries
from citelode.sources import sinks, tables


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_doi_and_pmid(spark):
    rows = [(" https://DOI.org/10.1234/AB%2Fc ", "https://pubmed.ncbi.nlm.nih.gov/00123/"), ("doi:10.1/x", "0"), (None, "PMC1"), ("", " 77 ")]
    got = one(spark, rows, "d string, p string", N.doi(F.col("d")), N.doi(F.col("d"), strict=False), N.pmid(F.col("p")), N.pmid(F.col("p"), keep_text=True))
    assert got == [("10.1234/ab/c", "10.1234/ab/c", "123", "00123"), (None, "10.1/x", None, None), (None, None, None, None), (None, None, "77", "77")]


def test_dates(spark):
    got = one(spark, [("2/29/2020 0:00",), ("2020-2-3",), ("x",), (None,), ("13/40/2020",)], "d string", N.date_of(F.col("d")))
    assert got == [(dt.date(2020, 2, 29),), (dt.date(2020, 2, 3),), (None,), (None,), (None,)]
    assert one(spark, [(dt.date(2020, 2, 29),)], "d date", N.anniversary(F.col("d"), 1)) == [(dt.date(2021, 2, 28),)]
    lo, hi = N.date_interval(F.col("t"), F.col("y"))
    got = one(spark, [("2020", 1), ("2020-05", 1), ("2020-05-06", 1), (None, 2019), (None, None)], "t string, y int", lo, hi)
    assert got == [(dt.date(2020, 1, 1), dt.date(2020, 12, 31)), (dt.date(2020, 5, 1), dt.date(2020, 5, 31)), (dt.date(2020, 5, 6),) * 2, (dt.date(2019, 1, 1), dt.date(2019, 12, 31)), (None, None)]


def test_lists_ids_and_codes(spark):
    assert one(spark, [("b; a;;b ",), (None,)], "c string", N.split_list(F.col("c"))) == [(["a", "b"],), ([],)]
    assert one(spark, [("W12",), ("W0",), ("x",), ("W99999999999999999999",)], "c string", N.numbered_id(F.col("c"), "W")) == [(12,), (None,), (None,), (None,)]
    assert one(spark, [(["HK", "CN", "xx", None],), (None,)], "c array<string>", N.merged_codes(F.col("c"), {"HK": "CN"})) == [(["CN"],), ([],)]
    assert one(spark, [("=1+1",), ("ok",)], "c string", N.csv_safe(F.col("c"))) == [("'=1+1",), ("ok",)]


def test_missing_names_and_roles(spark):
    assert one(spark, [("[Unknown] ",), ("N/A",), ("Li",), (None,)], "c string", N.is_missing_name(F.col("c"))) == [(True,), (True,), (False,), (True,)]
    rows = [(True, True, None), (True, None, None), (None, True, True), (None, None, True), (None, None, None)]
    got = one(spark, rows, "a boolean, b boolean, c boolean", N.document_role(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in got] == ["conflict", "known_notice", "original_supported", "suspected_notice", "unresolved"]


def test_notice_titles(spark):
    rows = [("Retraction: x",), (" \n RETRACTED",), ("Erratumé",), ("\x0berratum",), ("erratum2",), ("x erratum",), (None,)]
    assert [r[0] for r in one(spark, rows, "c string", N.notice_title(F.col("c")))] == [True, True, True, False, False, False, False]


def test_rates(spark):
    n, d = F.col("n"), F.col("d")
    got = one(spark, [(0, 0), (0, 1000), (20, 1000)], "n long, d long", N.rate(n, d), N.ranking_eligible(n, d))
    assert got == [(None, False), (0.0, False), (0.02, True)]
    assert one(spark, [(1, 0), (10, 20)], "n long, d long", N.growth(n, d)) == [(None,), (-50.0,)]


def test_identity_outcomes(spark):
    papers = spark.createDataFrame([(1, "a", None), (2, "b", "p"), (3, "c", None), (4, None, None), (5, "a", "q"), (6, "d", "p")], "key long, doi string, pmid string")
    doi = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), ("d", 20)], "doi string, work_id long")
    pmid = spark.createDataFrame([("p", 20), ("q", 99)], "pmid string, work_id long")
    got = {r["key"]: (r["outcome"], r["work_id"]) for r in identity.match(papers, doi, pmid).collect()}
    assert got == {1: ("unique", 10), 2: ("unique", 20), 3: ("unmatched", None), 4: ("absent", None), 5: ("conflicting", None), 6: ("unique", 20)}
    after = {r["key"]: r["outcome"] for r in identity.demote_shared(identity.match(papers, doi, pmid)).collect()}
    assert after[2] == after[6] == "ambiguous" and after[1] == "unique"


def test_originals_and_events(spark):
    rows = [("x", 2, "b", dt.date(2020, 1, 2), dt.date(2021, 1, 1)), ("x", 1, "a", dt.date(2020, 1, 1), dt.date(2021, 2, 1)), ("y", 3, "a", None, None)]
    got = {r["key"]: r for r in identity.originals(spark.createDataFrame(rows, "key string, record_id int, label string, date date, event_date date")).collect()}
    assert got["x"]["labels"] == ["a", "b"] and got["x"]["event_date"] == dt.date(2021, 1, 1) and got["x"]["event_date_conflict"]
    assert got["y"]["records"] == 1 and not got["y"]["event_date_conflict"]


def test_fractional_counts_and_concentration(spark):
    m = spark.createDataFrame([(1, "CN"), (1, "US"), (1, "CN"), (2, "CN")], "w long, c string")
    got = {r["c"]: (r["full_count"], r["fractional_count"]) for r in counts.associations(m, "w", "c").collect()}
    assert got == {"CN": (2, 1.5), "US": (1, 0.5)}
    r = counts.concentration(spark.createDataFrame([(1,), (1,)], "n long"), "n").first()
    assert r["gini"] == 0 and r["hhi"] == 0.5
    assert [tuple(x) for x in counts.pair_counts(m, "w", "c").collect()] == [("CN", "US", 1)]


def test_cube_moves_keep_the_total(spark):
    cube = spark.createDataFrame([("t", "a", 5), ("t", "b", 1)], "type string, document_role string, work_count long")
    moves = spark.createDataFrame([("t", "a", "b", 2)], "type string, old_role string, new_role string, moved long")
    assert sorted(tuple(r) for r in populations.move_roles(cube, moves, ["type"]).collect()) == [("t", "a", 3), ("t", "b", 3)]
    with pytest.raises(Exception, match="below zero"):
        populations.move_roles(cube, moves.withColumn("moved", F.lit(9).cast("bigint")), ["type"]).collect()


def test_windows_and_series(spark):
    s = spark.createDataFrame([(2000, 10, False), (2001, 20, False), (2002, 30, False), (2003, 5, True)], "year int, n long, partial boolean")
    assert [r["trailing_mean"] for r in timeseries.trailing_mean(s, "year", "n", partial="partial").orderBy("year").collect()] == [None, None, 20.0, None]
    assert [r["growth"] for r in timeseries.change(s, "year", "n").orderBy("year").collect()][:2] == [None, 100.0]
    flags = timeseries.control_chart(spark.createDataFrame([(i, 1) for i in range(24)] + [(24, 21), (25, 100)], "m int, n long").withColumn("p", F.col("m") == 25), "m", "n", partial="p").orderBy("m").collect()
    assert [r["m"] for r in flags if r["flagged"]] == [24]
    runs = timeseries.segments(spark.createDataFrame([(1, True), (2, True), (4, True), (5, False)], "y int, ok boolean"), "y", "ok").orderBy("first").collect()
    assert [(r["first"], r["last"], r["length"]) for r in runs] == [(1, 2, 2), (4, 4, 1)]


def test_quantiles_need_enough(spark):
    df = spark.createDataFrame([(i,) for i in range(19)], "v int")
    assert distribution.quantile_summary(df, [], "v").first()["p50"] is None
    assert distribution.quantile_summary(df, [], "v", least=5).first()["p50"] == 9


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)], "k string, v double")
    assert {r["k"]: r["rank"] for r in ranking.dense_ranks(df.withColumn("g", F.lit(1)), ["g"], "v", F.lit(True)).collect()} == {"a": 1, "b": 1, "c": 2, "d": None}
    assert {r["k"]: r["r"] for r in df.where("v is not null").select("k", ranking.average_rank("v").alias("r")).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}
    assert ranking.evenly_spaced(spark.range(10), [F.col("id")], 5).count() == 5


def test_parent_roots(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "id long, parent long")
    assert {r["id"]: r["root"] for r in hierarchy.roots(nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None}
    assert [tuple(r) for r in hierarchy.with_orphans(nodes).where("navigation_only").collect()] == [(99, None, True)]


@pytest.mark.parametrize("n,l,r,j,ngd,status", [(8, 4, 2, 2, 0.5, "defined"), (100, 10, 10, 1, 1.0, "defined"), (8, 4, 4, 4, 0.0, "defined"), (8, 8, 8, 8, None, "zero_denominator"), (8, 0, 2, 0, None, "zero_marginal"), (8, 4, 2, 0, None, "zero_cooccurrence")])
def test_distance(spark, n, l, r, j, ngd, status):
    m = cooccur.metrics(F.col("n"), F.col("l"), F.col("r"), F.col("j"))
    row = spark.createDataFrame([(n, l, r, j)], "n long, l long, r long, j long").withColumns(m).first()
    assert row["ngd_status"] == status and (row["ngd"] is None if ngd is None else abs(row["ngd"] - ngd) < 1e-12)


def test_edge_timing(spark):
    events = spark.createDataFrame([(1, dt.date(2020, 5, 10))], "target long, event_date date")
    edges = spark.createDataFrame([(1, "2020", 2020), (1, "2020-05", 2020), (1, "2020-05-10", 2020), (1, "2020-04", 2020), (1, "2021", 2021), (1, None, None)], "target long, date string, year int")
    assert sorted(r["state"] for r in citations.timed(edges, events).collect()) == ["after", "ambiguous", "ambiguous", "ambiguous", "before", "undated"]


def test_follow_up_keeps_targets_without_edges(spark):
    events = spark.createDataFrame([(1, dt.date(2015, 1, 1)), (2, dt.date(2015, 1, 1))], "target long, event_date date")
    edges = spark.createDataFrame([(1, dt.date(2015, 1, 1), dt.date(2015, 1, 1)), (1, dt.date(2016, 1, 1), dt.date(2016, 1, 1)), (1, dt.date(2016, 1, 2), dt.date(2016, 1, 2))], "target long, lo date, hi date")
    r = {x["k"]: (x["targets"], x["edges"], x["median"]) for x in citations.follow_up(edges, events, "2026-06-26").collect()}
    assert r == {1: (2, 1, 0.5), 3: (2, 2, 1.0), 5: (2, 2, 1.0)}


def test_statistics(spark):
    lo, hi = stats.wilson(F.col("n"), F.col("t"))
    a, b = one(spark, [(0, 10), (5, 0)], "n long, t long", lo, hi)
    assert a[0] == 0 and 0 < a[1] < 0.35 and b == (None, None)
    df = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(5)], "g int, x double, y double")
    assert stats.spearman(df, "x", "y", ["g"]).first()["rho"] == 1.0
    assert stats.spearman(df.limit(2), "x", "y", ["g"]).first()["rho"] is None


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert checks.symmetric_difference(a, b).count() == 0
    assert sorted(tuple(r) for r in checks.multiset_difference(a, b).collect()) == [(1, "left"), (2, "right")]


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id,text\n1,"a\nb ""q"""\n'.encode())
    assert [tuple(r) for r in tables.load_csv(spark, str(p)).collect()] == [("1", 'a\nb "q"')]
    rows = [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    assert sinks.unpack_rows(sinks.pack_rows(rows)) == rows
    df = spark.createDataFrame([(1, "=x")], "id int, t string")
    sinks.write_text(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["t"] == "'=x"
    sinks.write_parquet(df, str(tmp_path / "pq"))
    assert tables.schema_audit(spark, spark.read.parquet(str(tmp_path / "pq")).schema, df.schema).count() == 0
    assert len(sinks.section_chunks({"s": df})["manifest"]["s"]) == 64
    nested = spark.createDataFrame([], "a array<struct<x:int>>, m map<string,int>")
    assert tables.schema_paths(nested.schema) == [("a[].x", "int"), ("m{}", "int")]


def test_daily_stream(spark, tmp_path):
    from citelode.streaming.daily import run_available

    rows = [(dt.datetime(2024, 1, 1, 5), "a"), (dt.datetime(2024, 1, 1, 6), "a"), (dt.datetime(2024, 1, 9), "b")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(dt.date(2024, 1, 1), "a", 2)]
