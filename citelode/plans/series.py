"""Windows, series, ranks, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.operators import counts, distribution, ranking, timeseries
from citelode.plans.registry import query
from citelode.sources import proxies as P
from citelode.sources import tables as T


def _lags(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).join(P.events(spark, d), "work_id")
    return j.withColumn("lag", F.datediff("event_date", "publication_date")).where("lag >= 0")


LAGS = f"{P.WORKS}, {P.EVENTS}, lags AS (SELECT works.*, event_date, date_diff('day', publication_date, event_date) AS lag FROM works JOIN events_ USING (work_id) WHERE event_date >= publication_date)"


@query("a9_quantiles", f"WITH {LAGS} SELECT type, publication_year, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(lag), 6) END AS mean, CASE WHEN count(*) >= 20 THEN quantile_cont(lag, 0.25) END AS p25, CASE WHEN count(*) >= 20 THEN quantile_cont(lag, 0.5) END AS p50, CASE WHEN count(*) >= 20 THEN quantile_cont(lag, 0.75) END AS p75, CASE WHEN count(*) >= 20 THEN quantile_cont(lag, 0.9) END AS p90 FROM lags GROUP BY ALL")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return distribution.quantile_summary(_lags(spark, d), ["type", "publication_year"], "lag")


@query("w1_ecdf", f"WITH {LAGS}, c AS (SELECT lag::INTEGER AS value, count(*) AS n FROM lags GROUP BY 1) SELECT value, sum(n) OVER (ORDER BY value)::BIGINT AS cumulative, sum(n) OVER (ORDER BY value)::DOUBLE / sum(n) OVER () AS share FROM c")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return distribution.ecdf(_lags(spark, d), "lag")


@query("w1b_ecdf_thinned", f"WITH {LAGS}, c AS (SELECT lag::INTEGER AS value, count(*) AS n FROM lags GROUP BY 1), r AS (SELECT value, sum(n) OVER (ORDER BY value)::BIGINT AS cumulative, sum(n) OVER (ORDER BY value)::DOUBLE / sum(n) OVER () AS share, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS k FROM c) SELECT value, cumulative, share FROM r WHERE (i - 1) % greatest(1, (k + 149) // 150) = 0 OR i = k")
def w1b(spark: SparkSession, d: str) -> DataFrame:
    return distribution.ecdf(_lags(spark, d), "lag", points=150)


@query("w2_lorenz", "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1), v AS (SELECT n AS v, count(*) AS m FROM c GROUP BY 1) SELECT sum(m) OVER (ORDER BY v)::DOUBLE / sum(m) OVER () AS member_share, sum(m * v) OVER (ORDER BY v)::DOUBLE / sum(m * v) OVER () AS count_share FROM v")
def w2(spark: SparkSession, d: str) -> DataFrame:
    n = T.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = T.load(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])
    return distribution.lorenz(c, "n", points=100_000)


YEARS = f"{P.WORKS}, years AS (SELECT y::INTEGER AS year, count(work_id) AS n, y = 2001 AS partial FROM range(1993, 2003) r(y) LEFT JOIN works ON publication_year = y GROUP BY 1, 3)"


def _years(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.yearly(P.works(spark, d), "publication_year", 1993, 2002, partial=2001)


@query("t1_yearly", f"WITH {YEARS} SELECT * FROM years")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return _years(spark, d)


@query("w3_trailing_mean", f"WITH {YEARS} SELECT *, CASE WHEN NOT partial AND count(n) OVER w = 3 THEN sum(n) OVER w / 3.0::DOUBLE END AS trailing_mean FROM years WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.trailing_mean(_years(spark, d), "year", "n", partial="partial")


@query("w4_annual_growth", f"WITH {YEARS}, l AS (SELECT *, lag(n) OVER (ORDER BY year) AS was FROM years) SELECT year, n, partial, n - was AS change, (n - was) * 100.0::DOUBLE / nullif(was, 0) AS growth, was < 20 AS small_base FROM l")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.change(_years(spark, d), "year", "n")


@query("w5_control_chart", "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS c FROM orders GROUP BY 1), s AS (SELECT x::DATE AS month, coalesce(c, 0) AS n FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) g(x) LEFT JOIN m ON m.month = x::DATE), b AS (SELECT *, CASE WHEN count(n) OVER w = 24 THEN sum(n) OVER w / 24.0::DOUBLE END AS baseline FROM s WINDOW w AS (ORDER BY month ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), t AS (SELECT *, CASE WHEN baseline IS NOT NULL THEN greatest(20.0::DOUBLE, baseline + 3 * sqrt(baseline)) END AS threshold FROM b) SELECT *, coalesce(n > threshold, false) AS flagged FROM t")
def w5(spark: SparkSession, d: str) -> DataFrame:
    o = T.load(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return timeseries.control_chart(timeseries.monthly(o, "date", "1995-01-01", "2001-08-01"), "month", "n")


@query("w5b_daily_control_chart", "WITH m AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), b AS (SELECT day, n, CASE WHEN count(n) OVER w = 7 THEN sum(n) OVER w / 7.0::DOUBLE END AS baseline FROM m WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)), t AS (SELECT *, CASE WHEN baseline IS NOT NULL THEN greatest(20.0::DOUBLE, baseline + 3 * sqrt(baseline)) END AS threshold FROM b) SELECT *, coalesce(n > threshold, false) AS flagged FROM t")
def w5b(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return timeseries.control_chart(e, "day", "n", baseline=7)


@query("w6_dense_rank", f"WITH {P.LABELS}, c AS (SELECT l0, l1, count(*) AS n FROM labels_ GROUP BY ALL), s AS (SELECT *, CASE WHEN n % 5 <> 0 THEN n END AS v FROM c) SELECT l0, l1, v, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY l1, v IS NOT NULL ORDER BY v) END::INTEGER AS rank FROM s")
def w6(spark: SparkSession, d: str) -> DataFrame:
    c = P.labels(spark, d).groupBy("l0", "l1").agg(F.count(F.lit(1)).alias("n")).select("l0", "l1", F.when(F.col("n") % 5 != 0, F.col("n")).alias("v"))
    return ranking.dense_ranks(c, ["l1"], "v", F.lit(True))


@query("w7_average_rank", "SELECT s_suppkey AS id, s_nationkey AS nation, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0::DOUBLE AS place FROM supplier")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), ranking.average_rank("s_nationkey").alias("place"))


DUAL = "cells AS (SELECT p_brand AS brand, count(*) AS works, count(*) FILTER (WHERE l_returnflag = 'R') * 10000.0::DOUBLE / count(*) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _brand_cells(spark: SparkSession, d: str) -> DataFrame:
    j = P.lines(spark, d).select("part", "flag").join(T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")), "part")
    return j.groupBy("brand").agg(F.count(F.lit(1)).alias("works"), (F.count_if(F.col("flag") == "R") * 10000.0 / F.count(F.lit(1))).alias("rate"))


@query("w8_dual_rank", f"WITH {DUAL} SELECT *, row_number() OVER (ORDER BY works DESC, brand)::INTEGER AS count_rank, row_number() OVER (ORDER BY rate DESC, brand)::INTEGER AS rate_rank FROM cells")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return ranking.dual_rank(_brand_cells(spark, d), "works", "rate", "brand")


@query("w10_year_weights", f"WITH {P.WORKS} SELECT publication_year, count(*) / sum(count(*)) OVER ()::DOUBLE AS weight FROM works GROUP BY 1")
def w10(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.stats import year_weights

    return year_weights(P.works(spark, d), "publication_year")


@query("w11_hash_sample_by", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 2")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hash_sample_by(T.load(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 2).select("lang", "doc_id")


@query("w12_contiguity", "WITH r AS (SELECT l_suppkey AS shard, min(l_orderkey) AS first, min(l_orderkey) + l_suppkey % 3 AS last FROM lineitem GROUP BY 1), p AS (SELECT *, lag(last) OVER (ORDER BY first, shard) AS previous_last FROM r) SELECT count(*) AS gaps FROM p WHERE previous_last IS NOT NULL AND previous_last + 1 <> first")
def w12(spark: SparkSession, d: str) -> DataFrame:
    r = P.lines(spark, d).groupBy(F.col("supplier").alias("shard")).agg(F.min("work_id").alias("start"))
    r = r.select("shard", F.struct("start", "shard").alias("o"), F.col("start").alias("first"), (F.col("start") + F.col("shard") % 3).alias("last"))
    w = Window.orderBy("o")
    bad = r.withColumn("previous_last", F.lag("last").over(w)).where(F.col("previous_last").isNotNull() & (F.col("previous_last") + 1 != F.col("first")))
    return bad.agg(F.count(F.lit(1)).alias("gaps"))


@query("w13_segments", "WITH m AS (SELECT p_brand AS brand, year(l_shipdate)::INTEGER AS year, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), g AS (SELECT *, year - row_number() OVER (PARTITION BY brand ORDER BY year) AS island FROM m WHERE n % 3 <> 0) SELECT brand, min(year) AS first, max(year) AS last, count(*) AS length FROM g GROUP BY brand, island")
def w13(spark: SparkSession, d: str) -> DataFrame:
    j = P.lines(spark, d).select("part", F.year("date").alias("year")).join(T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")), "part")
    m = j.groupBy("brand", "year").agg((F.count(F.lit(1)) % 3 != 0).alias("ok"))
    return timeseries.segments(m, "year", "ok", ["brand"])


@query("w14_terciles", "SELECT p_partkey AS id, p_type AS parent, CASE WHEN p_size <= quantile_cont(p_size, 1 / 3) OVER (PARTITION BY p_type) THEN 'low' WHEN p_size <= quantile_cont(p_size, 2 / 3) OVER (PARTITION BY p_type) THEN 'middle' ELSE 'high' END AS band FROM part")
def w14(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("parent"), "p_size")
    return ranking.terciles(p, "p_size", ["parent"]).select("id", "parent", "band")


@query("t1_top", f"WITH {DUAL} SELECT brand, works FROM cells ORDER BY works DESC, brand LIMIT 10")
def t1_top(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(_brand_cells(spark, d), "works", "brand", 10).select("brand", "works")


@query("t2_fixed_selection", f"WITH {P.WORKS}, {P.LABELS}, t AS (SELECT l1 FROM labels_ JOIN works USING (work_id) WHERE is_retracted GROUP BY 1 ORDER BY count(DISTINCT work_id) DESC, l1 LIMIT 5) SELECT l1, count(DISTINCT work_id) AS works FROM labels_ WHERE l1 IN (FROM t) GROUP BY 1")
def t2(spark: SparkSession, d: str) -> DataFrame:
    la = P.labels(spark, d)
    flagged = P.works(spark, d).where("is_retracted").select("work_id")
    n = la.join(flagged, "work_id", "left_semi").groupBy("l1").agg(F.count_distinct("work_id").alias("n"))
    return ranking.selected(la, ranking.top(n, "n", "l1", 5), "l1").groupBy("l1").agg(F.count_distinct("work_id").alias("works"))


@query("t3_top_or_unknown", "WITH c AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'Unknown' ELSE 'S' || l_suppkey END AS name, count(*) AS n FROM lineitem GROUP BY 1) (SELECT * FROM c WHERE name <> 'Unknown' ORDER BY n DESC, name LIMIT 20) UNION ALL SELECT * FROM c WHERE name = 'Unknown'")
def t3(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("supplier") % 10 == 0, "Unknown").otherwise(F.concat(F.lit("S"), F.col("supplier").cast("string")))
    return ranking.top_or_forced(P.lines(spark, d).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")), "n", "name", 20, "Unknown")


@query("t4_top_by_month", "WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 10) SELECT l_suppkey AS supplier, date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n FROM lineitem WHERE l_suppkey IN (FROM t) GROUP BY ALL")
def t4(spark: SparkSession, d: str) -> DataFrame:
    li = P.lines(spark, d)
    best = ranking.top(li.groupBy("supplier").agg(F.count(F.lit(1)).alias("n")), "n", "supplier", 10)
    return ranking.selected(li, best, "supplier").groupBy("supplier", F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("t5_eligible_first", f"WITH {DUAL}, e AS (SELECT *, works >= (SELECT median(works) FROM cells) AS eligible FROM cells) SELECT brand, row_number() OVER (ORDER BY eligible DESC, CASE WHEN eligible THEN rate END DESC, brand)::INTEGER AS place FROM e")
def t5(spark: SparkSession, d: str) -> DataFrame:
    c = _brand_cells(spark, d)
    m = c.agg(F.percentile("works", 0.5).alias("m"))
    e = c.crossJoin(F.broadcast(m)).withColumn("eligible", F.col("works") >= F.col("m"))
    return ranking.eligible_first(e, "eligible", "rate", "brand").select("brand", "place")


@query("t6_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 36")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hash_sample(T.load(spark, d, "documents").select("doc_id"), "doc_id", 36).select("doc_id")


@query("t8_evenly_spaced", "WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS total FROM part) SELECT id FROM r WHERE place = 0 OR place * 25 // total <> (place - 1) * 25 // total")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return ranking.evenly_spaced(T.load(spark, d, "part").select(F.col("p_partkey").alias("id")), [F.col("id")], 25).select("id")


@query("t9_nulls_last", f"WITH {LAGS} SELECT type, max(lag)::INTEGER AS longest, row_number() OVER (ORDER BY max(CASE WHEN type <> '5-LOW' THEN lag END) DESC NULLS LAST, type)::INTEGER AS place FROM lags GROUP BY 1")
def t9(spark: SparkSession, d: str) -> DataFrame:
    g = _lags(spark, d).groupBy("type").agg(F.max("lag").alias("longest"))
    own = F.when(F.col("type") != "5-LOW", F.col("longest"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(own.desc_nulls_last(), "type")))


@query("p27_lag_bands", f"WITH {LAGS} SELECT place::INTEGER AS place, band, count(lag) AS n FROM (VALUES (0, '<30', 0, 30), (1, '30-89', 30, 90), (2, '90-364', 90, 365), (3, '365+', 365, 1000000)) b(place, band, lo, hi) LEFT JOIN lags ON lag >= lo AND lag < hi GROUP BY ALL")
def p27(spark: SparkSession, d: str) -> DataFrame:
    return distribution.histogram(_lags(spark, d), F.col("lag"), [0, 30, 90, 365], ["<30", "30-89", "90-364", "365+"])


@query("p32_growth", f"WITH {P.WORKS}, c AS (SELECT type, count(*) FILTER (WHERE publication_year = 1996) AS was, count(*) FILTER (WHERE publication_year = 2000) AS now FROM works GROUP BY 1) SELECT type, was, now, (now - was) * 100.0::DOUBLE / nullif(was, 0) AS growth FROM c")
def p32(spark: SparkSession, d: str) -> DataFrame:
    from citelode.functions.normalize import growth

    c = P.works(spark, d).groupBy("type").agg(F.count_if(F.col("publication_year") == 1996).alias("was"), F.count_if(F.col("publication_year") == 2000).alias("now"))
    return c.withColumn("growth", growth(F.col("now"), F.col("was")))


@query("e2_repeat_bands", "WITH c AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) SELECT CASE WHEN n >= 10 THEN '10+' WHEN n >= 5 THEN '5-9' WHEN n >= 2 THEN '2-4' ELSE '1' END AS band, count(*) AS suppliers FROM c GROUP BY 1")
def e2(spark: SparkSession, d: str) -> DataFrame:
    from citelode.functions.normalize import band

    c = P.lines(spark, d).where("flag = 'R' and quantity > 45").groupBy("supplier").agg(F.count_distinct("work_id").alias("n"))
    return c.groupBy(band(F.col("n"), [1, 2, 5, 10], ["1", "2-4", "5-9", "10+"]).alias("band")).agg(F.count(F.lit(1)).alias("suppliers"))


@query("e1_institutions", f"WITH {P.NATIONS} SELECT code, count(DISTINCT work_id) AS works FROM nations GROUP BY 1 ORDER BY works DESC, code LIMIT 10")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(counts.membership_counts(P.nations(spark, d).select("work_id").distinct(), P.nations(spark, d), "work_id", "code"), "works", "code", 10)
