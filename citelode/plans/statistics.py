"""Cross-study statistics over cohorts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators import ranking, stats
from citelode.plans.disruption import WINDOWS, _windows
from citelode.plans.registry import query
from citelode.sources import proxies as P
from citelode.sources import tables as T

CELLS = "cells AS (SELECT p_brand AS subject, year(l_shipdate)::INTEGER AS year, CASE p_type WHEN 'PROMO' THEN NULL ELSE p_type END AS type, count(*) FILTER (WHERE l_returnflag = 'R') AS numerator, count(*) AS denominator FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("subject"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("type"))
    j = P.lines(spark, d).select("part", "flag", F.year("date").alias("year")).join(p, "part")
    return j.groupBy("subject", "year", "type").agg(F.count_if(F.col("flag") == "R").alias("numerator"), F.count(F.lit(1)).alias("denominator"))


@query("x1_cohorts", f"WITH {P.WORKS}, {P.EVENTS}, c AS (SELECT NOT is_xpac AND is_retracted IS TRUE AND publication_year BETWEEN 1996 AND 2000 AS in_oa, coalesce(NOT is_xpac AND year(event_date) BETWEEN 1996 AND 2000, false) AS in_rw, coalesce(publication_date > event_date, false) AS published_after FROM works LEFT JOIN events_ USING (work_id)) SELECT in_oa, in_rw, published_after, count(*) AS works FROM c GROUP BY ALL")
def x1(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).join(P.events(spark, d), "work_id", "left")
    core = ~F.col("is_xpac")
    in_oa = core & N.is_true(F.col("is_retracted")) & F.col("publication_year").between(1996, 2000)
    in_rw = N.is_true(core & F.year("event_date").between(1996, 2000))
    return j.groupBy(in_oa.alias("in_oa"), in_rw.alias("in_rw"), N.is_true(F.col("publication_date") > F.col("event_date")).alias("published_after")).agg(F.count(F.lit(1)).alias("works"))


@query("x2_scalar_pivot", f"""WITH {WINDOWS} SELECT work_id, max(cd_raw) FILTER (WHERE window_policy = 'exclude_publication_year' AND "window" = '3y') AS cd_3y, max(cd_raw) FILTER (WHERE window_policy = 'include_publication_year' AND "window" = 'lifetime') AS cd_life FROM scored WHERE valid > 0 GROUP BY 1""")
def x2(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.graph import wide

    w = wide(_windows(spark, d).where("valid > 0"), ["disruption_cd_raw_observed"])
    return w.select("work_id", F.col("disruption_cd_raw_observed_3y_exclude_publication_year").alias("cd_3y"), F.col("disruption_cd_raw_observed_lifetime_include_publication_year").alias("cd_life"))


#: The proxy's works have seven references at most, few citations, and six years of publication up to the snapshot, so
#: that no window of five years is past; three years stand for five.
VARIANTS = stats.scaled(stats.VARIANTS, 5, {"5y": "3y"})
VARIANT_SQL = f"""{WINDOWS}, scores AS (SELECT work_id, unnest(list_filter([{", ".join(f"CASE WHEN window_policy = '{p}' AND \"window\" = '{w}' AND valid >= {r} AND citation_count >= {c} AND ok THEN {{'variant': '{n}', 'score': {'cd_raw' if m == 'disruption_cd' else 'no_nr_raw'}}} END" for n, (p, w, r, c, m) in VARIANTS.items())}], lambda x: x IS NOT NULL AND x.score IS NOT NULL)) AS v FROM scored)"""


def _scores(spark: SparkSession, d: str, only: str | None = None) -> DataFrame:
    """Scores of all variants, or of one; windows that no variant asks for are not built."""
    chosen = {n: v for n, v in VARIANTS.items() if only in (None, n)}
    return stats.variant_scores(_windows(spark, d, {v[:2] for v in chosen.values()}), chosen)


@query("x3_variant_scores", f"WITH {VARIANT_SQL} SELECT work_id, v.variant AS variant, v.score AS score FROM scores")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


SUMMARY = "count(*) AS n, round(avg(score), 9) AS mean, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75, count(*) FILTER (WHERE score > 0)::DOUBLE / count(*) AS positive_share"


@query("x5_group_summary", f"WITH {VARIANT_SQL}, g AS (SELECT v.variant AS variant, v.score AS score, l0 FROM scores JOIN (SELECT DISTINCT l_orderkey AS work_id, p_type AS l0 FROM lineitem JOIN part ON l_partkey = p_partkey) USING (work_id)) SELECT variant, l0, {SUMMARY} FROM g GROUP BY ALL")
def x5(spark: SparkSession, d: str) -> DataFrame:
    j = _scores(spark, d).join(P.labels(spark, d).select("work_id", "l0").distinct(), "work_id")
    return stats.group_summary(j, ["variant", "l0"], "score")


@query("x16_global_summary", f"WITH {VARIANT_SQL} SELECT v.variant AS variant, {SUMMARY.replace('(score', '(v.score').replace('WHERE score', 'WHERE v.score')} FROM scores GROUP BY 1")
def x16(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_summary(_scores(spark, d), ["variant"], "score")


@query("x4_membership", f"WITH {VARIANT_SQL}, g AS (SELECT v.variant AS variant, work_id, l0, l1 FROM scores JOIN labels_ USING (work_id)) SELECT variant, l0, l1, count(DISTINCT work_id) AS works, count(*) AS memberships FROM (SELECT DISTINCT * FROM g) GROUP BY ALL".replace("WITH ", f"WITH {P.LABELS}, ", 1))
def x4(spark: SparkSession, d: str) -> DataFrame:
    """Scored works expanded to every pair of labels they have, each pair once."""
    j = _scores(spark, d).select("variant", "work_id").join(P.labels(spark, d).distinct(), "work_id")
    return j.groupBy("variant", "l0", "l1").agg(F.count_distinct("work_id").alias("works"), F.count(F.lit(1)).alias("memberships"))


@query("x6_strata", f"WITH {VARIANT_SQL} SELECT publication_year, type, count(*) AS n, count(*) FILTER (WHERE is_retracted) AS flagged, round(avg(v.score), 9) AS mean FROM scores JOIN works USING (work_id) WHERE v.variant = '{stats.MAIN}' GROUP BY ALL")
def x6(spark: SparkSession, d: str) -> DataFrame:
    j = _scores(spark, d, stats.MAIN).join(P.works(spark, d), "work_id")
    return j.groupBy("publication_year", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.is_true(F.col("is_retracted"))).alias("flagged"), F.round(F.avg("score"), 9).alias("mean"))


@query("x7_wilson", f"WITH {CELLS}, s AS (SELECT subject, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator FROM cells GROUP BY 1), p AS (SELECT *, numerator::DOUBLE / denominator AS p, denominator::DOUBLE AS t FROM s) SELECT subject, numerator, denominator, p AS share, round(greatest(0, (p + 1.96 * 1.96 / (2 * t) - 1.96 * sqrt(p * (1 - p) / t + 1.96 * 1.96 / (4 * t * t))) / (1 + 1.96 * 1.96 / t)), 9) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * t) + 1.96 * sqrt(p * (1 - p) / t + 1.96 * 1.96 / (4 * t * t))) / (1 + 1.96 * 1.96 / t)), 9) AS high FROM p")
def x7(spark: SparkSession, d: str) -> DataFrame:
    s = _cells(spark, d).groupBy("subject").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return stats.shares(s, ["subject"], "numerator", "denominator")


@query("x8_direct_standard", f"WITH {CELLS}, c AS (SELECT subject, year, sum(numerator) AS n, sum(denominator) AS d FROM cells GROUP BY ALL), w AS (SELECT year(l_shipdate)::INTEGER AS year, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS weight FROM lineitem GROUP BY 1) SELECT subject, round(CASE WHEN sum(weight) >= 1 - 1e-12 THEN sum(weight * n / d) END, 9) AS standardised, round(sum(weight), 9) AS weight_covered FROM c JOIN w USING (year) GROUP BY 1")
def x8(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).groupBy("subject", "year").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    w = stats.year_weights(P.lines(spark, d).select(F.year("date").alias("year")), "year")
    return stats.direct_standard(c, w, "subject", "year")


@query("x9_indirect_standard", f"WITH {CELLS}, r AS (SELECT year, type, sum(numerator)::DOUBLE / sum(denominator) AS rate FROM cells GROUP BY ALL), o AS (SELECT sum(numerator)::DOUBLE / sum(denominator) AS overall FROM cells), e AS (SELECT subject, sum(numerator)::BIGINT AS observed, round(sum(denominator * rate), 6) AS expected FROM cells c JOIN r ON c.year = r.year AND c.type IS NOT DISTINCT FROM r.type GROUP BY 1) SELECT subject, observed, expected, round(observed / expected, 6) AS ratio, round(observed / expected * overall, 6) AS standardised FROM e, o")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return stats.indirect_standard(_cells(spark, d), "subject", ["year", "type"])


@query("x10_spearman", f"WITH {CELLS}, s AS (SELECT subject, type, sum(numerator) AS a, sum(denominator) AS b FROM cells WHERE type IS NOT NULL GROUP BY ALL), r AS (SELECT type, rank() OVER (PARTITION BY type ORDER BY a) + (count(*) OVER (PARTITION BY type, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY type ORDER BY b) + (count(*) OVER (PARTITION BY type, b) - 1) / 2.0 AS rb FROM s) SELECT type, count(*) AS pairs, CASE WHEN count(*) >= 3 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN round(corr(ra, rb), 9) END AS rho FROM r GROUP BY 1")
def x10(spark: SparkSession, d: str) -> DataFrame:
    s = _cells(spark, d).where("type is not null").groupBy("subject", "type").agg(F.sum("numerator").alias("a"), F.sum("denominator").alias("b"))
    return stats.spearman(s, "a", "b", ["type"])


@query("x11_tercile_medians", f"WITH {CELLS}, s AS (SELECT subject, type, sum(numerator) AS a, sum(denominator)::BIGINT AS b FROM cells WHERE type IS NOT NULL GROUP BY ALL), t AS (SELECT *, CASE WHEN b <= quantile_cont(b, 1 / 3) OVER (PARTITION BY type) THEN 'low' WHEN b <= quantile_cont(b, 2 / 3) OVER (PARTITION BY type) THEN 'middle' ELSE 'high' END AS band FROM s) SELECT type, band, count(*) AS subjects, quantile_cont(a::DOUBLE / b, 0.5) AS median_rate FROM t GROUP BY ALL")
def x11(spark: SparkSession, d: str) -> DataFrame:
    s = _cells(spark, d).where("type is not null").groupBy("subject", "type").agg(F.sum("numerator").alias("a"), F.sum("denominator").alias("b"))
    return ranking.terciles(s, "b", ["type"]).groupBy("type", "band").agg(F.count(F.lit(1)).alias("subjects"), F.percentile(F.col("a") / F.col("b"), 0.5).alias("median_rate"))


@query("x12_high_rate_parents", f"WITH {CELLS}, s AS (SELECT subject, sum(numerator)::DOUBLE / sum(denominator) AS rate FROM cells GROUP BY 1) SELECT subject, rate FROM s WHERE rate >= (SELECT quantile_cont(rate, 0.75) FROM s)")
def x12(spark: SparkSession, d: str) -> DataFrame:
    s = _cells(spark, d).groupBy("subject").agg((F.sum("numerator") / F.sum("denominator")).alias("rate"))
    return s.crossJoin(F.broadcast(s.agg(F.percentile("rate", 0.75).alias("cut")))).where("rate >= cut").select("subject", "rate")


@query("x13_strict_children", f"WITH {P.WORKS}, {P.LABELS}, m AS (SELECT work_id, list(DISTINCT l0) AS l0s, list(DISTINCT l1) AS l1s FROM labels_ GROUP BY 1), e AS (SELECT work_id, l0s, unnest(l1s) AS l1 FROM m) SELECT l1, count(*) AS child_works, count(*) FILTER (WHERE list_contains(l0s, 'SMALL')) AS strict_works, count(*) FILTER (WHERE list_contains(l0s, 'SMALL'))::DOUBLE / count(*) AS coverage FROM e GROUP BY 1")
def x13(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).groupBy("work_id").agg(F.collect_set("l0").alias("l0s"), F.collect_set("l1").alias("l1s"))
    has = F.array_contains("l0s", "SMALL")
    return m.select("l0s", F.explode("l1s").alias("l1")).groupBy("l1").agg(F.count(F.lit(1)).alias("child_works"), F.count_if(has).alias("strict_works"), (F.count_if(has) / F.count(F.lit(1))).alias("coverage"))


@query("x14_adjusted_difference", f"WITH {VARIANT_SQL}, r AS (SELECT publication_year, type, is_retracted IS TRUE AS marked, v.score AS score FROM scores JOIN works USING (work_id) WHERE v.variant = '{stats.MAIN}'), c AS (SELECT publication_year, type, count(*) FILTER (WHERE marked) AS n1, count(*) FILTER (WHERE NOT marked) AS n0, avg(score) FILTER (WHERE marked) AS m1, avg(score) FILTER (WHERE NOT marked) AS m0 FROM r GROUP BY ALL) SELECT (SELECT round(avg(score) FILTER (WHERE marked) - avg(score) FILTER (WHERE NOT marked), 9) FROM r) AS crude, round(sum(n1 * (m1 - m0)) / sum(n1), 9) AS adjusted, coalesce(sum(n1), 0)::BIGINT AS marked_in_shared_strata FROM c WHERE n1 > 0 AND n0 > 0")
def x14(spark: SparkSession, d: str) -> DataFrame:
    j = _scores(spark, d, stats.MAIN).join(P.works(spark, d), "work_id").withColumn("marked", N.is_true(F.col("is_retracted")))
    return stats.adjusted_difference(j, ["publication_year", "type"], "marked", "score")


@query("x15_subject_correlation", f"WITH {VARIANT_SQL}, {CELLS}, g AS (SELECT v.variant AS variant, l1 AS subject, avg(v.score) AS mean, count(*) AS n FROM scores JOIN (SELECT DISTINCT l_orderkey AS work_id, p_brand AS l1 FROM lineitem JOIN part ON l_partkey = p_partkey) USING (work_id) GROUP BY ALL HAVING count(*) >= 20), s AS (SELECT subject, sum(numerator)::DOUBLE / sum(denominator) AS rate FROM cells GROUP BY 1), j AS (SELECT variant, round(mean, 9) AS mean, rate FROM g JOIN s USING (subject)), r AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY mean) + (count(*) OVER (PARTITION BY variant, mean) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY variant ORDER BY rate) + (count(*) OVER (PARTITION BY variant, rate) - 1) / 2.0 AS rb FROM j) SELECT variant, count(*) AS pairs, CASE WHEN count(*) >= 3 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN round(corr(ra, rb), 9) END AS rho FROM r GROUP BY 1")
def x15(spark: SparkSession, d: str) -> DataFrame:
    la = P.labels(spark, d).select("work_id", F.col("l1").alias("subject")).distinct()
    g = _scores(spark, d).join(la, "work_id").groupBy("variant", "subject").agg(F.round(F.avg("score"), 9).alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    s = _cells(spark, d).groupBy("subject").agg((F.sum("numerator") / F.sum("denominator")).alias("rate"))
    return stats.spearman(g.join(s, "subject"), "mean", "rate", ["variant"])


@query("x17_invariants", f"""WITH {WINDOWS} SELECT rule, rows FROM (SELECT count(*) FILTER (WHERE abs(cd_raw) > 1) AS score_bounds, count(*) FILTER (WHERE ok AND valid = 0) AS interpreted_without_references, count(*) FILTER (WHERE NOT observable AND NF IS NOT NULL) AS counts_unobservable FROM scored) UNPIVOT (rows FOR rule IN (score_bounds, interpreted_without_references, counts_unobservable))""")
def x17(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.checks import violations

    w = _windows(spark, d)
    return violations(w, {"score_bounds": F.abs(F.col("disruption_cd_raw_observed")) > 1, "interpreted_without_references": F.col("disruption_cd").isNotNull() & (F.col("valid") == 0), "counts_unobservable": F.col("observed_end_date").isNull() & F.col("NF").isNotNull()})
