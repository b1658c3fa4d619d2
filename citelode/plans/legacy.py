"""Charts of the first report: leaders, lags, samples; publisher rates; the source gate as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.operators import counts, distribution, hierarchy
from citelode.plans import charts, cooccurrence, scalars  # noqa: F401 (their checks are gates)
from citelode.plans.joins import _eligible
from citelode.plans.registry import ORACLE_SQL, QUERIES, query
from citelode.plans.series import LAGS, _lags
from citelode.sources import proxies as P

PUBLISHERS = f"{charts.CHAIN}, r(id, here, depth) AS (SELECT id, id, 0 FROM chain UNION ALL SELECT r.id, chain.parent, depth + 1 FROM r JOIN chain ON r.here = chain.id WHERE parent IS NOT NULL AND depth < 16), roots AS (SELECT chain.id, (SELECT max(r.here) FROM r JOIN chain c ON r.here = c.id WHERE r.id = chain.id AND c.parent IS NULL) AS root FROM chain), pub AS (SELECT DISTINCT l_orderkey AS work_id, coalesce(root, -1) AS publisher FROM lineitem JOIN part ON l_partkey = p_partkey JOIN roots ON id = replace(p_brand, 'Brand#', '')::BIGINT)"


@query("p1_publisher_rates", f"WITH RECURSIVE {P.ROLES}, {PUBLISHERS} SELECT publisher, publication_year, count(*) FILTER (WHERE is_retracted) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE is_retracted) * 10000.0::DOUBLE / count(*) AS value, count(*) >= 10 AND count(*) FILTER (WHERE is_retracted) >= 3 AS ranking_eligible FROM elig JOIN pub USING (work_id) WHERE eligible GROUP BY ALL")
def p1_publisher_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of publishers at the root of their groups; a work counts once for each of its publishers. Those
    whose group has no root are one group, -1."""
    own = P.labels(spark, d).select("work_id", F.replace("l1", F.lit("Brand#"), F.lit("")).cast("bigint").alias("id")).distinct()
    pub = own.join(hierarchy.roots(charts._chain(spark, d)), "id").select("work_id", F.coalesce("root", F.lit(-1).cast("bigint")).alias("publisher")).distinct()
    e = _eligible(spark, d).where("eligible").join(pub, "work_id")
    return counts.cohort_rate(e.where("is_retracted"), e, ["publisher", "publication_year"], least=(10, 3))


@query("v1_leaders", f"WITH {P.EVENTS}, {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations SEMI JOIN events_ USING (work_id)), n AS (SELECT work_id, count(*) AS k FROM m GROUP BY 1) SELECT code, count(*) AS full_count, round(sum(1.0::DOUBLE / k), 6) AS fractional_count FROM m JOIN n USING (work_id) GROUP BY 1 ORDER BY full_count DESC, code LIMIT 15")
def v1_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The nations with most works that have an event, counted whole and in equal parts."""
    m = P.nations(spark, d).distinct().join(P.events(spark, d).select("work_id"), "work_id", "left_semi")
    parts = m.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("work_id")))
    return parts.groupBy("code").agg(F.count(F.lit(1)).alias("full_count"), F.round(F.sum(1.0 / F.col("k")), 6).alias("fractional_count")).orderBy(F.desc("full_count"), "code").limit(15)


BANDS = [0, 31, 91, 366, 731]
NAMES = ["month", "quarter", "year", "two_years", "longer"]


@query("v1_lag_stats", f"WITH {LAGS}, b AS (SELECT CASE WHEN lag < 31 THEN 'month' WHEN lag < 91 THEN 'quarter' WHEN lag < 366 THEN 'year' WHEN lag < 731 THEN 'two_years' ELSE 'longer' END AS band FROM lags) SELECT place::INTEGER AS place, band, count(b.band) AS n FROM (VALUES (0, 'month'), (1, 'quarter'), (2, 'year'), (3, 'two_years'), (4, 'longer')) s(place, band) LEFT JOIN b USING (band) GROUP BY ALL")
def v1_lag_stats(spark: SparkSession, d: str) -> DataFrame:
    """Works by the time from publication to event; empty bands are there with 0."""
    return distribution.histogram(_lags(spark, d), F.col("lag"), BANDS, NAMES)


@query("v1_samples", f"WITH {P.WORKS}, {P.EVENTS}, h AS (SELECT work_id, type, sha256(work_id::VARCHAR) AS hash FROM works SEMI JOIN events_ USING (work_id)) SELECT work_id, type FROM h ORDER BY hash, work_id LIMIT 36")
def v1_samples(spark: SparkSession, d: str) -> DataFrame:
    """A sampling report: the 36 works with the least hashes, the same on every run."""
    w = P.works(spark, d).join(P.events(spark, d), "work_id", "left_semi")
    return w.select("work_id", "type", F.sha2(F.col("work_id").cast("string"), 256).alias("hash")).orderBy("hash", "work_id").limit(36).drop("hash")


GATES = {"partitions_add_up": "v5_partition_check", "numerators_within": "v5_numerator_check", "trees_add_up": "tree_additivity", "paths_listed": "s14_unlisted_files", "manifest_agrees": "s11_manifest_accounting", "counts_recounted": "n9_recount", "chains_resolve": "n11_dictionary_chains", "labels_contained": "n10_containment"}


@query("v6_source_gate", " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) AS failures, count(*) = 0 AS passed FROM ({ORACLE_SQL[q]})" for g, q in GATES.items()))
def v6_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every check of sources and results with the rows that break it; the gate is open where there are none."""
    out = None
    for gate, name in GATES.items():
        one = QUERIES[name](spark, d).agg(F.lit(gate).alias("gate"), F.count(F.lit(1)).alias("failures")).withColumn("passed", F.col("failures") == 0)
        out = one if out is None else out.unionByName(one)
    return out
