"""Label co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators import checks, cooccur
from citelode.plans.registry import query
from citelode.sources import proxies as P
from citelode.sources import tables as T

MEMBERS = f"""{P.LABELS}, nodes0 AS (SELECT DISTINCT p_type AS l0 FROM part WHERE p_type <> 'PROMO' UNION SELECT 'NEVER'), nodes1 AS (SELECT DISTINCT p_brand AS l1 FROM part),
members AS (SELECT work_id, list_sort(list_distinct(list(l0) FILTER (WHERE l0 IN (SELECT l0 FROM nodes0)))) AS l0s, list_sort(list_distinct(list(l1))) AS l1s FROM labels_ GROUP BY 1)"""
MATRIX = f"""{MEMBERS}, m0 AS (SELECT DISTINCT work_id, l0 FROM labels_ SEMI JOIN nodes0 USING (l0)), m1 AS (SELECT DISTINCT work_id, l1 FROM labels_),
f0 AS (SELECT nodes0.l0, count(work_id) AS f_l0 FROM nodes0 LEFT JOIN m0 ON nodes0.l0 = m0.l0 GROUP BY 1), f1 AS (SELECT l1, count(*) AS f_l1 FROM m1 GROUP BY 1), j AS (SELECT l1, l0, count(*) AS f_joint FROM m1 JOIN m0 USING (work_id) GROUP BY ALL),
pairs AS (SELECT f1.l1, f0.l0, f_l1, f_l0, coalesce(f_joint, 0) AS f_joint, (SELECT count(*) FROM members) AS total, f0.l0 = CASE WHEN replace(f1.l1, 'Brand#', '')::INTEGER % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END AS is_parent_pair FROM f1 CROSS JOIN f0 LEFT JOIN j ON f1.l1 = j.l1 AND f0.l0 = j.l0),
ngds AS (SELECT *, CASE WHEN least(f_l0, f_l1) = 0 THEN 'zero_marginal' WHEN f_joint = 0 THEN 'zero_cooccurrence' WHEN f_l0 = total AND f_l1 = total THEN 'zero_denominator' ELSE 'defined' END AS ngd_status FROM pairs),
scored AS (SELECT *, CASE WHEN ngd_status = 'defined' THEN ln(greatest(f_l0, f_l1)::DOUBLE / f_joint) / ln(total::DOUBLE / least(f_l0, f_l1)) END AS ngd FROM ngds)"""


def _nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = T.load(spark, d, "part")
    n0 = p.where("p_type <> 'PROMO'").select(F.col("p_type").alias("l0")).distinct().union(spark.createDataFrame([("NEVER",)], "l0 string"))
    n1 = p.select(F.col("p_brand").alias("l1")).distinct()
    even = F.replace("l1", F.lit("Brand#"), F.lit("")).cast("int") % 2 == 0
    return n0, n1, n1.select("l1", F.when(even, "SMALL").otherwise("LARGE").alias("l0"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    n0, n1, _ = _nodes(spark, d)
    return cooccur.membership(P.labels(spark, d), n0, n1)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    n0, n1, parents = _nodes(spark, d)
    return cooccur.matrix(_members(spark, d), n0, n1, parents)


@query("n1_membership", f"WITH {MEMBERS} SELECT work_id, coalesce(l0s, []) AS l0s, l1s FROM members")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d)


@query("n2_label_audit", f"WITH {MEMBERS} SELECT 'unresolved_l0' AS kind, count(*) AS rows, count(DISTINCT work_id) AS works FROM labels_ WHERE l0 NOT IN (SELECT l0 FROM nodes0)")
def n2(spark: SparkSession, d: str) -> DataFrame:
    n0, n1_, _ = _nodes(spark, d)
    return cooccur.audit(P.labels(spark, d), n0, n1_)


@query("n3_joint_counts", f"WITH {MATRIX} SELECT l1, l0, f_joint FROM j")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.joints(_members(spark, d))


@query("n4_metrics", f"WITH {MATRIX} SELECT l1, l0, round(ngd, 9) AS ngd, ngd_status, f_joint = 0 AS zero_cooccurrence, f_joint::DOUBLE / nullif(f_l0, 0) AS joint_over_l0, f_joint::DOUBLE / nullif(f_l1, 0) AS joint_over_l1, f_joint::DOUBLE / nullif(f_l0 + f_l1 - f_joint, 0) AS jaccard FROM scored")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select("l1", "l0", F.round("ngd", 9).alias("ngd"), "ngd_status", "zero_cooccurrence", "joint_over_l0", "joint_over_l1", "jaccard")


@query("n5_full_matrix", f"WITH {MATRIX} SELECT l1, l0, f_l1, f_l0, f_joint, total, is_parent_pair FROM pairs")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select("l1", "l0", "f_l1", "f_l0", "f_joint", "total", "is_parent_pair")


@query("n6_ranks", f"WITH {MATRIX} SELECT l1, l0, CASE WHEN ngd IS NOT NULL THEN dense_rank() OVER (PARTITION BY l1, ngd IS NOT NULL ORDER BY ngd) END::INTEGER AS ngd_rank_for_l1, CASE WHEN ngd IS NOT NULL AND NOT is_parent_pair THEN dense_rank() OVER (PARTITION BY l1, ngd IS NOT NULL AND NOT is_parent_pair ORDER BY ngd) END::INTEGER AS ngd_rank_excluding_parent FROM scored")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.ranked(_matrix(spark, d)).select("l1", "l0", "ngd_rank_for_l1", "ngd_rank_excluding_parent")


@query("n7_anchor_slice", f"WITH {MATRIX} SELECT l1 AS neighbour, f_l1 AS works, f_joint AS shared FROM pairs WHERE l0 = 'SMALL'")
def n7(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).where("l0 = 'SMALL'").select(F.col("l1").alias("neighbour"), F.col("f_l1").alias("works"), F.col("f_joint").alias("shared"))


@query("n8_node_frequencies", f"WITH {MATRIX} SELECT 'l0' AS level, l0 AS node, f_l0 AS works FROM f0 UNION ALL SELECT 'l1', l1, f_l1 FROM f1")
def n8(spark: SparkSession, d: str) -> DataFrame:
    m, (n0, _, _) = _members(spark, d), _nodes(spark, d)
    a = n0.join(cooccur.marginals(m, "l0s", "l0"), "l0", "left").fillna(0, ["f_l0"]).select(F.lit("l0").alias("level"), F.col("l0").alias("node"), F.col("f_l0").alias("works"))
    return a.unionByName(cooccur.marginals(m, "l1s", "l1").select(F.lit("l1").alias("level"), F.col("l1").alias("node"), F.col("f_l1").alias("works")))


@query("n9_recount", f"WITH {MATRIX}, {P.WORKS}, again AS (SELECT l1, l0, count(*) AS f_joint FROM m1 JOIN m0 USING (work_id) JOIN works USING (work_id) WHERE l0 <> 'SMALL' OR publication_year <> 1998 GROUP BY ALL) SELECT *, 'left' AS side FROM (SELECT * FROM j EXCEPT ALL SELECT * FROM again) UNION ALL SELECT *, 'right' FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM j)")
def n9(spark: SparkSession, d: str) -> DataFrame:
    """Joint counts against a recount that is planted wrong for one label, which lacks the works of one year."""
    n0, _, _ = _nodes(spark, d)
    la = P.labels(spark, d)
    a = la.select("work_id", "l1").distinct()
    b = la.join(n0, "l0", "left_semi").select("work_id", "l0").distinct().join(P.works(spark, d).select("work_id", "publication_year"), "work_id").where("l0 <> 'SMALL' OR publication_year <> 1998")
    again = a.join(b, "work_id").groupBy("l1", "l0").agg(F.count(F.lit(1)).alias("f_joint"))
    return checks.multiset_difference(cooccur.joints(_members(spark, d)), again)


@query("n10_containment", f"WITH {MATRIX} SELECT l1, l0, f_l1, f_joint FROM pairs WHERE is_parent_pair AND f_joint <> f_l1")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.containment(_matrix(spark, d))


@query("n11_dictionary_chains", "SELECT 'NATION_' || n_nationkey AS id, 'missing_parent' AS problem FROM nation WHERE n_nationkey % 6 > 4")
def n11(spark: SparkSession, d: str) -> DataFrame:
    n = T.load(spark, d, "nation").select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 6).alias("parent"))
    return cooccur.chain_violations(n, T.load(spark, d, "region").select(F.col("r_regionkey").alias("id")))
