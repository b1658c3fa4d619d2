"""Joins, identity, set operations, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators import checks, citations, hierarchy, identity, populations
from citelode.plans.registry import query
from citelode.sources import proxies as P
from citelode.sources import tables as T


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    roles = populations.with_roles(P.works(spark, d), P.evidence(spark, d)).withColumn("date_eligible", populations.date_eligible(F.col("publication_date"), P.CUTOFF))
    return populations.eligible(roles, P.CUTOFF, P.SNAPSHOT_YEAR, F.col("type") != "5-LOW")


@query("j1_semi", f"WITH {P.WORKS}, {P.EVENTS} SELECT works.* FROM works WHERE work_id IN (SELECT work_id FROM events_ WHERE event_date > DATE '2000-01-01')")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return P.works(spark, d).join(P.events(spark, d).where("event_date > date'2000-01-01'"), "work_id", "left_semi")


@query("j3_incoming", f"WITH {P.WORKS}, {P.REFERENCES}, {P.EVENTS}, t AS (SELECT work_id FROM works SEMI JOIN events_ USING (work_id)) SELECT DISTINCT citing, cited AS target, publication_year FROM refs JOIN t ON cited = t.work_id JOIN works ON works.work_id = citing")
def j3(spark: SparkSession, d: str) -> DataFrame:
    w = P.works(spark, d)
    return citations.incoming(w, P.references(spark, d), w.join(P.events(spark, d), "work_id", "left_semi")).select("citing", "target", "publication_year")


@query("j4_label_lookup", f"WITH {P.LABELS} SELECT l0, count(*) AS n, count(r.code) AS known FROM labels_ LEFT JOIN (VALUES ('SMALL', 1), ('LARGE', 2)) r(l0, code) USING (l0) GROUP BY 1")
def j4(spark: SparkSession, d: str) -> DataFrame:
    lists = P.labels(spark, d).groupBy("work_id").agg(F.collect_list("l0").alias("ls"))
    known = T.relation(spark, [("SMALL", 1), ("LARGE", 2)], "l0 string, code int")
    return lists.select(F.explode("ls").alias("l0")).join(known, "l0", "left").groupBy("l0").agg(F.count(F.lit(1)).alias("n"), F.count("code").alias("known"))


PAPERS = """papers AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN 'd' || c_custkey END AS doi, CASE WHEN c_custkey % 3 <> 0 THEN 'p' || c_custkey END AS pmid FROM customer),
known AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 1 ELSE p_partkey END AS work_id FROM part),
by_doi AS (SELECT 'd' || k AS doi, work_id FROM known UNION SELECT 'd' || (k + 1), work_id FROM known WHERE k % 7 = 0), by_pmid AS (SELECT 'p' || k AS pmid, CASE WHEN k % 11 = 0 THEN work_id + 10 ELSE work_id END AS work_id FROM known)"""

MATCH = (
    PAPERS
    + """, dd AS (SELECT key, list(DISTINCT work_id) AS d FROM papers JOIN by_doi USING (doi) GROUP BY 1), pp AS (SELECT key, list(DISTINCT work_id) AS p FROM papers JOIN by_pmid USING (pmid) GROUP BY 1),
jj AS (SELECT papers.*, coalesce(d, []::BIGINT[]) AS d, coalesce(p, []::BIGINT[]) AS p FROM papers LEFT JOIN dd USING (key) LEFT JOIN pp USING (key)),
ll AS (SELECT *, CASE WHEN len(d) > 0 AND len(p) > 0 THEN list_intersect(d, p) ELSE list_distinct(list_concat(d, p)) END AS l FROM jj),
matches AS (SELECT key, CASE WHEN len(d) > 0 AND len(p) > 0 AND len(l) = 0 THEN 'conflicting' WHEN len(l) > 1 THEN 'ambiguous' WHEN len(l) = 1 THEN 'unique' WHEN doi IS NULL AND pmid IS NULL THEN 'absent' ELSE 'unmatched' END AS outcome, CASE WHEN len(l) = 1 THEN l[1] END AS work_id, len(l)::INTEGER AS candidates FROM ll)"""
)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records with two identifiers, parts as works: some works have two parts, some identifiers two works, and
    some pairs of identifiers disagree."""
    c = F.col("c_custkey")
    papers = T.load(spark, d, "customer").select(c.alias("key"), F.when(c % 5 != 0, F.concat(F.lit("d"), c.cast("string"))).alias("doi"), F.when(c % 3 != 0, F.concat(F.lit("p"), c.cast("string"))).alias("pmid"))
    k = F.col("p_partkey")
    known = T.load(spark, d, "part").select(k.alias("k"), F.when(k % 5 == 0, k - 1).otherwise(k).alias("work_id"))
    k = F.col("k")
    both = F.explode(F.array_compact(F.array(k, F.when(k % 7 == 0, k + 1))))
    by_doi = known.select(both.alias("n"), "work_id").select(F.concat(F.lit("d"), F.col("n").cast("string")).alias("doi"), "work_id").distinct()
    by_pmid = known.select(F.concat(F.lit("p"), k.cast("string")).alias("pmid"), F.when(k % 11 == 0, F.col("work_id") + 10).otherwise(F.col("work_id")).alias("work_id"))
    return identity.match(papers, by_doi, by_pmid)


@query("j6_identity_match", f"WITH {MATCH} SELECT * FROM matches")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


@query("j6b_shared_matches", f"WITH {MATCH}, s AS (SELECT work_id FROM matches WHERE outcome = 'unique' GROUP BY 1 HAVING count(*) > 1) SELECT key, CASE WHEN s.work_id IS NOT NULL THEN 'ambiguous' ELSE outcome END AS outcome, CASE WHEN s.work_id IS NULL THEN matches.work_id END AS work_id, candidates FROM matches LEFT JOIN s ON matches.work_id = s.work_id")
def j6b(spark: SparkSession, d: str) -> DataFrame:
    return identity.demote_shared(_matches(spark, d))


@query("j7_event_roll_up", "WITH l AS (SELECT l_suppkey AS work_id, CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END AS event_date FROM lineitem) SELECT work_id, count(*) AS originals, CASE WHEN count(DISTINCT event_date) = 1 AND count(event_date) = count(*) THEN min(event_date) END AS event_date, count(DISTINCT event_date) > 1 AS event_date_conflict FROM l GROUP BY 1")
def j7(spark: SparkSession, d: str) -> DataFrame:
    links = P.lines(spark, d).select(F.col("supplier").alias("work_id"), F.when(F.col("flag") != "N", F.col("date")).alias("event_date"))
    return identity.event_roll_up(links)


@query("j8_anti", f"WITH {P.WORKS}, {P.EVENTS} SELECT work_id FROM works WHERE is_retracted AND work_id NOT IN (SELECT work_id FROM events_)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return P.works(spark, d).where("is_retracted").select("work_id").join(P.events(spark, d), "work_id", "left_anti")


@query("j12_null_safe", f"WITH {P.WORKS}, a AS (SELECT is_retracted, count(*) AS n FROM works WHERE is_xpac GROUP BY 1), b AS (SELECT is_retracted, count(*) AS m FROM works WHERE NOT is_xpac GROUP BY 1) SELECT a.is_retracted, n, m FROM a JOIN b ON a.is_retracted IS NOT DISTINCT FROM b.is_retracted")
def j12(spark: SparkSession, d: str) -> DataFrame:
    w = P.works(spark, d)
    a = w.where("is_xpac").groupBy("is_retracted").agg(F.count(F.lit(1)).alias("n"))
    b = w.where("not is_xpac").groupBy(F.col("is_retracted").alias("_r")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, a["is_retracted"].eqNullSafe(b["_r"])).select("is_retracted", "n", "m")


CHAIN = """chain AS (SELECT DISTINCT replace(p_brand, 'Brand#', '')::BIGINT AS id, CASE WHEN replace(p_brand, 'Brand#', '')::BIGINT = 24 THEN 23 WHEN replace(p_brand, 'Brand#', '')::BIGINT = 23 THEN 24 WHEN replace(p_brand, 'Brand#', '')::BIGINT = 22 THEN 77 WHEN replace(p_brand, 'Brand#', '')::BIGINT < 2 THEN NULL ELSE replace(p_brand, 'Brand#', '')::BIGINT // 2 END AS parent FROM part)"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    i = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("bigint")
    parent = F.when(F.col("id") == 24, 23).when(F.col("id") == 23, 24).when(F.col("id") == 22, 77).when(F.col("id") >= 2, F.floor(F.col("id") / 2))
    return T.load(spark, d, "part").select(i.alias("id")).distinct().withColumn("parent", parent.cast("bigint"))


@query("j13_parent_roots", f"WITH RECURSIVE {CHAIN}, r(id, here, depth) AS (SELECT id, id, 0 FROM chain UNION ALL SELECT r.id, chain.parent, depth + 1 FROM r JOIN chain ON r.here = chain.id WHERE parent IS NOT NULL AND depth < 16) SELECT chain.id, (SELECT max(r.here) FROM r JOIN chain c ON r.here = c.id WHERE r.id = chain.id AND c.parent IS NULL) AS root FROM chain")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots(_chain(spark, d))


@query("j14_contains", f"WITH {P.LABELS}, m AS (SELECT work_id, list(DISTINCT l0) AS l0s, list(DISTINCT l1) AS l1s FROM labels_ GROUP BY 1) SELECT work_id FROM m WHERE list_contains(l0s, 'PROMO') AND list_contains(l1s, 'Brand#7')")
def j14(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).groupBy("work_id").agg(F.collect_set("l0").alias("l0s"), F.collect_set("l1").alias("l1s"))
    return m.where(F.array_contains("l0s", "PROMO") & F.array_contains("l1s", "Brand#7")).select("work_id")


@query("j17_orphan_parents", f"WITH {CHAIN} SELECT id, parent, false AS navigation_only FROM chain UNION ALL SELECT DISTINCT parent, NULL, true FROM chain WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM chain)")
def j17(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_orphans(_chain(spark, d))


@query("a10_originals", "SELECT l_orderkey AS key, count(*) AS records, min(l_linenumber) AS first_record, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS labels, min(l_shipdate)::DATE AS date, min(l_shipdate) FILTER (WHERE l_returnflag = 'R')::DATE AS event_date, count(DISTINCT l_shipdate) FILTER (WHERE l_returnflag = 'R') > 1 AS event_date_conflict FROM lineitem GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return identity.originals(P.lines(spark, d).select(F.col("work_id").alias("key"), F.col("line").alias("record_id"), F.concat("flag", "status").alias("label"), "date", F.when(F.col("flag") == "R", F.col("date")).alias("event_date")))


@query("a11_notices", "SELECT 's' || l_suppkey AS notice, l_returnflag AS nature, l_shipdate::DATE AS date, count(DISTINCT l_orderkey) AS originals, count(*) AS records FROM lineitem GROUP BY ALL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    r = P.lines(spark, d).select(F.concat(F.lit("s"), F.col("supplier").cast("string")).alias("notice"), F.col("flag").alias("nature"), "date", F.col("work_id").alias("key"))
    return identity.notices(r)


@query("a12_accounting", "SELECT CASE WHEN l_returnflag <> 'R' THEN 'excluded_nature' WHEN l_shipdate > DATE '2000-06-30' THEN 'after_cutoff' ELSE 'included' END AS state, count(*) AS records FROM lineitem GROUP BY 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("flag") != "R", "excluded_nature").when(F.col("date") > F.lit(P.CUTOFF).cast("date"), "after_cutoff").otherwise("included")
    return identity.accounting(P.lines(spark, d), state)


@query("p11_independent_notices", "WITH l AS (SELECT l_suppkey AS n, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 49) SELECT n AS notice_id, count(DISTINCT o) AS originals, NOT (n IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS independent, count(DISTINCT o) > 1 AS uncertain FROM l GROUP BY 1")
def p11(spark: SparkSession, d: str) -> DataFrame:
    links = P.lines(spark, d).where("flag = 'A' and quantity >= 49").select(F.col("supplier").alias("notice_id"), F.col("work_id").alias("original_id"))
    return identity.independent_notices(links, P.works(spark, d).where("is_retracted"))


@query("u1_union_all", f"WITH {P.WORKS} SELECT 'type' AS dimension, type AS value, count(*) AS n FROM works GROUP BY 2 UNION ALL SELECT 'year', publication_year::VARCHAR, count(*) FROM works GROUP BY 2")
def u1(spark: SparkSession, d: str) -> DataFrame:
    w = P.works(spark, d)
    a = w.groupBy(F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("dimension"), "value", "n")
    b = w.groupBy(F.col("publication_year").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("year").alias("dimension"), "value", "n")
    return a.unionByName(b)


@query("u2_symmetric_difference", f"WITH {P.WORKS}, {P.EVENTS}, a AS (SELECT work_id FROM works WHERE is_retracted), b AS (SELECT work_id FROM events_) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return checks.symmetric_difference(P.works(spark, d).where("is_retracted").select("work_id"), P.events(spark, d).select("work_id"))


@query("u4_set_algebra", "SELECT * FROM ((SELECT l_suppkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def u4(spark: SparkSession, d: str) -> DataFrame:
    a = P.lines(spark, d).where("quantity > 49").select(F.col("supplier").alias("id"))
    b = T.load(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return a.union(b).distinct().subtract(T.load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


@query("u5_multiset_difference", "WITH a AS (SELECT p_type AS l0, p_brand AS l1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'), b AS (SELECT p_type AS l0, p_brand AS l1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus <> 'F') SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def u5(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all finished lines against those of all others."""
    p = T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("l0"), F.col("p_brand").alias("l1"))
    la = P.lines(spark, d).select("part", "status").join(p, "part")
    return checks.multiset_difference(la.where("status = 'F'").select("l0", "l1"), la.where("status <> 'F'").select("l0", "l1"))


@query("v5_partition_check", f"WITH {P.WORKS} SELECT type, count(*) AS whole, count(*) FILTER (WHERE NOT is_xpac OR type = '1-URGENT') AS parts FROM works GROUP BY 1 HAVING whole <> parts")
def v5(spark: SparkSession, d: str) -> DataFrame:
    """A partition by year with planted gaps: the expansion is missing in all types but one, which alone adds up."""
    w = P.works(spark, d)
    parts = w.where(~F.col("is_xpac") | (F.col("type") == "1-URGENT")).groupBy("type", "publication_year").agg(F.count(F.lit(1)).alias("n"))
    return checks.partition_gap(parts, w.groupBy("type").agg(F.count(F.lit(1)).alias("n")), ["type"], "n")


@query("a5_duplicates", "SELECT l_orderkey - l_partkey % 41 + 8 AS cited, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY times DESC, cited LIMIT 20")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(P.references(spark, d), "cited")


@query("a26_violations", f"WITH {P.WORKS}, {P.EVENTS} SELECT rule, rows FROM (SELECT count(*) FILTER (WHERE event_date < publication_date) AS event_before_publication, count(*) FILTER (WHERE publication_date > DATE '2000-06-30') AS after_cutoff, count(*) FILTER (WHERE publication_year < 1) AS bad_year FROM works LEFT JOIN events_ USING (work_id)) UNPIVOT (rows FOR rule IN (event_before_publication, after_cutoff, bad_year))")
def a26(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).join(P.events(spark, d), "work_id", "left")
    return checks.violations(j, {"event_before_publication": F.col("event_date") < F.col("publication_date"), "after_cutoff": F.col("publication_date") > F.lit(P.CUTOFF).cast("date"), "bad_year": F.col("publication_year") < 1})


@query("a33_quality_flags", f"WITH {P.WORKS}, {P.EVENTS} SELECT flag, n FROM (SELECT count(*) FILTER (WHERE is_retracted IS NULL) AS flag_missing, count(*) FILTER (WHERE event_date IS NULL) AS event_missing, count(*) FILTER (WHERE event_date < publication_date) AS negative_lag FROM works LEFT JOIN events_ USING (work_id)) UNPIVOT (n FOR flag IN (flag_missing, event_missing, negative_lag))")
def a33(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.counts import quality_flags

    _, negative = N.lag_days(F.col("publication_date"), F.col("event_date"))
    j = P.works(spark, d).join(P.events(spark, d), "work_id", "left")
    return quality_flags(j, {"flag_missing": F.col("is_retracted").isNull(), "event_missing": F.col("event_date").isNull(), "negative_lag": negative})


@query("j5_reassembled_rows", f"WITH {P.WORKS}, {P.LABELS}, a AS (SELECT work_id, count(DISTINCT l0) AS n0 FROM labels_ GROUP BY 1), b AS (SELECT work_id, count(DISTINCT l1) AS n1 FROM labels_ WHERE l0 = 'SMALL' GROUP BY 1) SELECT work_id, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM works LEFT JOIN a USING (work_id) LEFT JOIN b USING (work_id)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    la = P.labels(spark, d)
    a = la.groupBy("work_id").agg(F.count_distinct("l0").alias("n0"))
    b = la.where("l0 = 'SMALL'").groupBy("work_id").agg(F.count_distinct("l1").alias("n1"))
    return P.works(spark, d).select("work_id").join(a, "work_id", "left").join(b, "work_id", "left").fillna(0, ["n0", "n1"])


@query("j15_parameter_list", f"WITH {P.WORKS} SELECT work_id, type FROM works WHERE work_id IN (SELECT unnest([3, 5, 7, 999999999]))")
def j15(spark: SparkSession, d: str) -> DataFrame:
    ids = T.relation(spark, [(3,), (5,), (7,), (999_999_999,)], "work_id long")
    return P.works(spark, d).join(F.broadcast(ids), "work_id", "left_semi").select("work_id", "type")


@query("a4_filtered_distinct", "SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) FILTER (WHERE l_quantity > 25) AS works, count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'F') AS suppliers FROM lineitem GROUP BY 1")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return P.lines(spark, d).groupBy("flag").agg(F.count_distinct(F.when(F.col("quantity") > 25, F.col("work_id"))).alias("works"), F.count_distinct(F.when(F.col("status") == "F", F.col("supplier"))).alias("suppliers"))


@query("v5_numerator_check", f"WITH {P.WORKS}, {P.LINES}, n AS (SELECT work_id, count(*) AS lines FROM lines GROUP BY 1), c AS (SELECT type, publication_year, (CASE WHEN type IN ('2-HIGH', '5-LOW') THEN sum(lines) ELSE count(*) FILTER (WHERE is_retracted) END)::BIGINT AS numerator, count(*) AS denominator FROM works LEFT JOIN n USING (work_id) GROUP BY type, publication_year) SELECT * FROM c WHERE numerator > denominator")
def v5n(spark: SparkSession, d: str) -> DataFrame:
    """Cells of which two types are planted wrong: they count records where the others count works."""
    n = P.lines(spark, d).groupBy("work_id").agg(F.count(F.lit(1)).alias("lines"))
    wrong = F.col("type").isin("2-HIGH", "5-LOW")
    cells = P.works(spark, d).join(n, "work_id", "left").groupBy("type", "publication_year").agg(F.when(wrong, F.sum("lines")).otherwise(F.count_if(N.is_true(F.col("is_retracted")))).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return checks.numerator_exceeds(cells)

