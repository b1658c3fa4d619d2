
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.sources.tables import load

#: The snapshot date and year, and the first year of rates.
CUTOFF = "2000-06-30"
SNAPSHOT_YEAR = 2000
EXPANSION = "BUILDING"
MERGED_NATION = {"NATION_1": "NATION_0"}


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, publication_date, publication_year, type, is_retracted (three-valued), is_xpac, nation."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    date = F.to_date("o_orderdate")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("work_id"),
        date.alias("publication_date"),
        F.year(date).alias("publication_year"),
        F.col("o_orderpriority").alias("type"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("is_retracted"),
        (F.col("c_mktsegment") == EXPANSION).alias("is_xpac"),
        F.col("c_nationkey").alias("nation"),
    )


WORKS = """works AS (SELECT o_orderkey AS work_id, o_orderdate::DATE AS publication_date, year(o_orderdate)::INTEGER AS publication_year, o_orderpriority AS type,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_retracted, c_mktsegment = 'BUILDING' AS is_xpac, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, line, part, supplier, flag, status, date, quantity: the source records of works."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity"))


LINES = """lines AS (SELECT l_orderkey AS work_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag, l_linestatus AS status, l_shipdate::DATE AS date, l_quantity AS quantity FROM lineitem)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, event_date: the first date of a record with flag R."""
    return lines(spark, sf_dir).where(F.col("flag") == "R").groupBy("work_id").agg(F.min("date").alias("event_date"))


EVENTS = """events_ AS (SELECT l_orderkey AS work_id, min(l_shipdate)::DATE AS event_date FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, known_notice, known_original, notice_like: role evidence, for works that have any."""
    li = lines(spark, sf_dir).select("work_id", "flag", "status", "quantity")
    flags = li.select("work_id", ((F.col("flag") == "A") & (F.col("quantity") >= 48)).alias("n"), ((F.col("flag") == "R") & (F.col("status") == "F")).alias("o"), ((F.col("flag") == "N") & (F.col("quantity") <= 2)).alias("t"))
    return flags.groupBy("work_id").agg(F.bool_or("n").alias("known_notice"), F.bool_or("o").alias("known_original"), F.bool_or("t").alias("notice_like"))


EVIDENCE = """evidence AS (SELECT l_orderkey AS work_id, bool_or(l_returnflag = 'A' AND l_quantity >= 48) AS known_notice, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS known_original, bool_or(l_returnflag = 'N' AND l_quantity <= 2) AS notice_like FROM lineitem GROUP BY 1)"""

ROLES = (
    WORKS
    + ", "
    + EVIDENCE
    + """, roles AS (SELECT works.*, CASE WHEN known_notice AND known_original THEN 'conflict' WHEN known_notice THEN 'known_notice' WHEN known_original THEN 'original_supported' WHEN notice_like THEN 'suspected_notice' ELSE 'unresolved' END AS document_role,
  publication_date IS NULL OR publication_date <= DATE '2000-06-30' AS date_eligible FROM works LEFT JOIN evidence USING (work_id)),
elig AS (SELECT *, coalesce(NOT is_xpac, false) AND type <> '5-LOW' AND document_role IN ('original_supported', 'unresolved') AND publication_year BETWEEN 1 AND 2000 AND date_eligible AS eligible FROM roles)"""
)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, code: the nations of a work's suppliers."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    codes = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("code"))
    return lines(spark, sf_dir).select("work_id", "supplier").join(codes, "supplier").select("work_id", "code")


NATIONS = """nations AS (SELECT l_orderkey AS work_id, n_name AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, l0, l1: type and brand of a work's parts."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("l0"), F.col("p_brand").alias("l1"))
    return lines(spark, sf_dir).select("work_id", "part").join(p, "part").select("work_id", "l0", "l1")


LABELS = """labels_ AS (SELECT l_orderkey AS work_id, p_type AS l0, p_brand AS l1 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citing, position, cited: raw references in list order; targets may be missing, repeated or the work itself."""
    li = lines(spark, sf_dir)
    return li.select(F.col("work_id").alias("citing"), F.col("line").alias("position"), (F.col("work_id") - F.col("part") % 41 + 8).alias("cited"))


REFERENCES = """refs AS (SELECT l_orderkey AS citing, l_linenumber AS position, l_orderkey - l_partkey % 41 + 8 AS cited FROM lineitem)"""
