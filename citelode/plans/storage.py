"""Sources and sinks as round trips, stored edges, shard checkpoints, names for readers, and a table function."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import fixed
from citelode.functions import normalize as N
from citelode.operators import graph
from citelode.plans.disruption import ANNUAL, AUDIT, EDGES, FOCAL, _annual, _focal
from citelode.plans.registry import query
from citelode.sources import checkpoints, scratch, sinks
from citelode.sources import proxies as P
from citelode.sources import tables as T


@query("s7_csv", """SELECT c_custkey AS id, c_name || ' "q", ' || chr(10) || 'x' AS name, c_acctbal AS balance, CASE WHEN c_custkey % 2 = 0 THEN '''=1+1' ELSE 'plain' END AS formula FROM customer""")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Customers with quotes, commas, line breaks and formulas, through S18's gzip CSV and back."""
    c = T.load(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(' "q", \nx')).alias("name"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 2 == 0, "=1+1").otherwise("plain").alias("formula"))
    out = scratch.path(spark, "csv")
    sinks.write_text(rows, out)
    return T.load_csv(spark, out, "id bigint, name string, balance double, formula string")


@query("s8_json", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Nations as one JSON document over many lines, read whole."""
    n = T.load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    out = scratch.path(spark, "json")
    doc = n.agg(F.to_json(F.collect_list(F.struct("*")), {"pretty": "true"}).alias("value"))  # a dictionary
    doc.coalesce(1).write.text(out)
    return T.load_json(spark, out, "id bigint, name string, region bigint")


@query("s9_jsonl", f"WITH {P.WORKS} SELECT work_id, publication_date, type, is_retracted FROM works")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Works through S18's gzip JSON lines and back under a schema; a null flag stays null."""
    out = scratch.path(spark, "jsonl")
    sinks.write_text(P.works(spark, d).select("work_id", "publication_date", "type", "is_retracted"), out, "json")
    return T.load_jsonl(spark, out, "work_id bigint, publication_date date, type string, is_retracted boolean")


@query("s16_parquet", f"WITH {P.WORKS} SELECT type, publication_year, count(*) AS works, min(work_id) AS first FROM works GROUP BY ALL")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Works as Parquet by type and back; the type is read from the folders."""
    out = scratch.path(spark, "parquet")
    sinks.write_parquet(P.works(spark, d).select("work_id", "publication_year", "type"), out, ["type"])
    return spark.read.parquet(out).groupBy(F.col("type").cast("string").alias("type"), "publication_year").agg(F.count(F.lit(1)).alias("works"), F.min("work_id").alias("first"))


@query("s17_typed_tables", f"WITH {P.WORKS} SELECT 'flagged' AS name, count(*) AS rows, sum(work_id)::BIGINT AS ids FROM works WHERE is_retracted UNION ALL SELECT 'dates', count(*), sum(year(publication_date))::BIGINT FROM works")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of one base."""
    w, out = P.works(spark, d), scratch.path(spark, "typed")
    sinks.write_tables(w, {"flagged": w.where("is_retracted").select("work_id"), "dates": w.select("publication_date")}, out)
    a = spark.read.parquet(f"{out}/flagged").agg(F.lit("flagged").alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("work_id").alias("ids"))
    b = spark.read.parquet(f"{out}/dates").agg(F.lit("dates").alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(F.year("publication_date").cast("bigint")).alias("ids"))
    return a.unionByName(b)


@query("s19_sections", "SELECT 'regions' AS section, r_regionkey::BIGINT AS id, r_name AS name, 64 AS digest_length FROM region UNION ALL SELECT 'nations', n_nationkey, n_name, 64 FROM nation")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Two dictionaries as sections with their digests, taken apart again."""
    r = T.load(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    n = T.load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    chunks = sinks.section_chunks({"regions": r, "nations": n})
    rows = [(k, t, len(chunks["manifest"][k])) for k, t in chunks["sections"].items()]
    sections = spark.createDataFrame(rows, "section string, body string, digest_length int")
    return sections.select("section", F.explode(F.from_json("body", "array<struct<id:bigint,name:string>>")).alias("x"), "digest_length").select("section", "x.id", "x.name", "digest_length")


@query("s20_packed_rows", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary packed into a text and unpacked."""
    n = T.load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return T.relation(spark, [(r["id"], r["name"]) for r in sinks.unpack_rows(sinks.pack_rows([r.asDict() for r in n.collect()]))], "id bigint, name string")


@query("s10_stored_edges", f"WITH {EDGES} SELECT cited, count(*) AS degree, md5(string_agg(citing::VARCHAR, ',' ORDER BY citing)) AS adjacency FROM edges GROUP BY 1")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency lists straight from the stored buckets."""
    name = f"citelode_edges_{uuid.uuid4().hex}"
    stored = checkpoints.store_edges(graph.canonical_edges(P.references(spark, d), _edges_nodes(spark, d)).select("citing", "cited"), name, scratch.path(spark, "edges"), "cited", 16)
    lists = stored.groupBy("cited").agg(F.sort_array(F.collect_list("citing")).alias("a"))
    return lists.select("cited", F.size("a").cast("bigint").alias("degree"), F.md5(F.array_join(F.transform("a", lambda x: x.cast("string")), ",").cast("binary")).alias("adjacency"))


def _edges_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.works(spark, d).select("work_id", F.when(F.col("work_id") % 97 != 0, F.col("publication_year")).alias("year"))


@query("v2_shard_checkpoints", f"WITH {P.WORKS} SELECT publication_year AS year, CASE WHEN publication_year = 1998 THEN 2 ELSE 1 END AS times_made, count(*) AS works FROM works WHERE publication_year BETWEEN 1996 AND 1999 GROUP BY 1")
def v2(spark: SparkSession, d: str) -> DataFrame:
    """Shards by year, asked for twice; between the two the inputs of one year change, and only that one is made again."""
    w, root = P.works(spark, d), scratch.path(spark, "shards")
    years = range(1996, 2000)

    def asked(changed: int | None) -> dict:
        return {str(y): (f"v{2 if y == changed else 1}", lambda y=y: w.where(F.col("publication_year") == y).select("work_id")) for y in years}

    first = checkpoints.run_shards(spark, root, asked(None))
    second = checkpoints.run_shards(spark, root, asked(1998))
    times = T.relation(spark, [(y, int(first[str(y)]) + int(second[str(y)])) for y in years], "year int, times_made int")
    rows = spark.read.parquet(*[f"{root}/{y}" for y in years]).withColumn("year", F.regexp_extract(F.input_file_name(), r"/(\d{4})/[^/]*$", 1).cast("int"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("works")).join(times, "year")


@query("p33_readable", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'main topic of research articles' WHEN 1 THEN 'xcore_article, core_articles' WHEN 2 THEN 'all works/publishing group' ELSE 'core_all2 (common five-year cohort)' END AS label FROM events")
def p33(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, "primary_topic of core_article").when(k == 1, "xcore_article, core_articles").when(k == 2, "core_all/root_publisher").otherwise("core_all2 (common_5y)")
    return T.load(spark, d, "events").select("event_id", N.readable(text, fixed.READABLE).alias("label"))


@query("g12_table_function", f"WITH {AUDIT}, {ANNUAL}, {FOCAL}, f AS (SELECT work_id, CASE WHEN year <= 2000 THEN 2000 - year END AS observed_age_end FROM focal), g AS (SELECT f.*, sum(NF) AS a, sum(NB) AS b, sum(NR) AS c FROM f LEFT JOIN annual ON f.work_id = annual.work_id AND age_year BETWEEN 2 AND least(3, observed_age_end) GROUP BY ALL) SELECT work_id, CASE WHEN observed_age_end >= 2 THEN coalesce(a, 0)::BIGINT END AS NF, CASE WHEN observed_age_end >= 2 THEN coalesce(b, 0)::BIGINT END AS NB, CASE WHEN observed_age_end >= 2 THEN coalesce(c, 0)::BIGINT END AS NR FROM g")
def g12_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The ad-hoc age range as a SQL table function over named views."""
    _annual(spark, d).createOrReplaceTempView("citelode_annual")
    _focal(spark, d).select("work_id", F.when(F.col("year") <= P.SNAPSHOT_YEAR, P.SNAPSHOT_YEAR - F.col("year")).alias("observed_age_end")).createOrReplaceTempView("citelode_focal")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION disruption_age_range(first_age INT, last_age INT)
    RETURNS TABLE(work_id BIGINT, NF BIGINT, NB BIGINT, NR BIGINT)
    RETURN SELECT work_id, open + coalesce(sum(NF), 0), open + coalesce(sum(NB), 0), open + coalesce(sum(NR), 0) FROM (
      SELECT work_id, CASE WHEN first_age <= observed_age_end THEN 0 END AS open, CASE WHEN counted THEN NF END AS NF, CASE WHEN counted THEN NB END AS NB, CASE WHEN counted THEN NR END AS NR FROM (
        SELECT f.work_id, f.observed_age_end, a.NF, a.NB, a.NR, a.age_year >= first_age AND a.age_year <= least(last_age, f.observed_age_end) AS counted
        FROM citelode_focal f LEFT JOIN citelode_annual a ON f.work_id = a.work_id))
    GROUP BY work_id, open""")
    return spark.sql("SELECT * FROM disruption_age_range(2, 3)")
