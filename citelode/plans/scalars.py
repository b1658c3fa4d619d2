"""Sources, projections and scalar normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators import populations
from citelode.plans.registry import query
from citelode.sources import proxies as P
from citelode.sources import tables as T


@query("s1_scan", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s2_file_list", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return T.load_files(spark, [f"{d}/nation.parquet"]).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("s4_source_file", "SELECT 'region.parquet' AS source_file, count(*) AS n FROM region")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return T.load_glob(spark, f"{d}/region.parquet", with_file=True).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("s5_relation", "SELECT n_name AS code, target FROM nation JOIN (VALUES ('NATION_1', 'NATION_0'), ('NATION_99', 'NATION_0')) m(code, target) ON n_name = m.code")
def s5(spark: SparkSession, d: str) -> DataFrame:
    merges = T.relation(spark, [("NATION_1", "NATION_0"), ("NATION_99", "NATION_0")], "code string, target string")
    return T.load(spark, d, "nation").select(F.col("n_name").alias("code")).join(merges, "code")


@query("s11_manifest_accounting", "SELECT 'lineitem' AS entity, count(*) + 1 AS rows, count(*) AS file_rows FROM lineitem")
def s11(spark: SparkSession, d: str) -> DataFrame:
    names = ("orders", "lineitem", "part")
    counted = None
    for n in names:
        one = T.load(spark, d, n).agg(F.lit(n).alias("entity"), F.lit(f"{n}.parquet").alias("path"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("bytes"))
        counted = one if counted is None else counted.unionByName(one)
    stated = counted.select("entity", (F.col("rows") + F.when(F.col("entity") == "lineitem", 1).otherwise(0)).alias("rows"), "bytes")
    return T.manifest_accounting(counted, stated).select("entity", "rows", "file_rows")


@query("s12_footprint", "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def s12(spark: SparkSession, d: str) -> DataFrame:
    both = T.footprint(T.load(spark, d, "orders"), "orders").unionByName(T.footprint(T.load(spark, d, "part"), "part"))
    return both.select("table_name", "row_count")


@query("s13_schema_paths", "SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(path, type)")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(T.schema_paths(spark.read.parquet(f"{d}/customer.parquet").schema), "path string, type string")


@query("s14_unlisted_files", "SELECT 'region.parquet' AS path")
def s14(spark: SparkSession, d: str) -> DataFrame:
    found = T.load_glob(spark, f"{d}/region.parquet", with_file=True).select("source_file").union(T.load_glob(spark, f"{d}/nation.parquet", with_file=True).select("source_file"))
    return T.unlisted(found.select(F.col("source_file").alias("path")).distinct(), spark.createDataFrame([("nation.parquet",)], "path string"))


@query("s21_csv_safe", "SELECT event_id, CASE WHEN regexp_matches(t, '^[=+@\\-\\t\\r]') THEN '''' || t ELSE t END AS safe FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || event_type AS t FROM events)")
def s21(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events")
    sign = F.get(F.array(*[F.lit(x) for x in "=+-@"], F.lit("")), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", N.csv_safe(F.concat(sign, "event_type")).alias("safe"))


RAW_DOI = """raw AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN ' https://DOI.org/10.' || (1000 + p_partkey) || '/AB%2F' || p_size WHEN 1 THEN 'doi:10.' || (10000 + p_partkey) || '/x' || p_size
  WHEN 2 THEN '10.1/short' WHEN 3 THEN 'http://dx.doi.org/10.5555/a b' WHEN 4 THEN NULL ELSE '' END AS doi FROM part)"""


def _raw_doi(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit(" https://DOI.org/10."), (k + 1000).cast("string"), F.lit("/AB%2F"), size))
        .when(k % 6 == 1, F.concat(F.lit("doi:10."), (k + 10000).cast("string"), F.lit("/x"), size))
        .when(k % 6 == 2, "10.1/short")
        .when(k % 6 == 3, "http://dx.doi.org/10.5555/a b")
        .when(k % 6 == 5, "")
    )
    return T.load(spark, d, "part").select(k.alias("id"), raw.alias("doi"))


@query("p1_doi_strict", f"WITH {RAW_DOI}, c AS (SELECT id, regexp_replace(lower(trim(url_decode(doi))), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '') AS x FROM raw) SELECT id, CASE WHEN regexp_full_match(x, '10\\.\\d{{4,9}}/\\S+') THEN x END AS doi FROM c")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return _raw_doi(spark, d).select("id", N.doi(F.col("doi")).alias("doi"))


@query("p1b_doi_loose", f"WITH {RAW_DOI} SELECT id, nullif(regexp_replace(lower(trim(url_decode(doi))), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '') AS doi FROM raw")
def p1b(spark: SparkSession, d: str) -> DataFrame:
    return _raw_doi(spark, d).select("id", N.doi(F.col("doi"), strict=False).alias("doi"))


@query("p2_pmid", "WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/00' || c_custkey || '/' WHEN 1 THEN ' ' || c_custkey WHEN 2 THEN '0' ELSE 'PMC' || c_custkey END AS p FROM customer), c AS (SELECT id, regexp_replace(trim(p), '^https?://(www\\.)?(pubmed\\.ncbi\\.nlm\\.nih\\.gov|ncbi\\.nlm\\.nih\\.gov/pubmed)/|/+$', '', 'g') AS x FROM r) SELECT id, CASE WHEN regexp_full_match(x, '\\d+') AND NOT regexp_full_match(x, '0+') THEN ltrim(x, '0') END AS pmid, CASE WHEN regexp_full_match(x, '\\d+') AND NOT regexp_full_match(x, '0+') THEN x END AS pmid_text FROM c")
def p2(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/00"), k.cast("string"), F.lit("/"))).when(k % 4 == 1, F.concat(F.lit(" "), k.cast("string"))).when(k % 4 == 2, "0").otherwise(F.concat(F.lit("PMC"), k.cast("string")))
    return T.load(spark, d, "customer").select(k.alias("id"), N.pmid(raw).alias("pmid"), N.pmid(raw, keep_text=True).alias("pmid_text"))


@query("p3_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders")
def p3(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 3 == 0, F.concat(F.date_format(t, "M/d/yyyy"), F.lit(" 0:00"))).when(k % 3 == 1, F.date_format(t, "yyyy-MM-dd")).otherwise("no date")
    return T.load(spark, d, "orders").select(k.alias("id"), N.date_of(raw).alias("day"))


@query("p4_split_list", "SELECT p_partkey AS id, list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ' ; ' || p_type || ';;' || p_name, ';'), lambda x: trim(x)), lambda x: x <> ''))) AS parts FROM part")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), N.split_list(F.concat("p_name", F.lit(" ; "), "p_type", F.lit(";;"), "p_name")).alias("parts"))


@query("p5_work_numbers", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 AND o_orderkey > 0 THEN o_orderkey END AS number FROM orders")
def p5(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 5 < 3, F.concat(F.lit("https://example.org/W"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("https://example.org/W0"), k.cast("string"))).otherwise(F.concat(F.lit("https://example.org/W99999999999999999999"), k.cast("string")))
    return T.load(spark, d, "orders").select(k.alias("id"), N.numbered_id(raw, "https://example.org/W").alias("number"))


@query("p6_nested_projection", "SELECT p_partkey AS id, p_type AS domain_id, p_brand AS field_id, p_size AS level FROM part")
def p6(spark: SparkSession, d: str) -> DataFrame:
    nested = T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.struct(F.struct(F.col("p_type").alias("id")).alias("domain"), F.struct(F.col("p_brand").alias("id")).alias("field"), F.col("p_size").alias("level")).alias("primary_topic"))
    return nested.select("id", F.col("primary_topic.domain.id").alias("domain_id"), F.col("primary_topic.field.id").alias("field_id"), F.col("primary_topic.level").alias("level"))


@query("p7_date_flags", f"WITH {P.WORKS}, {P.EVENTS} SELECT work_id, list_filter([CASE WHEN event_date IS NULL THEN 'missing_event' END, CASE WHEN event_date < publication_date THEN 'event_before_publication' END, CASE WHEN publication_date > DATE '2000-06-30' THEN 'after_snapshot' END], lambda x: x IS NOT NULL) AS flags FROM works LEFT JOIN events_ USING (work_id)")
def p7(spark: SparkSession, d: str) -> DataFrame:
    w = P.works(spark, d).join(P.events(spark, d), "work_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("event_date").isNull(), "missing_event"), F.when(F.col("event_date") < F.col("publication_date"), "event_before_publication"), F.when(F.col("publication_date") > F.lit(P.CUTOFF).cast("date"), "after_snapshot")))
    return w.select("work_id", flags.alias("flags"))


@query("p8_title_notices", "SELECT doc_id, regexp_matches(text, '(?i)^\\s*(the|and|in)\\b') AS notice FROM documents")
def p8(spark: SparkSession, d: str) -> DataFrame:
    notice = F.when(F.col("text").isNotNull(), N.notice_title(F.col("text"), ("the", "and", "in")))
    return T.load(spark, d, "documents").select("doc_id", notice.alias("notice"))


@query("p10_document_roles", f"WITH {P.ROLES} SELECT document_role, count(*) AS works FROM roles GROUP BY 1")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return populations.with_roles(P.works(spark, d), P.evidence(spark, d)).groupBy("document_role").agg(F.count(F.lit(1)).alias("works"))


@query("p12_date_eligible", f"WITH {P.WORKS} SELECT work_id, publication_date IS NULL OR publication_date <= DATE '2000-06-30' AS date_eligible FROM works")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return P.works(spark, d).select("work_id", populations.date_eligible(F.col("publication_date"), P.CUTOFF).alias("date_eligible"))


COARSE = """coarse AS (SELECT work_id, publication_year, CASE work_id % 4 WHEN 0 THEN strftime(publication_date, '%Y') WHEN 1 THEN strftime(publication_date, '%Y-%m') WHEN 2 THEN strftime(publication_date, '%Y-%m-%d') END AS t FROM works),
spans AS (SELECT work_id, coalesce(CASE length(t) WHEN 10 THEN t::DATE WHEN 7 THEN (t || '-01')::DATE WHEN 4 THEN (t || '-01-01')::DATE END, make_date(publication_year, 1, 1)) AS lo, coalesce(CASE length(t) WHEN 10 THEN t::DATE WHEN 7 THEN last_day((t || '-01')::DATE) WHEN 4 THEN (t || '-12-31')::DATE END, make_date(publication_year, 12, 31)) AS hi FROM coarse)"""


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    w = P.works(spark, d)
    k = F.col("work_id") % 4
    text = F.when(k == 0, F.date_format("publication_date", "yyyy")).when(k == 1, F.date_format("publication_date", "yyyy-MM")).when(k == 2, F.date_format("publication_date", "yyyy-MM-dd"))
    lo, hi = N.date_interval(F.col("t"), F.col("publication_year"))
    return w.withColumn("t", text).select("work_id", lo.alias("lo"), hi.alias("hi"))


@query("p13_date_intervals", f"WITH {P.WORKS}, {COARSE} SELECT * FROM spans")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return _coarse(spark, d)


@query("p14_interval_timing", f"WITH {P.WORKS}, {P.EVENTS}, {COARSE} SELECT CASE WHEN event_date IS NULL THEN 'undated' WHEN hi < event_date THEN 'before' WHEN lo > event_date THEN 'after' ELSE 'ambiguous' END AS state, count(*) AS n FROM spans LEFT JOIN events_ USING (work_id) GROUP BY 1")
def p14(spark: SparkSession, d: str) -> DataFrame:
    j = _coarse(spark, d).join(P.events(spark, d), "work_id", "left")
    return j.groupBy(N.timing(F.col("lo"), F.col("hi"), F.col("event_date"), F.col("event_date")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_anniversaries", f"WITH {P.WORKS} SELECT work_id, (publication_date + INTERVAL 1 YEAR)::DATE AS y1, (publication_date + INTERVAL 5 YEAR)::DATE AS y5 FROM works")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return P.works(spark, d).select("work_id", N.anniversary(F.col("publication_date"), 1).alias("y1"), N.anniversary(F.col("publication_date"), 5).alias("y5"))


@query("p17_merged_countries", f"WITH {P.NATIONS}, c AS (SELECT work_id, CASE code WHEN 'NATION_1' THEN 'NA' WHEN 'NATION_10' THEN 'NA' ELSE 'N' || chr(65 + (replace(code, 'NATION_', '')::INTEGER % 26)) END AS code FROM nations) SELECT work_id, list_sort(list_distinct(list(code))) AS codes FROM c GROUP BY 1")
def p17(spark: SparkSession, d: str) -> DataFrame:
    n = P.nations(spark, d)
    code = F.concat(F.lit("N"), F.expr("chr(65 + cast(replace(code, 'NATION_', '') as int) % 26)"))
    lists = n.select("work_id", code.alias("code")).groupBy("work_id").agg(F.collect_list("code").alias("codes"))
    return lists.select("work_id", N.merged_codes(F.col("codes"), {"NB": "NA", "NK": "NA"}).alias("codes"))


@query("p18_nested_flatten", "SELECT l_orderkey AS work_id, list_sort(list_distinct(list(n_name) FILTER (WHERE s_acctbal >= 0))) AS codes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) FILTER (WHERE s_acctbal >= 0) > 0")
def p18(spark: SparkSession, d: str) -> DataFrame:
    s = T.load(spark, d, "supplier").join(T.load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    li = P.lines(spark, d).select("work_id", "supplier", "flag")
    j = li.join(s.select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("code"), "s_acctbal"), "supplier")
    institutions = j.groupBy("work_id", "flag").agg(F.collect_list(F.struct("code", "s_acctbal")).alias("institutions"))
    nested = institutions.groupBy("work_id").agg(F.collect_list(F.struct("institutions")).alias("authorships"))
    codes = F.flatten(F.transform("authorships", lambda a: F.transform(F.filter(a["institutions"], lambda i: i["s_acctbal"] >= 0), lambda i: i["code"])))
    return nested.select("work_id", F.array_sort(F.array_distinct(codes)).alias("codes")).where(F.size("codes") > 0)


@query("p19_collaboration", f"WITH {P.NATIONS}, c AS (SELECT work_id, count(DISTINCT code) AS n FROM nations GROUP BY 1), l AS (SELECT l_orderkey AS work_id, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1) SELECT CASE WHEN n >= 2 THEN 'multi_country_observed' WHEN complete IS NULL THEN 'completeness_unknown' WHEN complete THEN 'single_country' ELSE 'single_country_incomplete' END AS class, count(*) AS works FROM c JOIN l USING (work_id) GROUP BY 1")
def p19(spark: SparkSession, d: str) -> DataFrame:
    c = P.nations(spark, d).groupBy("work_id").agg(F.collect_set("code").alias("codes"))
    complete = P.lines(spark, d).groupBy("work_id").agg(F.bool_and(F.col("status") == "F").alias("complete"))
    return c.join(complete, "work_id").groupBy(N.collaboration(F.col("codes"), F.col("complete")).alias("class")).agg(F.count(F.lit(1)).alias("works"))


@query("p20_valid_ids", "SELECT l_orderkey AS work_id, len(list_distinct(list(l_suppkey) FILTER (WHERE l_suppkey % 7 <> 0)))::INTEGER AS valid FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_suppkey % 7 <> 0) > 0")
def p20(spark: SparkSession, d: str) -> DataFrame:
    ids = P.lines(spark, d).groupBy("work_id").agg(F.collect_list("supplier").alias("ids"))
    return ids.select("work_id", F.size(F.array_distinct(F.filter("ids", lambda x: x % 7 != 0))).alias("valid")).where("valid > 0")


@query("p21_team_bands", "SELECT CASE WHEN n >= 7 THEN '7+' WHEN n >= 4 THEN '4-6' WHEN n >= 2 THEN '2-3' ELSE '1' END AS band, count(*) AS works FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def p21(spark: SparkSession, d: str) -> DataFrame:
    n = P.lines(spark, d).groupBy("work_id").agg(F.count_distinct("supplier").alias("n"))
    return n.groupBy(N.band(F.col("n"), [1, 2, 4, 7], ["1", "2-3", "4-6", "7+"]).alias("band")).agg(F.count(F.lit(1)).alias("works"))


@query("p22_concept_levels", "SELECT l_orderkey AS work_id, list_sort(list_distinct(list(p_brand) FILTER (WHERE p_size % 2 = 0 AND p_brand LIKE 'Brand#1%'))) AS ids FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) FILTER (WHERE p_size % 2 = 0 AND p_brand LIKE 'Brand#1%') > 0")
def p22(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.struct(F.col("p_brand").alias("id"), (F.col("p_size") % 2).alias("level")).alias("concept"))
    lists = P.lines(spark, d).select("work_id", "part").join(p, "part").groupBy("work_id").agg(F.collect_list("concept").alias("concepts"))
    kept = F.array_distinct(F.transform(F.filter("concepts", lambda c: (c["level"] == 0) & c["id"].rlike("^Brand#1")), lambda c: c["id"]))
    return lists.select("work_id", F.array_sort(kept).alias("ids")).where(F.size("ids") > 0)


@query("p23_early_years", f"WITH {P.WORKS} SELECT CASE WHEN publication_year < 1998 THEN 0 ELSE publication_year END AS year, count(*) AS works FROM works GROUP BY 1")
def p23(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("publication_year")
    return P.works(spark, d).groupBy(F.when(y < 1998, 0).otherwise(y).alias("year")).agg(F.count(F.lit(1)).alias("works"))


NAMES = ["  [Unknown] ", "NOT   available.", "Anna Unknownsen", "", "N/A", "Affliation unknown;", "No affiliation found -", "affiliation not provided  to SSRN", "Nullarbor Institute", "not Specified", "None such", "unavailable"]


@query("p24_placeholders", "SELECT event_id, event_id % 13 IN (0, 1, 3, 4, 5, 6, 7, 9, 11) AS missing FROM events")
def p24(spark: SparkSession, d: str) -> DataFrame:
    """Twelve names in turn, and the event's own type; which of them are placeholders stands in the SQL."""
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % 13).cast("int")), F.col("event_type"))
    return T.load(spark, d, "events").select("event_id", N.is_missing_name(name).alias("missing"))


@query("p24b_nfkc", "SELECT c_custkey AS id, 'unknown' AS key FROM customer")
def p24b(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.nfkc_key(F.lit(" Ｕnknown. ")).alias("key"))


@query("p25_subjects", "SELECT p_partkey AS id, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type ELSE 'UNKNOWN' END AS parent, p_name AS label FROM part")
def p25(spark: SparkSession, d: str) -> DataFrame:
    parent, label = N.subject(F.concat(F.lit("("), "p_type", F.lit(") "), "p_name"), ("SMALL", "LARGE"))
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent"), label.alias("label"))


@query("p26_families", "SELECT coalesce(family, 'unmapped') AS family, count(*) AS n FROM part LEFT JOIN (VALUES ('SMALL', 'size'), ('LARGE', 'size'), ('MEDIUM', 'size'), ('PROMO', 'sale')) m(p_type, family) USING (p_type) GROUP BY 1")
def p26(spark: SparkSession, d: str) -> DataFrame:
    m = T.relation(spark, [("SMALL", "size"), ("LARGE", "size"), ("MEDIUM", "size"), ("PROMO", "sale")], "p_type string, family string")
    return T.load(spark, d, "part").join(m, "p_type", "left").groupBy(F.coalesce("family", F.lit("unmapped")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("p28_lag_days", f"WITH {P.WORKS}, {P.EVENTS} SELECT work_id, CASE WHEN event_date >= publication_date THEN date_diff('day', publication_date, event_date) END::INTEGER AS lag, coalesce(event_date < publication_date, false) AS negative FROM works JOIN events_ USING (work_id)")
def p28(spark: SparkSession, d: str) -> DataFrame:
    lag, negative = N.lag_days(F.col("publication_date"), F.col("event_date"))
    return P.works(spark, d).join(P.events(spark, d), "work_id").select("work_id", lag.alias("lag"), negative.alias("negative"))


@query("p29_list_states", "SELECT CASE WHEN n IS NULL THEN 'null' WHEN n = 0 THEN 'empty' ELSE 'present' END AS state, count(*) AS works FROM (SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN count(*) FILTER (WHERE l_returnflag = 'R') END AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) GROUP BY 1")
def p29(spark: SparkSession, d: str) -> DataFrame:
    lists = P.lines(spark, d).groupBy("work_id").agg(F.collect_list(F.when(F.col("flag") == "R", F.col("line"))).alias("list"))
    return P.works(spark, d).select("work_id").join(lists, "work_id", "left").groupBy(N.list_state(F.col("list")).alias("state")).agg(F.count(F.lit(1)).alias("works"))


@query("p34_cell_metrics", "WITH t AS (SELECT o_orderpriority AS type, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, count(*) AS d, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders GROUP BY 1) SELECT type, n::DOUBLE AS count, n * 100.0::DOUBLE / total AS share, n * 10000.0::DOUBLE / d AS rate, n * 100.0::DOUBLE / d AS proportion FROM t")
def p34(spark: SparkSession, d: str) -> DataFrame:
    o = T.load(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "F").alias("f"))
    total = o.agg(F.count_if("f").alias("t"))
    cells = o.groupBy("type").agg(F.count_if("f").alias("n"), F.count(F.lit(1)).alias("d")).crossJoin(F.broadcast(total))
    return cells.select("type", *[N.metric(k, F.col("n"), F.col("d"), F.col("t")).alias(k) for k in ("count", "share", "rate", "proportion")])


@query("json_props", "SELECT try_cast(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "events").groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_glob", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return T.load_glob(spark, f"{d}/natio*.parquet").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("s26_named_views", "SELECT count(*) AS works, count(DISTINCT o_custkey) AS holders FROM orders WHERE o_orderstatus = 'F'")
def s26(spark: SparkSession, d: str) -> DataFrame:
    from citelode.sources.sinks import result_views

    result_views({"flagged_works": T.load(spark, d, "orders").where("o_orderstatus = 'F'")})
    return spark.sql("SELECT count(*) AS works, count(DISTINCT o_custkey) AS holders FROM flagged_works")


@query("p16_follow_up_spans", f"WITH {P.EVENTS} SELECT work_id, k, event_date + 1 AS first_day, (event_date + to_years(k))::DATE + 1 AS end_day FROM events_, (VALUES (1), (3), (5)) w(k) WHERE (event_date + to_years(k))::DATE <= DATE '2000-06-30'")
def p16(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    end = N.anniversary(F.col("event_date"), F.col("k"))
    return e.where(end <= F.lit(P.CUTOFF).cast("date")).select("work_id", "k", F.date_add("event_date", 1).alias("first_day"), F.date_add(end, 1).alias("end_day"))


@query("p30_exclude_replace", "SELECT * EXCLUDE (o_totalprice, o_custkey) REPLACE (upper(o_orderstatus) AS o_orderstatus, o_orderdate::DATE AS o_orderdate) FROM orders")
def p30(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "orders").drop("o_totalprice", "o_custkey").withColumns({"o_orderstatus": F.upper("o_orderstatus"), "o_orderdate": F.to_date("o_orderdate")})


@query("p31_rounded_values", "SELECT o_orderpriority AS type, round(sum(o_totalprice) / 7, 2) AS value FROM orders GROUP BY 1")
def p31(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.round(F.sum("o_totalprice") / 7, 2).alias("value"))


@query("p35_insight_text", f"WITH {P.WORKS}, c AS (SELECT type, count(*) AS n FROM works WHERE is_retracted GROUP BY 1 ORDER BY n DESC, type LIMIT 1) SELECT type || ' has the most flagged works: ' || n AS insight FROM c")
def p35(spark: SparkSession, d: str) -> DataFrame:
    c = P.works(spark, d).where("is_retracted").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(1)
    return c.select(F.format_string("%s has the most flagged works: %d", "type", "n").alias("insight"))


@query("v1_run_id", "SELECT sha256('{\"cutoff\":\"2000-06-30\",\"policy\":\"strict\"}') AS run_id, count(*) AS works FROM orders")
def run_id(spark: SparkSession, d: str) -> DataFrame:
    config = F.to_json(F.struct(F.lit(P.CUTOFF).alias("cutoff"), F.lit("strict").alias("policy")))
    return T.load(spark, d, "orders").agg(F.sha2(F.first(config), 256).alias("run_id"), F.count(F.lit(1)).alias("works"))
