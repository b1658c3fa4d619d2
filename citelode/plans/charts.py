"""Composite report charts and explorer cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.functions import normalize as N
from citelode.operators import counts, distribution, hierarchy, ranking
from citelode.plans.joins import CHAIN, _chain, _eligible
from citelode.plans.registry import query
from citelode.plans.series import LAGS, _lags
from citelode.sources import proxies as P
from citelode.sources import tables as T


@query("work_types", f"WITH {P.ROLES}, f AS (SELECT * FROM roles LEFT JOIN (SELECT work_id, eligible FROM elig) USING (work_id) WHERE NOT is_xpac AND is_retracted) SELECT type, count(*) AS works, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f) AS share, count(*) FILTER (WHERE eligible) AS retained FROM f GROUP BY 1")
def work_types(spark: SparkSession, d: str) -> DataFrame:
    a0 = _eligible(spark, d).where("not is_xpac and is_retracted")
    g = a0.groupBy("type").agg(F.count(F.lit(1)).alias("works"), F.count_if("eligible").alias("retained"))
    return g.select("type", "works", (F.col("works") * 100.0 / F.sum("works").over(Window.partitionBy(F.lit(0)))).alias("share"), "retained")


ERAS = "CASE WHEN publication_year >= 2000 THEN '2000+' WHEN publication_year >= 1998 THEN '1998-1999' ELSE '1995-1997' END"


def _era():
    return N.band(F.col("publication_year"), [1995, 1998, 2000], ["1995-1997", "1998-1999", "2000+"])


@query("q2_coverage_by_era", f"WITH {P.WORKS}, {P.EVENTS} SELECT {ERAS} AS era, count(*) AS denominator, count(event_date) AS numerator, count(event_date) * 100.0::DOUBLE / count(*) AS value FROM works LEFT JOIN events_ USING (work_id) GROUP BY 1")
def q2(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).join(P.events(spark, d), "work_id", "left").withColumn("era", _era())
    return counts.coverage(j, "era", F.col("event_date").isNotNull())


@query("t1_two_clocks", f"WITH {P.WORKS}, {P.EVENTS}, j AS (SELECT * FROM events_ JOIN works USING (work_id)) SELECT clock, y::INTEGER AS year, count(c.y0) AS n FROM range(1995, 2002) r(y), (VALUES ('published'), ('retracted')) k(clock) LEFT JOIN (SELECT 'published' AS c0, publication_year AS y0 FROM j UNION ALL SELECT 'retracted', year(event_date) FROM j) c ON c0 = clock AND y0 = y GROUP BY ALL")
def t1_two_clocks(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.timeseries import yearly

    j = P.events(spark, d).join(P.works(spark, d), "work_id").withColumn("event_year", F.year("event_date"))
    out = [yearly(j, c, 1995, 2001).select(F.lit(n).alias("clock"), "year", "n") for n, c in (("published", "publication_year"), ("retracted", "event_year"))]
    return out[0].unionByName(out[1])


@query("t2_year_matrix", f"WITH {LAGS} SELECT publication_year, year(event_date)::INTEGER AS event_year, count(*) AS works FROM lags WHERE publication_year >= 1996 GROUP BY ALL")
def t2_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _lags(spark, d).where("publication_year >= 1996").groupBy("publication_year", F.year("event_date").alias("event_year")).agg(F.count(F.lit(1)).alias("works"))


@query("t3_fixed_window_rate", f"WITH {P.ROLES}, {P.EVENTS}, j AS (SELECT * FROM elig LEFT JOIN events_ USING (work_id) WHERE eligible) SELECT publication_year, k::INTEGER AS years, count(*) FILTER (WHERE event_date >= publication_date AND event_date <= (publication_date + to_years(k))::DATE) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE event_date >= publication_date AND event_date <= (publication_date + to_years(k))::DATE) * 10000.0::DOUBLE / count(*) AS value, count(*) >= 100 AND count(*) FILTER (WHERE event_date >= publication_date AND event_date <= (publication_date + to_years(k))::DATE) >= 20 AS ranking_eligible FROM j, (VALUES (1), (3), (5)) w(k) WHERE (publication_date + to_years(k))::DATE <= DATE '2000-06-30' GROUP BY ALL")
def t3_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    j = _eligible(spark, d).where("eligible").join(P.events(spark, d), "work_id", "left").withColumn("years", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    end = N.anniversary(F.col("publication_date"), F.col("years"))
    full = j.where(end <= F.lit(P.CUTOFF).cast("date"))
    hit = F.col("event_date").between(F.col("publication_date"), end)
    cells = full.groupBy("publication_year", "years").agg(F.count_if(N.is_true(hit)).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return counts.with_rate(cells, ["publication_year", "years"], least=(100, 20))


@query("t4_lag_summary", f"WITH {LAGS} SELECT count(*) AS n, round(avg(lag), 6) AS mean, quantile_cont(lag, 0.25) AS p25, quantile_cont(lag, 0.5) AS p50, quantile_cont(lag, 0.75) AS p75, quantile_cont(lag, 0.9) AS p90 FROM lags")
def t4_lag(spark: SparkSession, d: str) -> DataFrame:
    return distribution.quantile_summary(_lags(spark, d), [], "lag")


PRIMARY = "primary_ AS (SELECT l_orderkey AS work_id, arg_min(p_type, l_linenumber * 1000000 + l_partkey) AS field, arg_min(p_brand, l_linenumber * 1000000 + l_partkey) AS subfield FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _primary(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("field"), F.col("p_brand").alias("subfield"))
    first = P.lines(spark, d).select("work_id", "line", "part").join(p, "part")
    topic = F.min_by(F.struct("field", "subfield"), F.col("line") * 1_000_000 + F.col("part"))
    return first.groupBy("work_id").agg(topic.alias("primary_topic"))


@query("f1_primary_fields", f"WITH {P.WORKS}, {PRIMARY} SELECT coalesce(field, 'missing') AS field, count(*) AS works FROM works LEFT JOIN primary_ USING (work_id) WHERE is_retracted GROUP BY 1")
def f1(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).where("is_retracted").join(_primary(spark, d), "work_id", "left")
    return j.groupBy(F.coalesce("primary_topic.field", F.lit("missing")).alias("field")).agg(F.count(F.lit(1)).alias("works"))


@query("f1_any_topic", f"WITH {P.WORKS}, {P.LABELS}, m AS (SELECT DISTINCT work_id, l1 FROM labels_ JOIN works USING (work_id) WHERE is_retracted) SELECT l1 AS label, count(*) AS works FROM m GROUP BY 1 ORDER BY works DESC, label LIMIT 15")
def f1_any(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).join(P.works(spark, d).where("is_retracted").select("work_id"), "work_id", "left_semi").select("work_id", F.col("l1").alias("label")).distinct()
    return ranking.top(m.groupBy("label").agg(F.count(F.lit(1)).alias("works")), "works", "label", 15)


@query("f3_field_rates", f"WITH {P.ROLES}, {PRIMARY}, e AS (SELECT *, coalesce(field, 'missing') AS f FROM elig LEFT JOIN primary_ USING (work_id) WHERE eligible) SELECT f AS field, count(*) FILTER (WHERE is_retracted) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE is_retracted) * 10000.0::DOUBLE / count(*) AS value, count(*) >= 1000 AND count(*) FILTER (WHERE is_retracted) >= 20 AS ranking_eligible FROM e GROUP BY 1")
def f3(spark: SparkSession, d: str) -> DataFrame:
    e = _eligible(spark, d).where("eligible").join(_primary(spark, d), "work_id", "left").withColumn("field", F.coalesce("primary_topic.field", F.lit("missing")))
    return counts.cohort_rate(e.where("is_retracted"), e, ["field"])


@query("concepts_top", f"WITH {P.LABELS}, m AS (SELECT work_id, 0 AS level, l0 AS concept FROM labels_ UNION SELECT work_id, 1, l1 FROM labels_) SELECT level, concept, count(*) AS works FROM m GROUP BY level, concept QUALIFY row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, concept) <= 5")
def concepts(spark: SparkSession, d: str) -> DataFrame:
    lists = P.labels(spark, d).groupBy("work_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct(F.lit(0).alias("level"), F.col("l0").alias("concept")), F.struct(F.lit(1).alias("level"), F.col("l1").alias("concept")))))).alias("concepts"))
    n = lists.select(F.explode("concepts").alias("c")).groupBy("c.level", "c.concept").agg(F.count(F.lit(1)).alias("works"))
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("works"), "concept"))
    return n.withColumn("place", place).where("place <= 5").drop("place")


@query("concepts_coverage", f"WITH {P.WORKS}, {P.LABELS}, m AS (SELECT DISTINCT work_id FROM labels_ WHERE l0 = 'SMALL') SELECT {ERAS} AS era, count(*) AS denominator, count(m.work_id) AS numerator, count(m.work_id) * 100.0::DOUBLE / count(*) AS value FROM works LEFT JOIN m USING (work_id) GROUP BY 1")
def concepts_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).where("l0 = 'SMALL'").select("work_id").distinct().withColumn("has", F.lit(True))
    return counts.coverage(P.works(spark, d).join(m, "work_id", "left").withColumn("era", _era()), "era", F.col("has").isNotNull())


REASONS = "reasons AS (SELECT DISTINCT l_orderkey AS work_id, l_returnflag || l_linestatus AS reason FROM lineitem)"


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    return P.lines(spark, d).select("work_id", F.concat("flag", "status").alias("reason")).distinct()


@query("r1_reason_coverage", f"WITH {LAGS}, {REASONS}, t AS (SELECT count(*) AS t FROM lags) SELECT reason, count(*) AS works, count(*) * 100.0::DOUBLE / any_value(t) AS coverage FROM lags JOIN reasons USING (work_id), t GROUP BY 1")
def r1(spark: SparkSession, d: str) -> DataFrame:
    lags = _lags(spark, d).select("work_id")
    total = lags.agg(F.count(F.lit(1)).alias("t"))
    n = lags.join(_reasons(spark, d), "work_id").groupBy("reason").agg(F.count(F.lit(1)).alias("works"))
    return n.crossJoin(F.broadcast(total)).select("reason", "works", (F.col("works") * 100.0 / F.col("t")).alias("coverage"))


@query("r2_reason_by_field", f"WITH {LAGS}, {REASONS}, {PRIMARY}, j AS (SELECT reason, coalesce(field, 'missing') AS field FROM lags JOIN reasons USING (work_id) LEFT JOIN primary_ USING (work_id)), c AS (SELECT reason, field, count(*) AS works FROM j GROUP BY ALL) SELECT *, sum(works) OVER (PARTITION BY reason)::BIGINT AS row_total, works * 100.0::DOUBLE / sum(works) OVER (PARTITION BY reason) AS share FROM c")
def r2(spark: SparkSession, d: str) -> DataFrame:
    j = _lags(spark, d).select("work_id").join(_reasons(spark, d), "work_id").join(_primary(spark, d), "work_id", "left")
    return counts.matrix(j.withColumn("field", F.coalesce("primary_topic.field", F.lit("missing"))), "reason", "field")


@query("r3_reason_combinations", f"WITH {LAGS}, {REASONS}, s AS (SELECT work_id, string_agg(reason, '+' ORDER BY reason) AS labels FROM reasons GROUP BY 1), c AS (SELECT labels, count(*) AS works FROM lags LEFT JOIN s USING (work_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY works DESC, labels) AS k FROM c WHERE labels IS NOT NULL) SELECT CASE WHEN k <= 10 THEN labels ELSE 'other' END AS labels, sum(works)::BIGINT AS works FROM r GROUP BY 1 UNION ALL SELECT 'missing', works FROM c WHERE labels IS NULL")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return counts.combinations(_lags(spark, d), _reasons(spark, d), "work_id", "reason")


@query("r4_reason_lags", f"WITH {LAGS}, {REASONS} SELECT reason, count(*) AS n, CASE WHEN count(*) >= 20 THEN quantile_cont(lag, 0.5) END AS median FROM lags JOIN reasons USING (work_id) GROUP BY 1")
def r4(spark: SparkSession, d: str) -> DataFrame:
    j = _lags(spark, d).join(_reasons(spark, d), "work_id")
    return distribution.quantile_summary(j, ["reason"], "lag").select("reason", "n", F.col("p50").alias("median"))


@query("r_family_matrix", f"WITH {LAGS}, f AS (SELECT DISTINCT l_orderkey AS work_id, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'unmapped' END AS family FROM lineitem), c AS (SELECT family, publication_year, count(*) AS works FROM lags JOIN f USING (work_id) GROUP BY ALL) SELECT *, sum(works) OVER (PARTITION BY family)::BIGINT AS row_total, works * 100.0::DOUBLE / sum(works) OVER (PARTITION BY family) AS share FROM c")
def r_family(spark: SparkSession, d: str) -> DataFrame:
    m = T.relation(spark, [("R", "returned"), ("A", "accepted")], "flag string, family string")
    f = P.lines(spark, d).select("work_id", "flag").join(m, "flag", "left").select("work_id", F.coalesce("family", F.lit("unmapped")).alias("family")).distinct()
    return counts.matrix(_lags(spark, d).select("work_id", "publication_year").join(f, "work_id"), "family", "publication_year")


@query("g1_country_attribution", f"WITH {P.WORKS}, {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations SEMI JOIN (SELECT work_id FROM works WHERE is_retracted) USING (work_id)), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY work_id) AS w FROM m) SELECT code, count(*) AS full_count, round(sum(w), 6) AS fractional_count, count(*) * 100.0::DOUBLE / (SELECT count(DISTINCT work_id) FROM m) AS paper_coverage, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM m) AS association_share FROM w GROUP BY 1")
def g1_country(spark: SparkSession, d: str) -> DataFrame:
    m = P.nations(spark, d).join(P.works(spark, d).where("is_retracted").select("work_id"), "work_id", "left_semi").distinct()
    total = m.agg(F.count_distinct("work_id").alias("papers"), F.count(F.lit(1)).alias("links"))
    return counts.associations(m, "work_id", "code").crossJoin(F.broadcast(total)).select("code", "full_count", "fractional_count", (F.col("full_count") * 100.0 / F.col("papers")).alias("paper_coverage"), (F.col("full_count") * 100.0 / F.col("links")).alias("association_share"))


@query("g3_country_pairs_top", f"WITH {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations), t AS (SELECT code FROM m GROUP BY 1 ORDER BY count(*) DESC, code LIMIT 15) SELECT x.code AS a, y.code AS b, count(*) AS works FROM m x JOIN m y ON x.work_id = y.work_id AND x.code < y.code WHERE x.code IN (FROM t) AND y.code IN (FROM t) GROUP BY ALL")
def g3_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = P.nations(spark, d).distinct()
    best = ranking.top(m.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "n", "code", 15)
    return counts.pair_counts(ranking.selected(m, best, "code"), "work_id", "code")


SOURCES = "src AS (SELECT l_orderkey AS work_id, arg_min(l_suppkey, l_linenumber * 1000000 + l_partkey) AS source FROM lineitem GROUP BY 1)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return P.lines(spark, d).groupBy("work_id").agg(F.min_by("supplier", F.col("line") * 1_000_000 + F.col("part")).alias("source"))


@query("source_counts", f"WITH {P.WORKS}, {SOURCES} SELECT source, count(*) AS works FROM works JOIN src USING (work_id) WHERE is_retracted GROUP BY 1 ORDER BY works DESC, source LIMIT 50")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).where("is_retracted").select("work_id").join(_sources(spark, d), "work_id")
    return ranking.top(j.groupBy("source").agg(F.count(F.lit(1)).alias("works")), "works", "source", 50)


@query("publisher_counts", f"WITH RECURSIVE {CHAIN}, r(id, here, depth) AS (SELECT id, id, 0 FROM chain UNION ALL SELECT r.id, chain.parent, depth + 1 FROM r JOIN chain ON r.here = chain.id WHERE parent IS NOT NULL AND depth < 16), roots AS (SELECT chain.id, (SELECT max(r.here) FROM r JOIN chain c ON r.here = c.id WHERE r.id = chain.id AND c.parent IS NULL) AS root FROM chain), m AS (SELECT DISTINCT l_orderkey AS work_id, replace(p_brand, 'Brand#', '')::BIGINT AS id FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT root, count(DISTINCT work_id) AS works FROM m JOIN roots USING (id) GROUP BY 1")
def publisher_counts(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).select("work_id", F.replace("l1", F.lit("Brand#"), F.lit("")).cast("bigint").alias("id")).distinct()
    return m.join(hierarchy.roots(_chain(spark, d)), "id").groupBy("root").agg(F.count_distinct("work_id").alias("works"))


@query("p1_source_rates", f"WITH {P.ROLES}, {SOURCES} SELECT source, publication_year, count(*) FILTER (WHERE is_retracted) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE is_retracted) * 10000.0::DOUBLE / count(*) AS value, count(*) >= 10 AND count(*) FILTER (WHERE is_retracted) >= 3 AS ranking_eligible FROM elig JOIN src USING (work_id) WHERE eligible GROUP BY ALL")
def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    e = _eligible(spark, d).where("eligible").join(_sources(spark, d), "work_id")
    return counts.cohort_rate(e.where("is_retracted"), e, ["source", "publication_year"], least=(10, 3))


@query("p3_source_lags", f"WITH {LAGS}, {SOURCES} SELECT source, count(*) AS n, quantile_cont(lag, 0.5) AS median, quantile_cont(lag, 0.9) AS p90 FROM lags JOIN src USING (work_id) GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, source LIMIT 10")
def p3(spark: SparkSession, d: str) -> DataFrame:
    q = distribution.quantile_summary(_lags(spark, d).join(_sources(spark, d), "work_id"), ["source"], "lag").where("n >= 20")
    return ranking.top(q, "n", "source", 10).select("source", "n", F.col("p50").alias("median"), "p90")


PARTITIONS = {"nation_group": "CASE WHEN nation < 8 THEN 'a' WHEN nation < 16 THEN 'b' ELSE 'c' END", "flag_state": "coalesce(is_retracted::VARCHAR, 'unknown')", "team_band": "CASE WHEN coalesce(team, 0) = 0 THEN 'unknown' WHEN team = 1 THEN '1' WHEN team <= 3 THEN '2-3' ELSE '4+' END", "authorship_audit": "CASE WHEN records IS NULL THEN 'no_list' WHEN records = team THEN 'each_once' ELSE 'repeated' END"}


@query("cohort_partitions", f"WITH {P.ROLES}, {P.LINES}, t AS (SELECT work_id, count(DISTINCT supplier) AS team, count(*) AS records FROM lines GROUP BY 1), b AS (SELECT * FROM elig LEFT JOIN t USING (work_id) WHERE eligible) " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS group_id, count(*) FILTER (WHERE is_retracted) AS numerator, count(*) AS denominator FROM b GROUP BY 2" for n, e in PARTITIONS.items()))
def cohort_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Rates over four partitions of the cohort: an access-like group, a state with unknown, bands of the team's size, and
    whether the list of its members is sound. Suppliers stand for members."""
    t = P.lines(spark, d).groupBy("work_id").agg(F.count_distinct("supplier").alias("team"), F.count(F.lit(1)).alias("records"))
    b = _eligible(spark, d).where("eligible").join(t, "work_id", "left")
    team, records = F.col("team"), F.col("records")
    groups = {
        "nation_group": N.band(F.col("nation"), [0, 8, 16], ["a", "b", "c"]),
        "flag_state": F.coalesce(F.col("is_retracted").cast("string"), F.lit("unknown")),
        "team_band": F.when(F.coalesce(team, F.lit(0)) == 0, "unknown").when(team == 1, "1").when(team <= 3, "2-3").otherwise("4+"),
        "authorship_audit": F.when(records.isNull(), "no_list").when(records == team, "each_once").otherwise("repeated"),
    }
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), g.alias("group_id")) for n, g in groups.items()]))
    return b.select("is_retracted", pair.alias("p")).groupBy("p.dimension", "p.group_id").agg(F.count_if(N.is_true(F.col("is_retracted"))).alias("numerator"), F.count(F.lit(1)).alias("denominator"))


SERIES = "[" + ", ".join(["count(*)"] + [f"count(*) FILTER (WHERE publication_year = {y})" for y in range(1995, 2002)]) + "]"


@query("discipline_explorer", f"WITH {P.WORKS}, {P.LINES}, p AS (SELECT p_partkey AS part, p_type AS a, p_brand AS b, 'size' || (p_size // 10)::INTEGER AS c, 'size' || p_size AS d FROM part), x AS (SELECT work_id, p.* FROM lines JOIN p USING (part)), m AS (SELECT 'subject' AS tree, work_id, a AS node FROM x UNION SELECT 'subject', work_id, a || '/' || b FROM x UNION SELECT 'topic', work_id, a FROM x UNION SELECT 'topic', work_id, a || '/' || b FROM x UNION SELECT 'topic', work_id, a || '/' || b || '/' || c FROM x UNION SELECT 'topic', work_id, a || '/' || b || '/' || c || '/' || d FROM x UNION SELECT 'concept', work_id, c FROM x UNION SELECT 'concept', work_id, c || '/' || d FROM x UNION SELECT 'concept', work_id, c || '/' || d || '/' || a FROM x) SELECT tree, node, {SERIES} AS series FROM m JOIN works USING (work_id) GROUP BY ALL")
def discipline_explorer(spark: SparkSession, d: str) -> DataFrame:
    """Yearly series of every node of three trees: subjects in two levels, topics in four, concepts in three."""
    p = T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string")).alias("c"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("d"))
    levels = {"subject": "ab", "topic": "abcd", "concept": "cda"}
    paths = [F.struct(F.lit(t).alias("tree"), F.concat_ws("/", *names[: k + 1]).alias("node")) for t, names in levels.items() for k in range(len(names))]
    m = P.lines(spark, d).select("work_id", "part").join(p, "part").select("work_id", F.explode(F.array(*paths)).alias("m")).distinct()
    m = m.select("work_id", "m").join(P.works(spark, d).select("work_id", "publication_year"), "work_id")
    return hierarchy.node_series(m, "m", "publication_year", 1995, 2001).select("m.tree", "m.node", "series")


@query("country_explorer", f"WITH {P.ROLES}, {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations), e AS (SELECT coalesce(code, 'missing') AS code, publication_year, is_retracted FROM elig LEFT JOIN m USING (work_id) WHERE eligible) SELECT code, publication_year, count(*) FILTER (WHERE is_retracted) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE is_retracted) * 10000.0::DOUBLE / count(*) AS value, count(*) >= 100 AND count(*) FILTER (WHERE is_retracted) >= 20 AS ranking_eligible FROM e GROUP BY ALL")
def country_explorer(spark: SparkSession, d: str) -> DataFrame:
    e = _eligible(spark, d).where("eligible").join(P.nations(spark, d).distinct(), "work_id", "left").withColumn("code", F.coalesce("code", F.lit("missing")))
    return counts.cohort_rate(e.where("is_retracted"), e, ["code", "publication_year"], least=(100, 20))


@query("country_tree", f"WITH {P.NATIONS} SELECT r_name AS region, count(DISTINCT work_id) AS works, count(DISTINCT code) AS nations FROM nations JOIN nation ON code = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def country_tree(spark: SparkSession, d: str) -> DataFrame:
    tree = T.load(spark, d, "nation").join(T.load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("code"), F.col("r_name").alias("region"))
    return P.nations(spark, d).join(tree, "code").groupBy("region").agg(F.count_distinct("work_id").alias("works"), F.count_distinct("code").alias("nations"))


@query("tree_additivity", "WITH v AS (SELECT n_regionkey AS parent, count(c_custkey) AS children, count(c_custkey) FILTER (WHERE n_regionkey <> 1 OR c_acctbal >= 0) AS own FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT parent::BIGINT AS parent, children, own FROM v WHERE children <> own")
def tree_additivity(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation and region; the total of one region is planted wrong, it lacks those in debt."""
    n = T.load(spark, d, "nation")
    c = T.load(spark, d, "customer")
    by = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col("c_acctbal") >= 0).alias("sound"))
    leaf = n.select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("parent"), F.col("n_nationkey").alias("k"))
    cells = leaf.join(by, "k", "left").fillna(0, ["v", "sound"]).select("id", "parent", "v", "sound")
    top = cells.groupBy(F.col("parent").alias("id")).agg(F.sum(F.when(F.col("parent") == 1, F.col("sound")).otherwise(F.col("v"))).alias("v"))
    nodes = leaf.select("id", "parent").unionByName(top.select("id", F.lit(None).cast("bigint").alias("parent")))
    return hierarchy.additivity(cells.select("id", "v").unionByName(top), nodes, "v")


@query("v1_subject_trends", f"WITH {P.WORKS}, {P.EVENTS}, {P.LABELS}, m AS (SELECT DISTINCT l.work_id, l0, year(event_date) AS y FROM labels_ l JOIN events_ USING (work_id)), c AS (SELECT l0, count(*) FILTER (WHERE y = 1999) AS was, count(*) FILTER (WHERE y = 2000) AS now FROM m GROUP BY 1) SELECT l0, was, now, (now - was) * 100.0::DOUBLE / nullif(was, 0) AS growth FROM c")
def v1_trends(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).select("work_id", "l0").distinct().join(P.events(spark, d), "work_id")
    c = m.groupBy("l0").agg(F.count_if(F.year("event_date") == 1999).alias("was"), F.count_if(F.year("event_date") == 2000).alias("now"))
    return c.withColumn("growth", N.growth(F.col("now"), F.col("was")))


@query("v1_peak_year", f"WITH {P.WORKS}, {P.EVENTS}, {P.LABELS}, m AS (SELECT DISTINCT l.work_id, l0, year(event_date)::INTEGER AS year FROM labels_ l JOIN events_ USING (work_id)), c AS (SELECT l0, year, count(*) AS works FROM m GROUP BY ALL) SELECT l0, year AS peak_year, works FROM c QUALIFY row_number() OVER (PARTITION BY l0 ORDER BY works DESC, year) = 1")
def v1_peak(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).select("work_id", "l0").distinct().join(P.events(spark, d), "work_id")
    c = m.groupBy("l0", F.year("event_date").alias("year")).agg(F.count(F.lit(1)).alias("works"))
    return c.groupBy("l0").agg(F.min_by(F.struct("year", "works"), F.struct(-F.col("works"), "year")).alias("p")).select("l0", F.col("p.year").alias("peak_year"), F.col("p.works").alias("works"))


@query("event_year_cohort", f"WITH {P.EVENTS}, {P.LABELS}, m AS (SELECT work_id, list(DISTINCT l0) FILTER (WHERE l0 <> 'PROMO') AS ls FROM labels_ GROUP BY 1), j AS (SELECT year(event_date)::INTEGER AS event_year, unnest(CASE WHEN ls IS NULL OR len(ls) = 0 THEN ['missing'] ELSE ls END) AS subject FROM events_ LEFT JOIN m USING (work_id) WHERE year(event_date) BETWEEN 1996 AND 2000) SELECT event_year, subject, count(*) AS works FROM j GROUP BY ALL")
def event_year_cohort(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).groupBy("work_id").agg(F.collect_set(F.when(F.col("l0") != "PROMO", F.col("l0"))).alias("ls"))
    j = P.events(spark, d).where(F.year("event_date").between(1996, 2000)).join(m, "work_id", "left")
    subjects = F.when(F.coalesce(F.size("ls"), F.lit(0)) == 0, F.array(F.lit("missing"))).otherwise(F.col("ls"))
    return j.select(F.year("event_date").alias("event_year"), F.explode(subjects).alias("subject")).groupBy("event_year", "subject").agg(F.count(F.lit(1)).alias("works"))


@query("reader_map_classes", f"WITH {P.NATIONS}, c AS (SELECT n_name AS code, count(DISTINCT work_id) AS works FROM nation LEFT JOIN nations ON code = n_name GROUP BY 1), m AS (SELECT max(works) AS top FROM c) SELECT code, works, CASE WHEN works = 0 THEN 'missing' WHEN works < 20 THEN 'small' ELSE 'value' END AS class, least(4, 1 + works * 4 // top)::INTEGER AS quarter FROM c, m")
def map_classes(spark: SparkSession, d: str) -> DataFrame:
    n = P.nations(spark, d).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("works"))
    c = T.load(spark, d, "nation").select(F.col("n_name").alias("code")).join(n, "code", "left").fillna(0, ["works"])
    m = c.agg(F.max("works").alias("top"))
    w = F.col("works")
    return c.crossJoin(F.broadcast(m)).select("code", "works", F.when(w == 0, "missing").when(w < 20, "small").otherwise("value").alias("class"), F.least(F.lit(4), F.floor(w * 4 / F.col("top")) + 1).cast("int").alias("quarter"))


@query("reader_log_axis", f"WITH {P.NATIONS} SELECT code, round(log10(count(*)), 9) AS log10, round(ln(1 + count(*)), 9) AS log1p FROM nations GROUP BY 1")
def log_axis(spark: SparkSession, d: str) -> DataFrame:
    n = P.nations(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return n.select("code", F.round(F.log10("n"), 9).alias("log10"), F.round(F.log1p("n"), 9).alias("log1p"))


@query("labels_unknown_bucket", "SELECT coalesce(quality::VARCHAR, 'unknown') AS quality, count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def labels_unknown(spark: SparkSession, d: str) -> DataFrame:
    j = T.load(spark, d, "documents").select("doc_id").join(T.load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality")).agg(F.count(F.lit(1)).alias("documents"))


@query("daily_events", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    from citelode.streaming.daily import daily_counts

    return daily_counts(T.load(spark, d, "events"))
