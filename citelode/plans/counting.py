"""Aggregations: cubes, denominators, association counts, matrices, concentration, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators import checks, counts, populations
from citelode.plans.joins import MATCH, _eligible, _matches
from citelode.plans.registry import query
from citelode.sources import proxies as P
from citelode.sources import tables as T


@query("population_accounting", f"WITH {P.ROLES}, {P.EVENTS} SELECT 'A0' AS population, count(*) AS works FROM roles WHERE NOT is_xpac AND is_retracted UNION ALL SELECT 'A1', count(*) FROM elig WHERE eligible AND is_retracted UNION ALL SELECT 'D', count(*) FROM elig WHERE eligible UNION ALL SELECT 'B', count(*) FROM events_ UNION ALL SELECT 'C', count(*) FROM events_ SEMI JOIN (SELECT work_id FROM elig WHERE eligible) USING (work_id)")
def population_accounting(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d)
    return populations.population_counts(_eligible(spark, d), e, e.select("work_id"))


@query("a13_screening_funnel", f"WITH {P.ROLES}, f AS (SELECT CASE WHEN type = '5-LOW' THEN 'type' WHEN document_role NOT IN ('original_supported', 'unresolved') THEN 'role' WHEN publication_date > DATE '2000-06-30' THEN 'date' ELSE 'retained' END AS step FROM roles WHERE NOT is_xpac AND is_retracted) SELECT step, count(*) AS works, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f) AS share FROM f GROUP BY 1")
def screening(spark: SparkSession, d: str) -> DataFrame:
    a0 = _eligible(spark, d).where("not is_xpac and is_retracted")
    return populations.funnel(a0, [("type", F.col("type") == "5-LOW"), ("role", ~F.col("document_role").isin("original_supported", "unresolved")), ("date", ~F.col("date_eligible"))])


@query("eligibility_audit", f"WITH {P.ROLES} SELECT coalesce(nullif(concat_ws('+', CASE WHEN is_xpac THEN 'expansion' END, CASE WHEN type = '5-LOW' THEN 'type' END, CASE WHEN document_role NOT IN ('original_supported', 'unresolved') THEN 'role' END, CASE WHEN publication_date > DATE '2000-06-30' THEN 'date' END), ''), 'eligible') AS reasons, count(*) AS works FROM roles GROUP BY 1")
def eligibility_audit(spark: SparkSession, d: str) -> DataFrame:
    return populations.exclusion_combinations(_eligible(spark, d), {"expansion": F.col("is_xpac"), "type": F.col("type") == "5-LOW", "role": ~F.col("document_role").isin("original_supported", "unresolved"), "date": ~F.col("date_eligible")})


@query("a1_cohort_cube", f"WITH {P.ROLES} SELECT is_xpac, type, publication_year, document_role, is_retracted, date_eligible, count(*) AS work_count FROM roles GROUP BY ALL")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return populations.cohort_cube(_eligible(spark, d))


@query("a2_merged_partials", f"WITH {P.WORKS} SELECT type, count(*) AS works FROM works GROUP BY 1")
def a2(spark: SparkSession, d: str) -> DataFrame:
    parts = P.works(spark, d).groupBy("type", (F.col("work_id") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("type").agg(F.sum("n").alias("works"))


@query("a30_cube_moves", f"WITH {P.ROLES}, c AS (SELECT type, CASE WHEN document_role = 'suspected_notice' AND type <> '5-LOW' THEN 'unresolved' ELSE document_role END AS document_role FROM roles) SELECT type, document_role, count(*) AS work_count FROM c GROUP BY ALL")
def a30(spark: SparkSession, d: str) -> DataFrame:
    cube = _eligible(spark, d).groupBy("type", "document_role").agg(F.count(F.lit(1)).alias("work_count"))
    moves = cube.where("document_role = 'suspected_notice' and type <> '5-LOW'").select("type", F.col("document_role").alias("old_role"), F.lit("unresolved").alias("new_role"), F.col("work_count").alias("moved"))
    return populations.move_roles(cube, moves, ["type"])


@query("a14_reconciliation", f"WITH {P.ROLES}, {MATCH}, o AS (SELECT matches.*, coalesce(eligible, false) AS eligible, is_retracted FROM matches LEFT JOIN elig USING (work_id)) SELECT CASE WHEN outcome <> 'unique' THEN outcome WHEN NOT eligible THEN 'matched_outside_population' WHEN is_retracted IS NULL THEN 'matched_flag_missing' WHEN is_retracted THEN 'matched_flag_true' ELSE 'matched_flag_false' END AS state, count(*) AS originals FROM o GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    e = _eligible(spark, d).select("work_id", "eligible", F.col("is_retracted").alias("flagged"))
    return populations.reconciliation(_matches(spark, d).join(e, "work_id", "left").fillna(False, ["eligible"]))


@query("a3_filtered_aggregates", f"WITH {P.WORKS} SELECT type, count(*) AS works, count(*) FILTER (WHERE is_retracted) AS flagged, count(*) FILTER (WHERE is_retracted IS NULL) AS unknown, count(DISTINCT publication_year) FILTER (WHERE is_retracted) AS flagged_years FROM works GROUP BY 1")
def a3(spark: SparkSession, d: str) -> DataFrame:
    flagged = N.is_true(F.col("is_retracted"))
    return P.works(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("works"), F.count_if(flagged).alias("flagged"), F.count_if(F.col("is_retracted").isNull()).alias("unknown"), F.count_distinct(F.when(flagged, F.col("publication_year"))).alias("flagged_years"))


@query("a6_denominators", f"WITH {P.ROLES}, b AS (SELECT * FROM elig WHERE eligible) SELECT 'type' AS dimension, type AS group_id, publication_year, count(*) AS works FROM b GROUP BY ALL UNION ALL SELECT 'flag', coalesce(is_retracted::VARCHAR, 'unknown'), publication_year, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'nation', nation::VARCHAR, publication_year, count(*) FROM b GROUP BY ALL")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return counts.denominators(_eligible(spark, d).where("eligible"), {"type": F.col("type"), "flag": F.col("is_retracted"), "nation": F.col("nation")})


@query("a7_fractional_counts", f"WITH {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY work_id) AS w FROM m) SELECT code, count(*) AS full_count, round(sum(w), 6) AS fractional_count FROM w GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return counts.associations(P.nations(spark, d), "work_id", "code")


@query("a8_membership_with_unknown", f"WITH {P.WORKS}, {P.LABELS}, m AS (SELECT DISTINCT work_id, l0 FROM labels_) SELECT coalesce(l0, 'unknown') AS l0, count(*) AS works FROM works LEFT JOIN m USING (work_id) GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return counts.membership_counts(P.works(spark, d), P.labels(spark, d), "work_id", "l0")


@query("a15_concentration", f"WITH {P.NATIONS}, c AS (SELECT code, count(DISTINCT work_id) AS n FROM nations GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, code) AS i FROM c) SELECT count(*) AS members, sum(n)::BIGINT AS total, sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)) AS hhi, sum(2 * i * n)::DOUBLE / (count(*)::DOUBLE * sum(n)) - (count(*) + 1)::DOUBLE / count(*) AS gini FROM r")
def a15(spark: SparkSession, d: str) -> DataFrame:
    c = P.nations(spark, d).groupBy("code").agg(F.count_distinct("work_id").alias("n"))
    return counts.concentration(c, "n")


@query("a16_top_union", f"WITH {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations), c AS (SELECT code, count(*) AS n FROM m GROUP BY 1), t AS (SELECT code FROM c ORDER BY n DESC, code LIMIT 5) SELECT (SELECT count(DISTINCT work_id) FROM m WHERE code IN (FROM t)) AS union_works, (SELECT count(*) FROM m WHERE code IN (FROM t)) AS top_associations, count(*) AS associations, (SELECT count(*) FROM m WHERE code IN (FROM t)) * 100.0::DOUBLE / count(*) AS association_share FROM m")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return counts.top_union(P.nations(spark, d), "work_id", "code", 5)


@query("a17_pair_counts", f"WITH {P.NATIONS}, m AS (SELECT DISTINCT work_id, code FROM nations) SELECT x.code AS a, y.code AS b, count(*) AS works FROM m x JOIN m y ON x.work_id = y.work_id AND x.code < y.code GROUP BY ALL")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return counts.pair_counts(P.nations(spark, d), "work_id", "code")


@query("a18_label_combinations", f"WITH {P.WORKS}, {P.LABELS}, s AS (SELECT work_id, string_agg(DISTINCT l0, '+' ORDER BY l0) AS labels FROM labels_ GROUP BY 1), c AS (SELECT labels, count(*) AS works FROM works LEFT JOIN s USING (work_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY works DESC, labels) AS k FROM c WHERE labels IS NOT NULL) SELECT CASE WHEN k <= 10 THEN labels ELSE 'other' END AS labels, sum(works)::BIGINT AS works FROM r GROUP BY 1 UNION ALL SELECT 'missing', works FROM c WHERE labels IS NULL")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return counts.combinations(P.works(spark, d), P.labels(spark, d), "work_id", "l0")


@query("a19_matrix", f"WITH {P.WORKS}, {P.LABELS}, m AS (SELECT DISTINCT work_id, l0, publication_year FROM labels_ JOIN works USING (work_id)), c AS (SELECT l0, publication_year, count(*) AS works FROM m GROUP BY ALL) SELECT *, sum(works) OVER (PARTITION BY l0)::BIGINT AS row_total, works * 100.0::DOUBLE / sum(works) OVER (PARTITION BY l0) AS share FROM c")
def a19(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).select("work_id", "l0").distinct().join(P.works(spark, d).select("work_id", "publication_year"), "work_id")
    return counts.matrix(m, "l0", "publication_year")


@query("a20_cohort_rate", f"WITH {P.ROLES} SELECT publication_year, type, count(*) FILTER (WHERE is_retracted) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE is_retracted) * 10000.0::DOUBLE / count(*) AS value, count(*) >= 100 AND count(*) FILTER (WHERE is_retracted) >= 20 AS ranking_eligible FROM elig WHERE eligible GROUP BY ALL")
def a20(spark: SparkSession, d: str) -> DataFrame:
    e = _eligible(spark, d).where("eligible")
    return counts.cohort_rate(e.where("is_retracted"), e, ["publication_year", "type"], least=(100, 20))


@query("a21_match_coverage", f"WITH {P.WORKS}, {P.EVENTS}, {P.LABELS}, m AS (SELECT DISTINCT work_id, l0 FROM labels_) SELECT l0, count(*) AS denominator, count(event_date) AS numerator, count(event_date) * 100.0::DOUBLE / count(*) AS value FROM m LEFT JOIN events_ USING (work_id) GROUP BY 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).select("work_id", "l0").distinct().join(P.events(spark, d), "work_id", "left")
    return counts.coverage(m, "l0", F.col("event_date").isNotNull())


@query("a22_sorted_lists", f"WITH {P.LABELS} SELECT work_id, list_sort(list_distinct(list(l1) FILTER (WHERE l0 = 'SMALL'))) AS small_brands FROM labels_ GROUP BY 1 HAVING count(*) FILTER (WHERE l0 = 'SMALL') > 0")
def a22(spark: SparkSession, d: str) -> DataFrame:
    g = P.labels(spark, d).groupBy("work_id").agg(F.array_sort(F.collect_set(F.when(F.col("l0") == "SMALL", F.col("l1")))).alias("small_brands"))
    return g.where(F.size("small_brands") > 0)


@query("a23_pivot", f"WITH {P.WORKS} SELECT publication_year, count(*) FILTER (WHERE type = '1-URGENT') AS urgent, count(*) FILTER (WHERE type = '2-HIGH') AS high, count(*) FILTER (WHERE type = '5-LOW') AS low FROM works GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    p = P.works(spark, d).groupBy("publication_year").pivot("type", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    return p.select("publication_year", F.coalesce("1-URGENT", F.lit(0)).cast("bigint").alias("urgent"), F.coalesce("2-HIGH", F.lit(0)).cast("bigint").alias("high"), F.coalesce("5-LOW", F.lit(0)).cast("bigint").alias("low"))


@query("a24_modal_names", "WITH c AS (SELECT l_suppkey AS id, p_name AS name, count(*) AS times FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT id, name, times FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY times DESC, name) = 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    j = P.lines(spark, d).select("supplier", "part").join(T.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name")), "part")
    return counts.modal_name(j.select(F.col("supplier").alias("id"), "name"), "id", "name")


@query("a25_flag_summary", f"WITH {P.WORKS}, {P.EVENTS}, f AS (SELECT type, unnest(list_filter([CASE WHEN event_date IS NULL THEN 'missing_event' END, CASE WHEN event_date < publication_date THEN 'early_event' END], lambda x: x IS NOT NULL)) AS flag FROM works LEFT JOIN events_ USING (work_id)) SELECT type, flag, count(*) AS rows FROM f GROUP BY ALL")
def a25(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).join(P.events(spark, d), "work_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("event_date").isNull(), "missing_event"), F.when(F.col("event_date") < F.col("publication_date"), "early_event")))
    return checks.flag_summary(j.withColumn("flags", flags), ["type"], "flags")


@query("a27_overlapping_populations", f"WITH {P.WORKS}, {P.EVENTS}, j AS (SELECT * FROM works LEFT JOIN events_ USING (work_id)) SELECT population, count(*) AS works, min(publication_year) AS first_year FROM (SELECT 'all' AS population, publication_year FROM j UNION ALL SELECT 'flagged', publication_year FROM j WHERE is_retracted UNION ALL SELECT 'event', publication_year FROM j WHERE event_date IS NOT NULL UNION ALL SELECT 'both', publication_year FROM j WHERE is_retracted AND event_date IS NOT NULL) GROUP BY 1")
def a27(spark: SparkSession, d: str) -> DataFrame:
    j = P.works(spark, d).join(P.events(spark, d), "work_id", "left")
    flagged, event = F.col("is_retracted"), F.col("event_date").isNotNull()
    return counts.overlapping(j, {"all": F.lit(True), "flagged": flagged, "event": event, "both": flagged & event}, [F.count(F.lit(1)).alias("works"), F.min("publication_year").alias("first_year")])


@query("a28_strata_means", "SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS type, count(*) AS n, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS flagged_mean, count(*) FILTER (WHERE o_orderstatus = 'F') AS flagged FROM orders GROUP BY ALL")
def a28(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    return T.load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(f, F.col("o_totalprice"))), 4).alias("flagged_mean"), F.count_if(f).alias("flagged"))


@query("a29_static_audit", f"WITH {P.WORKS}, {P.REFERENCES}, s AS (SELECT work_id, count(citing) AS n FROM works LEFT JOIN refs ON cited = work_id GROUP BY 1), r AS (SELECT cited AS work_id, count(DISTINCT citing) AS n FROM refs WHERE cited <> citing GROUP BY 1) SELECT count(*) FILTER (WHERE s.n = coalesce(r.n, 0)) AS equal, count(*) FILTER (WHERE s.n <> coalesce(r.n, 0)) AS different, 0::BIGINT AS missing, sum(abs(s.n - coalesce(r.n, 0)))::BIGINT AS absolute_difference FROM s LEFT JOIN r USING (work_id)")
def a29(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.citations import static_audit

    r = P.references(spark, d)
    stored = P.works(spark, d).select("work_id").join(r.groupBy(F.col("cited").alias("work_id")).agg(F.count(F.lit(1)).alias("n")), "work_id", "left").fillna(0, ["n"])
    rebuilt = r.where("cited <> citing").groupBy(F.col("cited").alias("work_id")).agg(F.count_distinct("citing").alias("n"))
    return static_audit(stored, rebuilt)


@query("a31_raw_name_coverage", "WITH n AS (SELECT l_orderkey AS k, l_linenumber % 3 = 0 AS gone FROM lineitem), p AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE gone) AS g FROM n GROUP BY 1) SELECT CASE WHEN g = 0 THEN 'complete' WHEN g = n THEN 'missing' ELSE 'partial' END AS state, count(*) AS works, sum(n)::BIGINT AS names, sum(g)::BIGINT AS missing_names FROM p GROUP BY 1")
def a31(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("line") % 3 == 0, " Unknown. ").otherwise(F.concat(F.lit("S"), F.col("supplier").cast("string")))
    return counts.name_coverage(P.lines(spark, d).select("work_id", name.alias("name")), "work_id", "name")


@query("a32_list_coverage", f"WITH {P.WORKS}, {P.LABELS}, m AS (SELECT work_id, count(DISTINCT l0) AS a, count(DISTINCT l1) AS b FROM labels_ GROUP BY 1) SELECT count(*) AS works, count(*) FILTER (WHERE coalesce(a, 0) > 0) AS with_l0, count(*) FILTER (WHERE coalesce(b, 0) > 2) AS with_three_l1 FROM works LEFT JOIN m USING (work_id)")
def a32(spark: SparkSession, d: str) -> DataFrame:
    m = P.labels(spark, d).groupBy("work_id").agg(F.collect_set("l0").alias("a"), F.collect_set("l1").alias("b"))
    j = P.works(spark, d).join(m, "work_id", "left")
    return j.agg(F.count(F.lit(1)).alias("works"), F.count_if(F.coalesce(F.size("a"), F.lit(0)) > 0).alias("with_l0"), F.count_if(F.coalesce(F.size("b"), F.lit(0)) > 2).alias("with_three_l1"))
