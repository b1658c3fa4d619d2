"""Citation graph and event-relative citations."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators import checks, citations, graph
from citelode.plans.registry import query
from citelode.sources import proxies as P

NODES = f"{P.WORKS}, {P.REFERENCES}, nodes AS (SELECT work_id, CASE WHEN work_id % 97 <> 0 THEN publication_year END AS year FROM works)"
EDGES = f"""{NODES}, edges AS MATERIALIZED (SELECT DISTINCT citing, cited, a.year AS citing_year, b.year AS cited_year FROM refs JOIN nodes a ON citing = a.work_id JOIN nodes b ON cited = b.work_id WHERE citing <> cited)"""
AUDIT = f"""{EDGES}, once AS (SELECT citing, cited, count(*) AS times, cited IN (SELECT work_id FROM nodes) AS known FROM refs GROUP BY ALL),
raw AS (SELECT citing, sum(times)::BIGINT AS raw, 0::BIGINT AS invalid, sum(times - 1)::BIGINT AS duplicate, count(*) FILTER (WHERE cited = citing) AS self_loop, count(*) FILTER (WHERE cited <> citing AND NOT known) AS dangling FROM once GROUP BY 1),
kinds AS (SELECT citing, count(*) AS resolved, count(*) FILTER (WHERE cited_year < citing_year) AS valid, count(*) FILTER (WHERE cited_year = citing_year) AS same_year, count(*) FILTER (WHERE cited_year > citing_year) AS future_year, count(*) FILTER (WHERE cited_year IS NULL OR citing_year IS NULL) AS unknown_year FROM edges GROUP BY 1),
audit AS (SELECT raw.*, coalesce(resolved, 0) AS resolved, coalesce(valid, 0) AS valid, coalesce(same_year, 0) AS same_year, coalesce(future_year, 0) AS future_year, coalesce(unknown_year, 0) AS unknown_year FROM raw LEFT JOIN kinds USING (citing))"""
ANNUAL = """masks AS (SELECT focal, citer, min(age) AS age, bit_or(m) AS mask FROM (SELECT cited AS focal, citing AS citer, citing_year - cited_year AS age, 1 AS m FROM edges WHERE citing_year >= cited_year AND citing_year <= 2000
  UNION ALL SELECT f.citing, c.citing, c.citing_year - f.citing_year, 2 FROM edges f JOIN edges c ON f.cited = c.cited WHERE f.cited_year < f.citing_year AND c.citing_year >= f.citing_year AND c.citing_year <= 2000 AND c.citing <> f.citing) GROUP BY ALL),
annual AS MATERIALIZED (SELECT m.*, coalesce(citation_count, 0) AS citation_count, future_related_count FROM (SELECT focal AS work_id, age::INTEGER AS age_year, count(*) FILTER (WHERE mask = 1) AS NF, count(*) FILTER (WHERE mask = 3) AS NB, count(*) FILTER (WHERE mask = 2) AS NR, count(DISTINCT citer) AS future_related_count FROM masks GROUP BY ALL) m
  LEFT JOIN (SELECT cited AS work_id, citing_year - cited_year AS age_year, count(*) AS citation_count FROM edges WHERE citing_year >= cited_year AND citing_year <= 2000 GROUP BY ALL) d USING (work_id, age_year))"""
FOCAL = """focal AS MATERIALIZED (SELECT nodes.*, nodes.work_id % 89 = 0 AS list_unknown, coalesce(valid, 0) AS valid, coalesce(raw, 0) AS raw, s.stored_count - coalesce(indegree, 0) AS stored_delta FROM nodes LEFT JOIN audit ON citing = work_id LEFT JOIN (SELECT cited AS work_id, count(*) AS indegree FROM edges GROUP BY 1) i USING (work_id) LEFT JOIN (SELECT cited AS work_id, count(*) AS stored_count FROM refs GROUP BY 1) s USING (work_id))"""
WINDOWS = f"""{AUDIT}, {ANNUAL}, {FOCAL},
defs AS (SELECT * FROM (VALUES ('exclude_publication_year', 1), ('include_publication_year', 0)) p(window_policy, start_age), (VALUES ('3y', 3), ('5y', 5), ('10y', 10), ('lifetime', NULL)) w("window", k)),
wide_ AS (SELECT f.*, window_policy, "window", start_age, k, make_date(year + start_age, 1, 1) AS planned_start_date, CASE WHEN k IS NOT NULL THEN make_date(year + start_age + k - 1, 12, 31) END AS planned_end_date FROM focal f, defs),
seen AS (SELECT *, coalesce(planned_start_date <= DATE '2000-06-30', false) AS observable FROM wide_),
sums AS (SELECT s.work_id, window_policy, "window", sum(NF)::BIGINT AS NF, sum(NB)::BIGINT AS NB, sum(NR)::BIGINT AS NR, sum(citation_count)::BIGINT AS citation_count, sum(future_related_count)::BIGINT AS future_related_count FROM seen s JOIN annual a ON s.work_id = a.work_id AND age_year >= start_age AND (k IS NULL OR age_year < start_age + k) GROUP BY ALL),
counted AS (SELECT s.*, CASE WHEN observable THEN coalesce(NF, 0) END AS NF, CASE WHEN observable THEN coalesce(NB, 0) END AS NB, CASE WHEN observable THEN coalesce(NR, 0) END AS NR, CASE WHEN observable THEN coalesce(citation_count, 0) END AS citation_count, CASE WHEN observable THEN coalesce(future_related_count, 0) END AS future_related_count,
  planned_end_date <= DATE '2000-06-30' AS is_mature, CASE WHEN observable THEN least(coalesce(planned_end_date, DATE '2000-06-30'), DATE '2000-06-30') END AS observed_end_date FROM seen s LEFT JOIN sums USING (work_id, window_policy, "window")),
scored AS MATERIALIZED (SELECT *, (NF - NB)::DOUBLE / nullif(NF + NB + NR, 0) AS cd_raw, (NF - NB)::DOUBLE / nullif(NF + NB, 0) AS no_nr_raw, observable AND valid > 0 AND NOT list_unknown AND (k IS NULL OR coalesce(is_mature, false)) AS ok FROM counted)"""
FLAGS = """flagged AS (SELECT *, CASE WHEN ok THEN cd_raw END AS cd, CASE WHEN ok THEN no_nr_raw END AS no_nr, CASE WHEN year IS NULL THEN 'unavailable_publication_year' WHEN observable THEN 'complete' ELSE 'unobservable' END AS status,
  list_filter([CASE WHEN year + start_age > 9999 OR year + start_age + k - 1 > 9999 THEN 'unrepresentable_window_bounds' END, CASE WHEN valid = 0 THEN 'no_references' END, CASE WHEN year IS NULL OR list_unknown THEN 'incomplete_record' END, CASE WHEN is_mature = false THEN 'insufficient_observation_window' END, CASE WHEN k IS NULL THEN 'snapshot_limited' END, CASE WHEN stored_delta <> 0 THEN 'stored_citation_count_warning' END, CASE WHEN citation_count = 0 THEN 'no_future_citations' END, CASE WHEN NF + NB + NR = 0 THEN 'empty_denominator_cd' END, CASE WHEN NF + NB = 0 THEN 'empty_denominator_no_nr' END, CASE WHEN citation_count <> NF + NB THEN 'citation_partition_warning' END, CASE WHEN future_related_count <> NF + NB + NR THEN 'neighborhood_partition_warning' END], lambda x: x IS NOT NULL) AS flags FROM scored)"""
METRICS = (("NF", "NF"), ("NB", "NB"), ("NR", "NR"), ("citation_count", "citation_count"), ("future_related_count", "future_related_count"), ("is_mature", "is_mature"), ("cd_raw", "disruption_cd_raw_observed"), ("no_nr_raw", "disruption_no_nr_raw_observed"), ("cd", "disruption_cd"), ("no_nr", "disruption_no_nr"), ("flags", "flags"), ("status", "computation_status"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.works(spark, d).select("work_id", F.when(F.col("work_id") % 97 != 0, F.col("publication_year")).alias("year"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Canonical edges, kept for the several aggregates that read them; what is lost is made again from the tables."""
    return graph.canonical_edges(P.references(spark, d), _nodes(spark, d)).persist(StorageLevel.MEMORY_AND_DISK)


def _annual(spark: SparkSession, d: str) -> DataFrame:
    return graph.annual(_edges(spark, d), P.SNAPSHOT_YEAR)


def _focal(spark: SparkSession, d: str) -> DataFrame:
    nodes, refs, edges = _nodes(spark, d), P.references(spark, d), _edges(spark, d)
    stored = refs.groupBy(F.col("cited").alias("work_id")).agg(F.count(F.lit(1)).alias("stored_count"))
    return graph.focal_stats(nodes, graph.reference_audit(refs, nodes, edges), edges, stored).withColumn("list_unknown", F.col("work_id") % 89 == 0)


def _windows(spark: SparkSession, d: str, only: set[tuple[str, str]] | None = None) -> DataFrame:
    return graph.windows(_focal(spark, d).select("work_id", "year", "valid", "raw", "stored_delta", "list_unknown"), _annual(spark, d), P.CUTOFF, only)


@query("g1_canonical_edges", f"WITH {EDGES} SELECT * FROM edges")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("citing", "cited", "citing_year", "cited_year")


@query("g2_reference_audit", f"WITH {AUDIT} SELECT * FROM audit")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return graph.reference_audit(P.references(spark, d), _nodes(spark, d), _edges(spark, d))


@query("g3_focal_stats", f"WITH {AUDIT}, i AS (SELECT cited AS work_id, count(*) AS indegree, count(*) FILTER (WHERE citing_year = cited_year) AS incoming_same_year, count(*) FILTER (WHERE citing_year < cited_year) AS incoming_earlier_year, count(*) FILTER (WHERE citing_year > cited_year) AS incoming_later_year, count(*) FILTER (WHERE citing_year IS NULL OR cited_year IS NULL) AS incoming_unknown_year FROM edges GROUP BY 1), s AS (SELECT cited AS work_id, count(*) AS stored_count FROM refs GROUP BY 1) SELECT nodes.*, coalesce(raw, 0) AS raw, coalesce(valid, 0) AS valid, coalesce(duplicate, 0) AS duplicate, coalesce(self_loop, 0) AS self_loop, coalesce(dangling, 0) AS dangling, coalesce(indegree, 0) AS indegree, coalesce(incoming_same_year, 0) AS incoming_same_year, coalesce(incoming_earlier_year, 0) AS incoming_earlier_year, coalesce(incoming_later_year, 0) AS incoming_later_year, coalesce(incoming_unknown_year, 0) AS incoming_unknown_year, stored_count - coalesce(indegree, 0) AS stored_delta FROM nodes LEFT JOIN audit ON citing = work_id LEFT JOIN i USING (work_id) LEFT JOIN s USING (work_id)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return _focal(spark, d).select("work_id", "year", "raw", "valid", "duplicate", "self_loop", "dangling", "indegree", "incoming_same_year", "incoming_earlier_year", "incoming_later_year", "incoming_unknown_year", "stored_delta")


@query("g4_annual_counts", f"WITH {EDGES}, {ANNUAL} SELECT work_id, age_year, NF, NB, NR, citation_count, future_related_count FROM annual")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return _annual(spark, d)


@query("g5_partition_checks", f"WITH {EDGES}, {ANNUAL}, h AS (SELECT cited AS work_id, cited AS member FROM edges UNION SELECT citing, cited FROM edges WHERE cited_year < citing_year), r AS (SELECT h.work_id, citing_year - n.year AS age_year, count(DISTINCT citing) AS related FROM h JOIN edges ON cited = member JOIN nodes n ON n.work_id = h.work_id WHERE citing <> h.work_id AND citing_year >= n.year AND citing_year <= 2000 GROUP BY ALL) SELECT count(*) AS buckets, sum(abs(coalesce(citation_count, 0) - coalesce(NF + NB, 0)))::BIGINT AS citation_delta, sum(abs(coalesce(related, 0) - coalesce(NF + NB + NR, 0)))::BIGINT AS neighborhood_delta, sum(related)::BIGINT AS related FROM annual FULL JOIN r USING (work_id, age_year)")
def g5(spark: SparkSession, d: str) -> DataFrame:
    """Both sums against counts that come another way; any difference, in either direction, adds to the deltas."""
    zero = F.lit(0).cast("bigint")
    j = _annual(spark, d).join(graph.related(_edges(spark, d), P.SNAPSHOT_YEAR), ["work_id", "age_year"], "full_outer")
    direct, every = F.coalesce(F.col("NF") + F.col("NB"), zero), F.coalesce(F.col("NF") + F.col("NB") + F.col("NR"), zero)
    return j.agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.abs(F.coalesce("citation_count", zero) - direct)).alias("citation_delta"), F.sum(F.abs(F.coalesce("related", zero) - every)).alias("neighborhood_delta"), F.sum("related").alias("related"))


@query("g6_windows", f"""WITH {WINDOWS} SELECT work_id, window_policy, "window", planned_start_date, planned_end_date, observed_end_date, is_mature, CASE WHEN observable THEN start_age END AS observed_age_start, (year(observed_end_date) - year)::INTEGER AS observed_age_end, CASE WHEN year IS NULL THEN 'unavailable_publication_year' WHEN observable THEN 'complete' ELSE 'unobservable' END AS computation_status, NF, NB, NR FROM scored""")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("work_id", "window_policy", "window", "planned_start_date", "planned_end_date", "observed_end_date", "is_mature", "observed_age_start", "observed_age_end", "computation_status", "NF", "NB", "NR")


@query("g7_disruption_scores", f"""WITH {WINDOWS} SELECT work_id, window_policy, "window", cd_raw AS disruption_cd_raw_observed, no_nr_raw AS disruption_no_nr_raw_observed, CASE WHEN ok THEN cd_raw END AS disruption_cd, CASE WHEN ok THEN no_nr_raw END AS disruption_no_nr FROM scored""")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("work_id", "window_policy", "window", "disruption_cd_raw_observed", "disruption_no_nr_raw_observed", "disruption_cd", "disruption_no_nr")


@query("g8_window_flags", f"""WITH {WINDOWS}, {FLAGS}, f AS (SELECT window_policy, "window", unnest(flags) AS flag FROM flagged) SELECT window_policy, "window", flag, count(*) AS rows FROM f GROUP BY ALL""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return checks.flag_summary(_windows(spark, d), ["window_policy", "window"], "flags")


@query("g9_invalid_records", f"WITH {EDGES}, {ANNUAL} SELECT count(*) FILTER (WHERE year IS NULL) AS unknown_year, count(*) FILTER (WHERE age_year < 0) AS negative_age, count(*) FILTER (WHERE year + age_year > 2000) AS after_snapshot, count(*) FILTER (WHERE NF + NB + NR = 0) AS empty_bucket, count(*) FILTER (WHERE citation_count <> NF + NB) AS citation_partition, count(*) FILTER (WHERE future_related_count <> NF + NB + NR) AS neighborhood_partition FROM annual LEFT JOIN nodes USING (work_id)")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return graph.invalid_records(_annual(spark, d), P.SNAPSHOT_YEAR, _nodes(spark, d))


LEVELS = ", ".join([f"valid >= {t} AS has_ref_{t}" for t in (1, 5, 10, 20)] + [f"CASE WHEN can THEN citation_count >= {t} END AS has_citation_{t}" for t in (5, 10, 20)] + [f"CASE WHEN can THEN valid >= {t} AND citation_count >= {t} END AS eligible_r{t}_c{t}" for t in (5, 10, 20)])


@query("g10_research_view", f"""WITH {WINDOWS}, r AS (SELECT *, citation_count IS NOT NULL AND ("window" = 'lifetime' OR coalesce(is_mature, false)) AS can FROM scored) SELECT work_id, window_policy, "window", 2000 - year AS paper_age_at_snapshot, CASE WHEN year IS NOT NULL THEN greatest(0, 1999 - year) END AS complete_years_exclude, CASE WHEN year IS NOT NULL THEN greatest(0, 2000 - year) END AS complete_years_include, {LEVELS} FROM r""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    levels = [f"has_ref_{t}" for t in (1, 5, 10, 20)] + [f"has_citation_{t}" for t in (5, 10, 20)] + [f"eligible_r{t}_c{t}" for t in (5, 10, 20)]
    return graph.research_view(_windows(spark, d), P.CUTOFF).select("work_id", "window_policy", "window", "paper_age_at_snapshot", "complete_years_exclude", "complete_years_include", *levels)


@query("g11_wide_view", f"""WITH {WINDOWS}, {FLAGS} SELECT work_id, {", ".join(f"max({m}) FILTER (WHERE window_policy = '{p}' AND \"window\" = '{n}') AS {a}_{n}_{p}" for p in ("exclude_publication_year", "include_publication_year") for n in ("3y", "5y", "10y", "lifetime") for m, a in METRICS)} FROM flagged GROUP BY 1""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return graph.wide(_windows(spark, d), [a for _, a in METRICS])


@query("g12_age_range", f"""WITH {AUDIT}, {ANNUAL}, {FOCAL}, f AS (SELECT work_id, year, valid, CASE WHEN year <= 2000 THEN 2000 - year END AS observed_age_end FROM focal), g AS (SELECT f.*, sum(NF) AS a, sum(NB) AS b, sum(NR) AS c FROM f LEFT JOIN annual ON f.work_id = annual.work_id AND age_year BETWEEN 1 AND least(4, observed_age_end) GROUP BY ALL), h AS (SELECT *, CASE WHEN observed_age_end >= 1 THEN coalesce(a, 0)::BIGINT END AS NF, CASE WHEN observed_age_end >= 1 THEN coalesce(b, 0)::BIGINT END AS NB, CASE WHEN observed_age_end >= 1 THEN coalesce(c, 0)::BIGINT END AS NR, make_date(year + 4, 12, 31) <= DATE '2000-06-30' AS is_mature FROM g) SELECT work_id, NF, NB, NR, is_mature, (NF - NB)::DOUBLE / nullif(NF + NB + NR, 0) AS disruption_cd_raw_observed, CASE WHEN is_mature AND valid > 0 THEN (NF - NB)::DOUBLE / nullif(NF + NB + NR, 0) END AS disruption_cd FROM h""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    focal = _focal(spark, d).withColumn("observed_age_end", F.when(F.col("year") <= P.SNAPSHOT_YEAR, P.SNAPSHOT_YEAR - F.col("year")))
    return graph.age_range(focal, _annual(spark, d), 1, 4, P.CUTOFF).select("work_id", "NF", "NB", "NR", "is_mature", "disruption_cd_raw_observed", "disruption_cd")


@query("g13_export_quality", f"""WITH {WINDOWS} SELECT window_policy, "window", count(*) AS rows, count(*) FILTER (WHERE ok AND cd_raw IS NOT NULL) AS scored, count(*) FILTER (WHERE abs(cd_raw) > 1) AS out_of_bounds, count(*) FILTER (WHERE cd_raw IS NOT NULL AND year IS NULL) AS impossible FROM scored GROUP BY ALL""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    raw = F.col("disruption_cd_raw_observed")
    return w.groupBy("window_policy", "window").agg(F.count(F.lit(1)).alias("rows"), F.count("disruption_cd").alias("scored"), F.count_if(N.is_true(F.abs(raw) > 1)).alias("out_of_bounds"), F.count_if(raw.isNotNull() & F.col("year").isNull()).alias("impossible"))


@query("g14_exact_deltas", f"WITH {AUDIT}, {FOCAL} SELECT count(stored_delta) AS n, min(stored_delta) AS least, max(stored_delta) AS greatest, sum(stored_delta)::BIGINT AS total FROM focal")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return checks.exact_total(_focal(spark, d), "stored_delta").withColumn("total", F.col("total").cast("bigint"))


@query("g15_stress_focals", f"WITH {AUDIT}, f AS (SELECT work_id, coalesce(indegree, 0) AS indegree, coalesce(valid, 0) AS valid FROM nodes LEFT JOIN audit ON citing = work_id LEFT JOIN (SELECT cited AS work_id, count(*) AS indegree FROM edges GROUP BY 1) USING (work_id)) (SELECT work_id, 'indegree' AS reason FROM f ORDER BY indegree DESC, work_id LIMIT 10) UNION ALL (SELECT work_id, 'valid' FROM f ORDER BY valid DESC, work_id LIMIT 10) UNION ALL (SELECT work_id, 'exposure' FROM f ORDER BY indegree * valid DESC, work_id LIMIT 10)")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return graph.stress_focals(_focal(spark, d), 10)


@query("g16_date_quality", f"WITH {P.WORKS}, {P.EVENTS} SELECT list_filter([CASE WHEN publication_date IS NULL THEN 'no_date' END, CASE WHEN publication_date > DATE '2000-06-30' THEN 'after_snapshot' END, CASE WHEN month(publication_date) = 1 AND day(publication_date) = 1 THEN 'first_of_year' END], lambda x: x IS NOT NULL) AS flags, count(*) AS works FROM works GROUP BY 1")
def g16(spark: SparkSession, d: str) -> DataFrame:
    date = F.col("publication_date")
    flags = F.array_compact(F.array(F.when(date.isNull(), "no_date"), F.when(date > F.lit(P.CUTOFF).cast("date"), "after_snapshot"), F.when((F.month(date) == 1) & (F.dayofmonth(date) == 1), "first_of_year")))
    return P.works(spark, d).groupBy(flags.alias("flags")).agg(F.count(F.lit(1)).alias("works"))


INCOMING = f"""{P.WORKS}, {P.REFERENCES}, {P.EVENTS}, ev AS (SELECT work_id AS target, event_date, publication_date FROM events_ JOIN works USING (work_id) WHERE event_date <= DATE '2000-06-30'),
inc AS (SELECT DISTINCT citing, cited AS target, CASE citing % 3 WHEN 0 THEN strftime(w.publication_date, '%Y') WHEN 1 THEN strftime(w.publication_date, '%Y-%m') ELSE strftime(w.publication_date, '%Y-%m-%d') END AS t, w.publication_year AS year FROM refs JOIN ev ON cited = target JOIN works w ON w.work_id = citing),
timed AS (SELECT inc.*, event_date, CASE length(t) WHEN 10 THEN t::DATE WHEN 7 THEN (t || '-01')::DATE ELSE (t || '-01-01')::DATE END AS lo, CASE length(t) WHEN 10 THEN t::DATE WHEN 7 THEN last_day((t || '-01')::DATE) ELSE (t || '-12-31')::DATE END AS hi FROM inc JOIN ev USING (target))"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d).where(F.col("event_date") <= F.lit(P.CUTOFF).cast("date"))
    return e.join(P.works(spark, d).select("work_id", "publication_date"), "work_id").withColumnRenamed("work_id", "target")


def _timed(spark: SparkSession, d: str, whole_year: bool = False) -> DataFrame:
    ev = _targets(spark, d)
    w = P.works(spark, d)
    k = F.col("work_id") % 3
    w = w.select("work_id", F.when(k == 0, F.date_format("publication_date", "yyyy")).when(k == 1, F.date_format("publication_date", "yyyy-MM")).otherwise(F.date_format("publication_date", "yyyy-MM-dd")).alias("date"), F.col("publication_year").alias("year"))
    return citations.timed(citations.incoming(w, P.references(spark, d), ev.select(F.col("target").alias("work_id"))), ev, whole_year)


STATE = "CASE WHEN hi < event_date THEN 'before' WHEN lo > event_date THEN 'after' ELSE 'ambiguous' END"
COARSE = "CASE WHEN year < year(event_date) THEN 'before' WHEN year > year(event_date) THEN 'after' ELSE 'ambiguous' END"


@query("c3_edge_timing", f"WITH {INCOMING}, t AS (SELECT timed.*, {STATE} AS state, {COARSE} AS coarse, w.type AS citing_type, f.type AS field FROM timed JOIN works w ON w.work_id = citing JOIN works f ON f.work_id = target) SELECT 'reported' AS variant, 'all' AS field, state, count(*) AS edges FROM t GROUP BY ALL UNION ALL SELECT 'both_as_years', 'all', coarse, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'article_or_review', 'all', state, count(*) FROM t WHERE citing_type IN ('1-URGENT', '2-HIGH') GROUP BY ALL UNION ALL SELECT 'reported', field, state, count(*) FROM t GROUP BY ALL")
def c3(spark: SparkSession, d: str) -> DataFrame:
    """Edges by timing: as dates are reported, with citing work and event as whole years, from articles and reviews (two
    types of the proxy) alone, and by the target's field."""
    kinds = P.works(spark, d).select("work_id", "type")
    t = _timed(spark, d).join(kinds.withColumnsRenamed({"work_id": "citing", "type": "citing_type"}), "citing").join(kinds.withColumnsRenamed({"work_id": "target", "type": "field"}), "target")
    y, e = F.col("year"), F.year("event_date")
    coarse = F.when(y < e, "before").when(y > e, "after").otherwise("ambiguous")
    chosen = F.col("citing_type").isin("1-URGENT", "2-HIGH")

    def case(variant: str, field, state):
        return F.struct(F.lit(variant).alias("variant"), field.alias("field"), state.alias("state"))

    every = F.lit("all")
    cases = F.array(case("reported", every, F.col("state")), case("both_as_years", every, coarse), F.when(chosen, case("article_or_review", every, F.col("state"))), case("reported", F.col("field"), F.col("state")))
    return t.select(F.explode(F.array_compact(cases)).alias("c")).groupBy("c.variant", "c.field", "c.state").agg(F.count(F.lit(1)).alias("edges"))


@query("c2_relative_years", f"WITH {INCOMING}, s AS (SELECT target, k, (event_date + to_years(k::INTEGER))::DATE AS a, (event_date + to_years(k::INTEGER + 1))::DATE AS b, publication_date FROM ev, range(-5, 5) r(k)), g AS (SELECT * FROM s WHERE b - 1 <= DATE '2000-06-30' AND publication_date <= a), n AS (SELECT g.target, g.k, count(timed.citing) AS edges FROM g LEFT JOIN timed ON g.target = timed.target AND lo >= a AND hi < b GROUP BY ALL) SELECT k::INTEGER AS year_offset, count(*) AS targets, sum(edges)::BIGINT AS edges, sum(edges)::DOUBLE / count(*) AS mean FROM n GROUP BY 1")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return citations.relative_years(_timed(spark, d), _targets(spark, d), P.CUTOFF)


FOLLOW = "n AS (SELECT s.target, s.k, count(timed.citing) AS edges FROM s LEFT JOIN timed ON s.target = timed.target AND lo >= event_day + 1 AND hi < (event_day + to_years(s.k))::DATE + 1 GROUP BY ALL) SELECT k, count(*) AS targets, sum(edges)::BIGINT AS edges, avg(edges) AS mean, quantile_cont(edges, 0.5) AS median, quantile_cont(edges, 0.25) AS p25, quantile_cont(edges, 0.75) AS p75, count(*) FILTER (WHERE edges > 0) * 100.0::DOUBLE / count(*) AS nonzero_share FROM n GROUP BY 1"


@query("c4_follow_up_common", f"WITH {INCOMING}, s AS (SELECT target, event_date AS event_day, k FROM ev, (VALUES (1), (2), (3)) w(k) WHERE (event_date + INTERVAL 3 YEAR)::DATE <= DATE '2000-06-30'), {FOLLOW}")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return citations.follow_up(_timed(spark, d), _targets(spark, d), P.CUTOFF, (1, 2, 3))


@query("c4b_follow_up_own", f"WITH {INCOMING}, s AS (SELECT target, event_date AS event_day, k FROM ev, (VALUES (1), (3), (5)) w(k) WHERE (event_date + to_years(k))::DATE <= DATE '2000-06-30'), {FOLLOW}")
def c4b(spark: SparkSession, d: str) -> DataFrame:
    return citations.follow_up(_timed(spark, d), _targets(spark, d), P.CUTOFF, (1, 3, 5), common=False)


@query("c1_citation_ecdf", f"WITH {P.WORKS}, {P.REFERENCES}, n AS (SELECT work_id, count(citing) AS n FROM works LEFT JOIN refs ON cited = work_id GROUP BY 1), c AS (SELECT n AS value, count(*) AS m FROM n GROUP BY 1) SELECT value, sum(m) OVER (ORDER BY value)::BIGINT AS cumulative, sum(m) OVER (ORDER BY value)::DOUBLE / sum(m) OVER () AS share FROM c")
def c1(spark: SparkSession, d: str) -> DataFrame:
    from citelode.operators.distribution import ecdf

    n = P.references(spark, d).groupBy(F.col("cited").alias("work_id")).agg(F.count(F.lit(1)).alias("n"))
    return ecdf(P.works(spark, d).select("work_id").join(n, "work_id", "left").fillna(0, ["n"]), "n")
