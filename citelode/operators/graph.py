"""Citation graph: canonical edges, audits, and disruption by age and window.

Edges are frames (citing, cited); nodes (work_id, year) with year null where unknown. The two-hop step joins edges on the
reference, with both years on the edge so that citers outside the range go before the join multiplies rows; each pair of
focal and citer is then one row by a bit mask, combined on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import fixed

COUNTS = ("NF", "NB", "NR", "citation_count", "future_related_count")


def canonical_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: directed edges between different existing works, each once, with citing_year and cited_year."""
    a = nodes.select(F.col("work_id").alias("citing"), F.col("year").alias("citing_year"))
    b = nodes.select(F.col("work_id").alias("cited"), F.col("year").alias("cited_year"))
    pairs = refs.where(F.col("cited").isNotNull() & (F.col("cited") != F.col("citing"))).select("citing", "cited").distinct()
    return pairs.join(a, "citing").join(b, "cited")


def reference_audit(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per citing work: raw, invalid, duplicate, dangling, self_loop of the list; resolved, valid, same_year,
    future_year, unknown_year of the canonical edges. A repeated entry is a duplicate and whatever else it is, once."""
    once = refs.groupBy("citing", "cited").agg(F.count(F.lit(1)).alias("times"))
    known = nodes.select(F.col("work_id").alias("cited"), F.lit(True).alias("known"))
    seen = once.join(known, "cited", "left")
    good = F.col("cited").isNotNull()
    raw = seen.groupBy("citing").agg(
        F.sum("times").alias("raw"),
        F.sum(F.when(~good, F.col("times")).otherwise(0)).alias("invalid"),
        F.sum(F.when(good, F.col("times") - 1).otherwise(0)).alias("duplicate"),
        F.count_if(good & (F.col("cited") == F.col("citing"))).alias("self_loop"),
        F.count_if(good & (F.col("cited") != F.col("citing")) & F.col("known").isNull()).alias("dangling"),
    )
    y, z = F.col("citing_year"), F.col("cited_year")
    kinds = edges.groupBy("citing").agg(F.count(F.lit(1)).alias("resolved"), F.count_if(z < y).alias("valid"), F.count_if(z == y).alias("same_year"), F.count_if(z > y).alias("future_year"), F.count_if(z.isNull() | y.isNull()).alias("unknown_year"))
    names = ["resolved", "valid", "same_year", "future_year", "unknown_year"]
    return raw.join(kinds, "citing", "left").fillna(0, names)


def focal_stats(nodes: DataFrame, audit: DataFrame, edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A row a work: list counts, in-degree by the citer's year, and the difference from a stored citation count."""
    y, z = F.col("citing_year"), F.col("cited_year")
    incoming = edges.groupBy(F.col("cited").alias("work_id")).agg(F.count(F.lit(1)).alias("indegree"), F.count_if(y == z).alias("incoming_same_year"), F.count_if(y < z).alias("incoming_earlier_year"), F.count_if(y > z).alias("incoming_later_year"), F.count_if(y.isNull() | z.isNull()).alias("incoming_unknown_year"))
    names = [c for c in (*audit.columns, *incoming.columns) if c not in ("citing", "work_id")]
    out = nodes.join(audit.withColumnRenamed("citing", "work_id"), "work_id", "left").join(incoming, "work_id", "left").fillna(0, names)
    if stored is not None:
        out = out.join(stored, "work_id", "left").withColumn("stored_delta", F.col("stored_count") - F.col("indegree"))
    return out


def citer_masks(edges: DataFrame, snapshot_year: int) -> DataFrame:
    """focal, citer, age, mask: bit 1 if the citer cites the focal work, bit 2 if it cites one of its valid references."""
    y, z = F.col("citing_year"), F.col("cited_year")
    direct = edges.where((y >= z) & (y <= snapshot_year)).select(F.col("cited").alias("focal"), F.col("citing").alias("citer"), (y - z).alias("age"), F.lit(1).alias("mask"))
    valid = edges.where(z < y).select(F.col("citing").alias("focal"), y.alias("focal_year"), "cited")
    citers = edges.where(y <= snapshot_year).select(F.col("citing").alias("citer"), y.alias("citer_year"), "cited")
    two = valid.join(citers, "cited").where((F.col("citer_year") >= F.col("focal_year")) & (F.col("citer") != F.col("focal")))
    both = direct.unionByName(two.select("focal", "citer", (F.col("citer_year") - F.col("focal_year")).alias("age"), F.lit(2).alias("mask")))
    return both.groupBy("focal", "citer").agg(F.min("age").alias("age"), F.bit_or("mask").alias("mask"))


def annual(edges: DataFrame, snapshot_year: int) -> DataFrame:
    """work_id, age_year, NF, NB, NR; citation_count straight from the edges; future_related_count, the different citers
    of the work or of its valid references. Ages without citers have no row. related checks the last by another way."""
    masks = citer_masks(edges, snapshot_year)
    m = F.col("mask")
    years = masks.groupBy(F.col("focal").alias("work_id"), F.col("age").alias("age_year")).agg(F.count_if(m == 1).alias("NF"), F.count_if(m == 3).alias("NB"), F.count_if(m == 2).alias("NR"), F.count(F.lit(1)).alias("future_related_count"))
    y, z = F.col("citing_year"), F.col("cited_year")
    direct = edges.where((y >= z) & (y <= snapshot_year)).groupBy(F.col("cited").alias("work_id"), (y - z).alias("age_year")).agg(F.count(F.lit(1)).alias("citation_count"))
    out = years.join(direct, ["work_id", "age_year"], "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0).cast("bigint")))
    return out.select("work_id", "age_year", *COUNTS)


def related(edges: DataFrame, snapshot_year: int) -> DataFrame:
    """work_id, age_year, related: different works of that age that cite the work or one of its valid references, as the
    union of two sets of pairs; neither masks nor the partition into NF, NB and NR take part."""
    born = edges.select(F.col("cited").alias("work_id"), F.col("cited_year").alias("born")).unionByName(edges.select(F.col("citing").alias("work_id"), F.col("citing_year").alias("born"))).distinct()
    hood = edges.select(F.col("cited").alias("work_id"), F.col("cited").alias("member")).unionByName(edges.where(F.col("cited_year") < F.col("citing_year")).select(F.col("citing").alias("work_id"), F.col("cited").alias("member"))).distinct()
    seen = hood.join(edges.select(F.col("cited").alias("member"), "citing", "citing_year"), "member").where(F.col("citing") != F.col("work_id")).select("work_id", "citing", "citing_year").distinct()
    aged = seen.join(born, "work_id").where((F.col("citing_year") >= F.col("born")) & (F.col("citing_year") <= snapshot_year))
    return aged.groupBy("work_id", (F.col("citing_year") - F.col("born")).alias("age_year")).agg(F.count(F.lit(1)).alias("related"))


def checks(df: DataFrame) -> DataFrame:
    """The two partition deltas, which are warnings and change nothing."""
    return df.withColumns({"citation_partition_delta": F.col("citation_count") - F.col("NF") - F.col("NB"), "neighborhood_partition_delta": F.col("future_related_count") - F.col("NF") - F.col("NB") - F.col("NR")})


POLICIES = (("exclude_publication_year", 1), ("include_publication_year", 0))
LAST_YEAR = 9999  # the last year that a calendar date can have


def windows(focal: DataFrame, annual: DataFrame, snapshot: str, only: set[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each work, policy and window, or for those in only. focal: work_id, year, valid (references), raw
    and, where there are such, stored_delta, list_unknown (the reference list was not recorded) and is_complete (the
    graph covers the work's whole record).

    exclude counts ages 1 to k, include 0 to k - 1, lifetime to the snapshot. A window is observable if it has begun and
    mature if its last day is past; lifetime has no maturity. Counts are null where the window is not observable or the
    year is unknown, and 0 where nothing was counted. Scores are interpreted for works with valid references in mature
    or lifetime windows; the observed scores are there regardless."""
    snap = F.lit(snapshot).cast("date")
    snap_year = F.year(snap)
    asked = [(policy, start, name, k) for policy, start in POLICIES for name, k in fixed.WINDOWS if only is None or (policy, name) in only]
    sums = {}
    for policy, start, name, k in asked:
        inside = (F.col("age_year") >= start) & ((F.col("age_year") < start + k) if k else F.lit(True))
        for c in COUNTS:
            sums[(policy, name, c)] = F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(f"{policy}|{name}|{c}")
    wide = annual.groupBy("work_id").agg(*sums.values())
    base = focal.join(wide, "work_id", "left")
    zero = F.lit(0).cast("bigint")
    rows = []
    for policy, start, name, k in asked:
        counts = [F.coalesce(F.col(f"`{policy}|{name}|{c}`"), zero).alias(c) for c in COUNTS]
        rows.append(F.struct(F.lit(policy).alias("window_policy"), F.lit(name).alias("window"), F.lit(start).alias("start_age"), F.lit(k).alias("years"), *counts))
    w = base.select(*focal.columns, F.explode(F.array(*rows)).alias("w")).select(*focal.columns, "w.*")
    year, life = F.col("year"), F.col("years") == 0
    w = w.withColumn("representable", (year + F.col("start_age")).between(1, LAST_YEAR) & (life | (year + F.col("start_age") + F.col("years") - 1 <= LAST_YEAR)))
    w = w.withColumns({
        "planned_start_date": F.make_date(year + F.col("start_age"), F.lit(1), F.lit(1)),
        "planned_end_date": F.when(~life, F.make_date(year + F.col("start_age") + F.col("years") - 1, F.lit(12), F.lit(31))),
    })
    seen = F.coalesce(F.col("planned_start_date") <= snap, F.lit(False))
    w = w.withColumns({
        "observable": seen,
        "observed_end_date": F.when(seen, F.least(F.coalesce("planned_end_date", snap), snap)),
        "is_mature": F.col("planned_end_date") <= snap,
        **{c: F.when(seen, F.col(c)) for c in COUNTS},
    })
    w = w.withColumns({
        "observed_age_start": F.when(F.col("observable"), F.col("start_age")),
        "observed_age_end": F.year("observed_end_date") - year,
        "computation_status": F.when(year.isNull(), "unavailable_publication_year").when(F.col("observable"), "complete").otherwise("unobservable"),
    })
    return scores(w, life)


def scores(w: DataFrame, life: Column) -> DataFrame:
    nf, nb, nr = F.col("NF"), F.col("NB"), F.col("NR")
    w = w.withColumns({"disruption_cd_raw_observed": F.try_divide((nf - nb).cast("double"), nf + nb + nr), "disruption_no_nr_raw_observed": F.try_divide((nf - nb).cast("double"), nf + nb)})
    def extra(name: str, otherwise: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(otherwise)) if name in w.columns else F.lit(otherwise)

    unknown = extra("list_unknown", False)
    ok = F.col("observable") & (F.col("valid") > 0) & ~unknown & (life | F.coalesce("is_mature", F.lit(False)))
    stored = F.col("stored_delta") != 0 if "stored_delta" in w.columns else F.lit(False)
    named = [
        (~F.col("representable"), "unrepresentable_window_bounds"),
        (F.col("valid") == 0, "no_references"),
        (F.col("year").isNull() | ~extra("is_complete", True) | unknown, "incomplete_record"),
        (F.col("is_mature") == F.lit(False), "insufficient_observation_window"),
        (life, "snapshot_limited"),
        (stored, "stored_citation_count_warning"),
        (F.col("citation_count") == 0, "no_future_citations"),
        (nf + nb + nr == 0, "empty_denominator_cd"),
        (nf + nb == 0, "empty_denominator_no_nr"),
        (F.col("citation_count") != nf + nb, "citation_partition_warning"),
        (F.col("future_related_count") != nf + nb + nr, "neighborhood_partition_warning"),
    ]
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in named]))
    return w.withColumns({"snapshot_limited": life, "disruption_cd": F.when(ok, F.col("disruption_cd_raw_observed")), "disruption_no_nr": F.when(ok, F.col("disruption_no_nr_raw_observed")), "flags": flags}).drop("start_age", "years", "observable", "representable")


def research_view(w: DataFrame, snapshot: str) -> DataFrame:
    """Thresholds and eligibility; null where the window can't be judged."""
    year = int(snapshot[:4])
    complete = year if snapshot.endswith("12-31") else year - 1
    ok = F.col("citation_count").isNotNull() & ((F.col("window") == "lifetime") | F.coalesce("is_mature", F.lit(False)))
    new = {"paper_age_at_snapshot": F.lit(year) - F.col("year"), "complete_years_exclude": F.greatest(F.lit(0), F.lit(complete) - F.col("year")), "complete_years_include": F.greatest(F.lit(0), F.lit(complete) - F.col("year") + 1)}
    new |= {"complete_years_exclude": F.when(F.col("year").isNotNull(), new["complete_years_exclude"]), "complete_years_include": F.when(F.col("year").isNotNull(), new["complete_years_include"])}
    new |= {f"has_ref_{t}": F.col("valid") >= t for t in (1, 5, 10, 20)}
    new |= {f"has_citation_{t}": F.when(ok, F.col("citation_count") >= t) for t in (5, 10, 20)}
    new |= {f"eligible_r{t}_c{t}": F.when(ok, (F.col("valid") >= t) & (F.col("citation_count") >= t)) for t in (5, 10, 20)}
    return w.withColumns(new)


def wide(w: DataFrame, metrics: list[str], key: str = "work_id") -> DataFrame:
    """A row a work with a column for each metric, window and policy; the values are known, so the pivot
    needs no extra pass."""
    names = [f"{n}_{p}" for p in ("exclude_publication_year", "include_publication_year") for n, _ in fixed.WINDOWS]
    cell = F.concat_ws("_", "window", "window_policy")
    return w.groupBy(key).agg(*[F.max(F.when(cell == n, F.col(m))).alias(f"{m}_{n}") for n in names for m in metrics])


def age_range(focal: DataFrame, annual: DataFrame, first: int, last: int, snapshot: str) -> DataFrame:
    """Counts and scores over any ages first to last. focal: work_id, year, valid, observed_age_end (null
    where nothing is known). A range that starts after what is observed has no counts; a missing age in it is zero."""
    f = focal.select("work_id", "year", "valid", "observed_age_end")
    end = F.least(F.lit(last), F.col("observed_age_end"))
    open_ = F.coalesce(F.lit(first) <= F.col("observed_age_end"), F.lit(False))
    own = F.col("age_year").between(F.lit(first), end)
    got = f.join(annual, "work_id", "left").groupBy(*f.columns).agg(*[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in COUNTS])
    got = got.withColumns({c: F.when(open_, F.col(c)) for c in COUNTS}).withColumn("is_mature", F.make_date(F.col("year") + last, F.lit(12), F.lit(31)) <= F.lit(snapshot).cast("date"))
    cd = F.try_divide((F.col("NF") - F.col("NB")).cast("double"), F.col("NF") + F.col("NB") + F.col("NR"))
    return got.withColumn("disruption_cd_raw_observed", cd).withColumn("disruption_cd", F.when(F.col("is_mature") & (F.col("valid") > 0), cd))


def stress_focals(focal: DataFrame, n: int) -> DataFrame:
    """The works with most citations, most references, and both, as one set with their reason."""
    parts = [focal.orderBy(F.desc(c), F.asc("work_id")).limit(n).select("work_id", F.lit(c).alias("reason")) for c in ("indegree", "valid")]
    product = focal.orderBy(F.desc(F.col("indegree") * F.col("valid")), F.asc("work_id")).limit(n).select("work_id", F.lit("exposure").alias("reason"))
    return parts[0].unionByName(parts[1]).unionByName(product)


def invalid_records(annual: DataFrame, snapshot_year: int, focal: DataFrame) -> DataFrame:
    """Rows by rule broken; none if all hold."""
    j = annual.join(focal.select("work_id", "year"), "work_id", "left")
    rules = {"unknown_year": F.col("year").isNull(), "negative_age": F.col("age_year") < 0, "after_snapshot": F.col("year") + F.col("age_year") > snapshot_year, "empty_bucket": F.col("NF") + F.col("NB") + F.col("NR") == 0, "citation_partition": F.col("citation_count") != F.col("NF") + F.col("NB"), "neighborhood_partition": F.col("future_related_count") != F.col("NF") + F.col("NB") + F.col("NR")}
    return j.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])

