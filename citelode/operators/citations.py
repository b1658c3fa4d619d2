"""Incoming citations around an event: timing, relative years, follow-up windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.functions import normalize as N


def incoming(works: DataFrame, refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Different edges (citing, target) into a target set, with the citing work's columns."""
    t = targets.select(F.col("work_id").alias("cited")).distinct()
    pairs = refs.select("citing", "cited").join(t, "cited").distinct()
    return pairs.join(works.withColumnRenamed("work_id", "citing"), "citing").withColumnRenamed("cited", "target")


def timed(edges: DataFrame, events: DataFrame, whole_year: bool = False) -> DataFrame:
    """Edges with state: before, after, ambiguous or undated against the event. edges: target, date (text),
    year; events: target, event_date. whole_year takes every citing date as its year."""
    text = F.lit(None).cast("string") if whole_year else F.col("date")
    lo, hi = N.date_interval(text, F.col("year"))
    j = edges.join(events.select("target", "event_date"), "target")
    j = j.withColumns({"lo": lo, "hi": hi})
    return j.withColumn("state", N.timing(F.col("lo"), F.col("hi"), F.col("event_date"), F.col("event_date")))


def relative_years(edges: DataFrame, events: DataFrame, cutoff: str, first: int = -5, last: int = 4) -> DataFrame:
    """Mean incoming edges per eligible target in each year around the event: [event + k years, event + k + 1
    years). A target is eligible for a year that ends by the cutoff and starts at its publication or later; targets
    without edges count. edges: target, lo, hi; events: target, event_date, publication_date."""
    cut = F.lit(cutoff).cast("date")
    spans = events.select("target", "publication_date", "event_date", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year_offset"))
    spans = spans.withColumns({"start": N.anniversary(F.col("event_date"), F.col("year_offset")), "end": N.anniversary(F.col("event_date"), F.col("year_offset") + 1)})
    spans = spans.where((F.date_sub("end", 1) <= cut) & (F.col("publication_date").isNull() | (F.col("publication_date") <= F.col("start"))))
    n = _inside(edges, spans, ["target", "year_offset"])
    return spans.join(n, ["target", "year_offset"], "left").groupBy("year_offset").agg(F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum("edges"), F.lit(0).cast("bigint")).alias("edges")).withColumn("mean", F.col("edges") / F.col("targets"))


def _inside(edges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Edges wholly inside each span, counted before they meet the spans that have none."""
    e = edges.select("target", "lo", "hi")
    j = e.join(spans.select(*keys, "start", "end"), "target").where((F.col("lo") >= F.col("start")) & (F.col("hi") < F.col("end")))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))


def follow_up(edges: DataFrame, events: DataFrame, cutoff: str, years: tuple[int, ...] = (1, 3, 5), common: bool = True) -> DataFrame:
    """Edges in the 1, 3 and 5 years after the event: [event + 1 day, anniversary + 1 day). common: only
    targets followed for the longest window, in all; else each window its own. Targets without edges stay."""
    cut = F.lit(cutoff).cast("date")
    need = F.lit(max(years)) if common else F.col("k")
    spans = events.select("target", "event_date", F.explode(F.array(*[F.lit(y) for y in years])).alias("k")).where(N.anniversary(F.col("event_date"), need) <= cut)
    spans = spans.withColumns({"start": F.date_add("event_date", 1), "end": F.date_add(N.anniversary(F.col("event_date"), F.col("k")), 1)})
    n = spans.join(_inside(edges, spans, ["target", "k"]), ["target", "k"], "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))
    return n.groupBy("k").agg(F.count(F.lit(1)).alias("targets"), F.sum("edges").alias("edges"), F.avg("edges").alias("mean"), F.percentile("edges", 0.5).alias("median"), F.percentile("edges", 0.25).alias("p25"), F.percentile("edges", 0.75).alias("p75"), (F.count_if(F.col("edges") > 0) * 100.0 / F.count(F.lit(1))).alias("nonzero_share"))


def static_audit(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored against rebuilt counts: equal, different, missing, and the sum of differences. Both: work_id, n."""
    j = stored.select("work_id", F.col("n").alias("a")).join(rebuilt.select("work_id", F.col("n").alias("b")), "work_id", "left").withColumn("b", F.coalesce("b", F.lit(0).cast("bigint")))
    return j.agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.count_if(F.col("a").isNull()).alias("missing"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("absolute_difference"))
