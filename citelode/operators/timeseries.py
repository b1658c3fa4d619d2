"""Time series: dense spines, changes, trailing means, control charts, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.functions import normalize as N


def yearly(df: DataFrame, year: str, first: int, last: int, partial: int | None = None) -> DataFrame:
    """Rows by year, every year there, the unfinished one marked."""
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counts = df.groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), (F.col("year") == F.lit(partial)).alias("partial") if partial else F.lit(False).alias("partial"))


def monthly(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Rows by month, every month there; the first day stands for the month."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    counts = df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def change(series: DataFrame, at: str, value: str, small: int = 20, by: list[str] | None = None) -> DataFrame:
    """Change on the period before, in number and %, with a flag for a small base."""
    was = F.lag(value).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(at))
    return series.withColumn("_was", was).select(*series.columns, (F.col(value) - F.col("_was")).alias("change"), N.growth(F.col(value), F.col("_was")).alias("growth"), (F.col("_was") < small).alias("small_base"))


def trailing_mean(series: DataFrame, at: str, value: str, width: int = 3, partial: str | None = None) -> DataFrame:
    """Mean of the last periods; null until there are enough, and for an unfinished period."""
    w = Window.partitionBy(F.lit(0)).orderBy(at).rowsBetween(-(width - 1), 0)
    mean = F.when(F.count(value).over(w) == width, F.sum(value).over(w) / F.lit(width))
    return series.withColumn("trailing_mean", F.when(~F.col(partial), mean) if partial else mean)


def control_chart(series: DataFrame, at: str, value: str, baseline: int = 24, least: float = 20.0, partial: str | None = None) -> DataFrame:
    """The mean of so many periods before (null until there are as many), the limit max(least, mean + 3 root mean)
    and a flag above it; the unfinished period is never flagged."""
    w = Window.partitionBy(F.lit(0)).orderBy(at).rowsBetween(-baseline, -1)
    df = series.withColumn("baseline", F.when(F.count(value).over(w) == baseline, F.sum(value).over(w) / F.lit(baseline)))
    df = df.withColumn("threshold", F.when(F.col("baseline").isNotNull(), F.greatest(F.lit(least), F.col("baseline") + 3 * F.sqrt("baseline"))))
    flag = N.is_true(F.col(value) > F.col("threshold"))
    return df.withColumn("flagged", flag & ~F.col(partial) if partial else flag)


def segments(points: DataFrame, at: str, ok: str, by: list[str] | None = None) -> DataFrame:
    """The runs of consecutive periods that count, as first, last and length; a gap or a period that does not
    count ends a run."""
    good = points.where(F.col(ok))
    keys = by or []
    island = F.col(at) - F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(at))
    return good.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")
