"""Distributions: exact quantiles, cumulative curves, Lorenz curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The quantiles of a summary, and how many values they need.
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
ENOUGH = 20


def quantile_summary(df: DataFrame, keys: list[str], value: str, least: int = ENOUGH) -> DataFrame:
    """N, mean and linearly interpolated quantiles; quantiles and mean are null with fewer values than least."""
    v = F.col(value)
    n = F.count(v)
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n >= least, F.round(F.avg(v), 6)).alias("mean"), *[F.when(n >= least, F.percentile(v, q)).alias(name) for name, q in QUANTILES.items()])


def ecdf(df: DataFrame, value: str, points: int | None = None) -> DataFrame:
    """Each different value with the share of rows up to it; thinned to about so many points, the last kept.
    Rows are counted by value before anything is ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("value")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    out = counts.select("value", F.sum("n").over(order).alias("cumulative"), total.alias("total"), F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("k"))
    if points:
        step = F.greatest(F.lit(1), F.ceil(F.col("k") / points))
        out = out.where(((F.col("i") - 1) % step == 0) | (F.col("i") == F.col("k")))
    return out.select("value", "cumulative", (F.col("cumulative") / F.col("total")).alias("share"))


def lorenz(counts: DataFrame, count: str, points: int = 100) -> DataFrame:
    """Cumulative share of members against cumulative share of their counts, smallest first, a point for each
    different count, thinned; the last kept."""
    by_value = counts.groupBy(F.col(count).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    up, whole = Window.orderBy("v"), Window.partitionBy(F.lit(0))
    out = by_value.select(F.sum("m").over(up).alias("members"), F.sum(F.col("m") * F.col("v")).over(up).alias("mass"), F.sum("m").over(whole).alias("n"), F.sum(F.col("m") * F.col("v")).over(whole).alias("t"), F.row_number().over(up).alias("i"), F.count(F.lit(1)).over(whole).alias("k"))
    step = F.greatest(F.lit(1), F.ceil(F.col("k") / points))
    return out.where(((F.col("i") - 1) % step == 0) | (F.col("i") == F.col("k"))).select((F.col("members") / F.col("n")).alias("member_share"), F.try_divide(F.col("mass").cast("double"), F.col("t")).alias("count_share"))


def histogram(df: DataFrame, value: Column, cuts: list[int], names: list[str]) -> DataFrame:
    """Rows by half-open band, empty bands with 0, rows outside in none."""
    from citelode.functions.normalize import band

    spine = df.sparkSession.createDataFrame(list(enumerate(names)), "place int, band string")
    counts = df.select(band(value, cuts, names).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "band", "left").select("place", "band", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
