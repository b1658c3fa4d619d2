"""Ranks, selections and samples with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(counts: DataFrame, count: str, key: str, n: int) -> DataFrame:
    """The n largest; ties by key. Denominators are for the caller to take before."""
    return counts.orderBy(F.desc(count), F.asc(key)).limit(n)


def top_or_forced(counts: DataFrame, count: str, key: str, n: int, forced: str) -> DataFrame:
    """The n largest, and the forced key wherever it stands; it takes no place of the others."""
    best = top(counts.where(F.col(key) != forced), count, key, n)
    return best.unionByName(counts.where(F.col(key) == forced))


def selected(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of one population for keys chosen by another."""
    return rows.join(F.broadcast(chosen.select(key)), key, "left_semi")  # chosen by a top-n


def eligible_first(cells: DataFrame, eligible: str, value: str, label: str) -> DataFrame:
    """T5: place of each cell: eligible ones by value, then the others by label."""
    order = [F.desc(eligible), F.desc(F.when(F.col(eligible), F.col(value))), F.asc(label)]
    return cells.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest SHA-256 of their key."""
    return rows.withColumn("hash", F.sha2(F.col(key).cast("string"), 256)).orderBy("hash", key).limit(n)


def hash_sample_by(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """So many of each stratum. Each stratum's part of a partition is cut first, so no task gets a whole one."""
    h = rows.withColumn("hash", F.sha2(F.col(key).cast("string"), 256))
    return h.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("hash", key))).where(F.col("place") <= n)


def evenly_spaced(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """N rows at even distances in the order."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).crossJoin(F.broadcast(total))
    step = F.floor(F.col("place") * n / F.col("total"))
    return placed.where((F.col("place") == 0) | (step != F.floor((F.col("place") - 1) * n / F.col("total")))).drop("total")


def dense_ranks(rows: DataFrame, by: list[str], value: str, among: Column, name: str = "rank") -> DataFrame:
    """Dense rank, ascending, of rows with a value among those that count; null for the others."""
    counts = among & F.col(value).isNotNull()
    w = Window.partitionBy(*by, counts).orderBy(F.col(value))
    return rows.withColumn(name, F.when(counts, F.dense_rank().over(w)))


def average_rank(value: str, by: list[str] | None = None) -> Column:
    """Ties share the mean of their places."""
    keys = by or [F.lit(0)]
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def dual_rank(cells: DataFrame, count: str, value: str, label: str) -> DataFrame:
    """Place by count and by rate; ties by label."""
    return cells.select("*", F.row_number().over(Window.orderBy(F.desc(count), label)).alias("count_rank"), F.row_number().over(Window.orderBy(F.desc(value), label)).alias("rate_rank"))


def terciles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Low, middle or high by interpolated cuts; ties stay together, so a band may be empty."""
    w = Window.partitionBy(*by)
    third, two = F.percentile(value, 1 / 3).over(w), F.percentile(value, 2 / 3).over(w)
    return rows.withColumn("band", F.when(F.col(value) <= third, "low").when(F.col(value) <= two, "middle").when(F.col(value).isNotNull(), "high"))


def contiguous(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """Ranges that do not start right after the one before."""
    was = F.lag(last).over(Window.orderBy(first))
    return ranges.withColumn("previous_last", was).where(F.col("previous_last").isNotNull() & (F.col("previous_last") + 1 != F.col(first)))
