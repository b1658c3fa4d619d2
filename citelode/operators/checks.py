"""Checks: frames that are empty when the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of one side only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def numerator_exceeds(cells: DataFrame) -> DataFrame:
    """V5: cells with more in the numerator than in the denominator."""
    return cells.where(F.col("numerator") > F.col("denominator"))


def partition_gap(parts: DataFrame, whole: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells of a partition that do not add up to the whole."""
    p = parts.groupBy(*keys).agg(F.sum(value).alias("parts"))
    return whole.select(*keys, F.col(value).alias("whole")).join(p, keys, "full_outer").where(~F.col("parts").eqNullSafe(F.col("whole")))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass; a rule that is null holds."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*rules))).alias("rule", "rows"))


def flag_summary(df: DataFrame, keys: list[str], flags: str) -> DataFrame:
    """Rows by key and flag; a row counts under each of its flags."""
    return df.select(*keys, F.explode(flags).alias("flag")).groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("rows"))


def duplicates(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """A5: the most repeated keys; a report of n rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").orderBy(F.desc("times"), key).limit(n)


def exact_total(df: DataFrame, value: str) -> DataFrame:
    """Count, least, greatest and exact sum of deltas, in 38 digits."""
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(F.col(value).cast("decimal(38,0)")).alias("total"))
