"""Counting: full and fractional association counts, cells, matrices, combinations, concentration, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.functions import normalize as N


def associations(members: DataFrame, key: str, member: str) -> DataFrame:
    """Member, full count and fractional count (a work's members share one); a member counts once a work."""
    once = members.select(key, member).distinct()
    sized = once.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.collect_list(member).alias("ms"))
    return sized.select(F.explode("ms").alias(member), (F.lit(1.0) / F.col("n")).alias("w")).groupBy(member).agg(F.count(F.lit(1)).alias("full_count"), F.round(F.sum("w"), 6).alias("fractional_count"))


def membership_counts(works: DataFrame, members: DataFrame, key: str, member: str, unknown: str = "unknown") -> DataFrame:
    """Works by member, with works that have none in a bucket of their own."""
    once = members.select(key, member).distinct()
    return works.select(key).join(once, key, "left").groupBy(F.coalesce(F.col(member), F.lit(unknown)).alias(member)).agg(F.count(F.lit(1)).alias("works"))


def cohort_rate(numerators: DataFrame, denominators: DataFrame, keys: list[str], unit: float = 10000.0, least: tuple[int, int] = (1000, 20)) -> DataFrame:
    """Numerator over denominator per unit, for every denominator cell; rankable with enough of both."""
    n = numerators.groupBy(*keys).agg(F.count(F.lit(1)).alias("numerator"))
    d = denominators.groupBy(*keys).agg(F.count(F.lit(1)).alias("denominator"))
    return with_rate(d.join(n, keys, "left").withColumn("numerator", F.coalesce("numerator", F.lit(0).cast("bigint"))), keys, unit, least)


def with_rate(cells: DataFrame, keys: list[str], unit: float = 10000.0, least: tuple[int, int] = (1000, 20)) -> DataFrame:
    n, d = F.col("numerator"), F.col("denominator")
    return cells.select(*keys, "numerator", "denominator", N.rate(n, d, unit).alias("value"), N.ranking_eligible(n, d, *least).alias("ranking_eligible"))


def denominators(base: DataFrame, dimensions: dict[str, Column], year: str = "publication_year") -> DataFrame:
    """Works by (dimension, group, year) for single-valued dimensions in one pass, by grouping sets."""
    named = base.select(*[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in dimensions.items()], F.col(year).alias("_year"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("group_id")) for n in dimensions]))
    return named.select(pairs.alias("p"), "_year").groupBy("p.dimension", "p.group_id", F.col("_year").alias(year)).agg(F.count(F.lit(1)).alias("works"))


def matrix(pairs: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by two keys with the row's total and share."""
    cells = pairs.groupBy(row, column).agg(F.count(F.lit(1)).alias("works"))
    total = F.sum("works").over(Window.partitionBy(row))
    return cells.select(row, column, "works", total.alias("row_total"), F.try_divide(F.col("works") * 100.0, total).alias("share"))


def pair_counts(members: DataFrame, key: str, member: str) -> DataFrame:
    """Works by unordered pair of members. Pairs come from each work's own sorted list."""
    lists = members.select(key, member).distinct().groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.where(F.size("m") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("works"))


def combinations(works: DataFrame, members: DataFrame, key: str, member: str, top: int = 10) -> DataFrame:
    """Works by their whole sorted label set: the most frequent, the other ones together, and those without."""
    sets = members.select(key, member).distinct().groupBy(key).agg(F.concat_ws("+", F.array_sort(F.collect_list(member))).alias("labels"))
    counts = works.select(key).join(sets, key, "left").groupBy("labels").agg(F.count(F.lit(1)).alias("works"))
    named = counts.where(F.col("labels").isNotNull()).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("works"), "labels")))
    shown = named.select(F.when(F.col("rank") <= top, F.col("labels")).otherwise("other").alias("labels"), "works").groupBy("labels").agg(F.sum("works").alias("works"))
    return shown.unionByName(counts.where(F.col("labels").isNull()).select(F.lit("missing").alias("labels"), "works"))


def concentration(counts: DataFrame, count: str) -> DataFrame:
    """Members, total, HHI and Gini of a count column; each distinct count is ranked once."""
    by_value = counts.groupBy(F.col(count).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    up_to = F.sum("m").over(Window.orderBy("v"))
    ranked = by_value.select("v", "m", up_to.alias("hi"), (up_to - F.col("m") + 1).alias("lo"))
    weighted = F.sum(F.col("v") * F.col("m") * (F.col("lo") + F.col("hi")))  # 2 * sum of rank * value
    r = ranked.agg(F.sum("m").alias("members"), F.sum(F.col("v") * F.col("m")).alias("total"), F.sum(F.col("v") * F.col("v") * F.col("m")).alias("squares"), weighted.alias("weighted"))
    n, t = F.col("members"), F.col("total")
    return r.select("members", "total", F.try_divide(F.col("squares").cast("double"), t.cast("double") * t).alias("hhi"), (F.try_divide(F.col("weighted").cast("double"), n.cast("double") * t) - (n + 1) / n).alias("gini"))


def top_union(members: DataFrame, key: str, member: str, top: int = 10) -> DataFrame:
    """Works with any of the most frequent members, against those members' share of associations."""
    once = members.select(key, member).distinct()
    counts = once.groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), member).limit(top)
    some = once.join(F.broadcast(best.select(member)), member, "left_semi")  # top rows
    a = some.agg(F.countDistinct(key).alias("union_works"), F.count(F.lit(1)).alias("top_associations"))
    b = counts.agg(F.sum("n").alias("associations"))
    return a.crossJoin(F.broadcast(b)).select("union_works", "top_associations", "associations", F.try_divide(F.col("top_associations") * 100.0, "associations").alias("association_share"))


def modal_name(names: DataFrame, key: str, name: str) -> DataFrame:
    """The most frequent name of each key; ties go to the first by code point."""
    counts = names.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), name)) == 1
    return counts.withColumn("best", best).where("best").select(key, name, F.col("n").alias("times"))


def coverage(rows: DataFrame, stratum: str, matched: Column) -> DataFrame:
    """Rows and the share that match, by stratum; a row in several strata counts in each."""
    return rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("denominator"), F.count_if(matched).alias("numerator")).withColumn("value", N.rate(F.col("numerator"), F.col("denominator"), 100.0))


def quality_flags(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One count a flag, in one pass."""
    one = rows.agg(*[F.count_if(N.is_true(c)).alias(n) for n, c in flags.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in flags]), F.array(*flags))).alias("flag", "n"))


def name_coverage(names: DataFrame, key: str, name: str) -> DataFrame:
    """Works by whether all, some or none of their raw names are missing."""
    per = names.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(N.is_missing_name(F.col(name))).alias("gone"))
    state = F.when(F.col("gone") == 0, "complete").when(F.col("gone") == F.col("n"), "missing").otherwise("partial")
    return per.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("works"), F.sum("n").alias("names"), F.sum("gone").alias("missing_names"))


def overlapping(base: DataFrame, populations: dict[str, Column], aggregates: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Aggregates over populations that overlap, in one pass: a row is tagged with each it is in."""
    tags = F.array_compact(F.array(*[F.when(N.is_true(c), F.lit(n)) for n, c in populations.items()]))
    return base.withColumn("population", F.explode(tags)).groupBy("population", *(keys or [])).agg(*aggregates)
