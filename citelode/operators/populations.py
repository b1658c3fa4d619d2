"""Populations: roles, eligibility, exclusion funnels, reconciliation, cohort cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import fixed
from citelode.functions import normalize as N


def with_roles(works: DataFrame, evidence: DataFrame) -> DataFrame:
    """Works with document_role; works without evidence are unresolved."""
    role = N.document_role(F.col("known_notice"), F.col("known_original"), F.col("notice_like"))
    return works.join(evidence, "work_id", "left").withColumn("document_role", role).drop("known_notice", "known_original", "notice_like")


def date_eligible(date: Column, cutoff: str) -> Column:
    """No date, or one up to the cutoff; never null."""
    return date.isNull() | N.is_true(date <= F.lit(cutoff).cast("date"))


def eligible(roles: DataFrame, cutoff: str, year: int, types: Column | None = None) -> DataFrame:
    """Core work of a selected type, original or unresolved, published from year 1 to the snapshot's, by the cutoff."""
    ok = ~F.col("is_xpac") & F.col("document_role").isin(*fixed.ORIGINAL_ROLES) & F.col("publication_year").between(1, year) & F.col("date_eligible")
    return roles.withColumn("eligible", N.is_true(ok if types is None else ok & types))


def population_counts(eligible: DataFrame, originals: DataFrame, matched: DataFrame) -> DataFrame:
    """Population accounting: A0, A1, B, C and D as rows that do not add up."""
    a = eligible.agg(F.count_if(~F.col("is_xpac") & F.col("is_retracted")).alias("A0"), F.count_if(F.col("eligible") & N.is_true(F.col("is_retracted"))).alias("A1"), F.count_if("eligible").alias("D"))
    b = originals.agg(F.count(F.lit(1)).alias("B"))
    c = matched.join(eligible.where("eligible").select("work_id"), "work_id", "left_semi").agg(F.count(F.lit(1)).alias("C"))

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in df.columns]), F.array(*df.columns))).alias("population", "works"))

    return rows(a).unionByName(rows(b)).unionByName(rows(c))


def funnel(flagged: DataFrame, steps: list[tuple[str, Column]], rest: str = "retained") -> DataFrame:
    """The first step that excludes a work; counts and shares add up to the whole."""
    out = F.lit(rest)
    for name, cond in reversed(steps):
        out = F.when(N.is_true(cond), name).otherwise(out)
    counts = flagged.groupBy(out.alias("step")).agg(F.count(F.lit(1)).alias("works"))
    total = flagged.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("step", "works", F.try_divide(F.col("works") * 100.0, "total").alias("share"))


def cohort_cube(roles: DataFrame) -> DataFrame:
    """A1: counts by everything a population is made of."""
    return roles.groupBy("is_xpac", "type", "publication_year", "document_role", "is_retracted", "date_eligible").agg(F.count(F.lit(1)).alias("work_count"))


def move_roles(cube: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """The cube after works move from one role to another; totals stay. moves: keys, old_role, new_role, moved.
    A cell that would go below zero raises an error when it is read."""
    out = moves.select(*keys, F.col("old_role").alias("document_role"), (-F.col("moved")).alias("work_count"))
    into = moves.select(*keys, F.col("new_role").alias("document_role"), F.col("moved").alias("work_count"))
    cells = cube.select(*keys, "document_role", "work_count").unionByName(out).unionByName(into)
    total = cells.groupBy(*keys, "document_role").agg(F.sum("work_count").alias("work_count"))
    checked = F.when(F.col("work_count") < 0, F.raise_error(F.lit("a cell of the cube is below zero")).cast("bigint")).otherwise(F.col("work_count"))
    return total.withColumn("work_count", checked).where("work_count <> 0")


def reconciliation(originals: DataFrame) -> DataFrame:
    """The states of matched originals; every original is in one. originals: outcome, eligible, flagged."""
    state = (
        F.when(F.col("outcome") != "unique", F.col("outcome"))
        .when(~F.col("eligible"), "matched_outside_population")
        .when(F.col("flagged").isNull(), "matched_flag_missing")
        .when(F.col("flagged"), "matched_flag_true")
        .otherwise("matched_flag_false")
    )
    return originals.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("originals"))


def exclusion_combinations(works: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Eligibility audit: all reasons that hold at once, joined by +; none is 'eligible'."""
    names = F.array_compact(F.array(*[F.when(N.is_true(c), F.lit(n)) for n, c in reasons.items()]))
    combo = F.when(F.size(names) == 0, "eligible").otherwise(F.concat_ws("+", names))
    return works.groupBy(combo.alias("reasons")).agg(F.count(F.lit(1)).alias("works"))
