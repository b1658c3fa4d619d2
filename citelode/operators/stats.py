"""Cross-study statistics: intervals, standardisation, rank correlation, stratified differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import normalize as N
from citelode.operators.ranking import average_rank


def wilson(n: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share, within 0 and 1; null without a total."""
    t = F.when(total > 0, total.cast("double"))
    p = n / t
    mid, spread = p + z * z / (2 * t), z * F.sqrt(p * (1 - p) / t + z * z / (4 * t * t))
    whole = 1 + z * z / t
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), (mid - spread) / whole)), F.when(t.isNotNull(), F.least(F.lit(1.0), (mid + spread) / whole))


def year_weights(works: DataFrame, year: str) -> DataFrame:
    """Each year's share of all works."""
    counts = works.groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(year, (F.col("n") / F.col("t")).alias("weight"))


def direct_standard(cells: DataFrame, weights: DataFrame, subject: str, year: str) -> DataFrame:
    """Sum of weight * rate over years; null where a subject lacks years with weight. cells: subject, year,
    numerator, denominator."""
    j = cells.where("denominator > 0").join(weights, year)
    covered = F.sum("weight")
    return j.groupBy(subject).agg(F.round(F.when(covered >= 1 - 1e-12, F.sum(F.col("weight") * F.col("numerator") / F.col("denominator"))), 9).alias("standardised"), F.round(covered, 9).alias("weight_covered"))


def indirect_standard(cells: DataFrame, subject: str, strata: list[str]) -> DataFrame:
    """Observed over expected by stratum rates of all subjects, times the overall rate. Strata may be null; a null
    is a stratum of its own (J12)."""
    rates = cells.groupBy(*[F.col(s).alias(f"_{s}") for s in strata]).agg((F.sum("numerator") / F.sum("denominator")).alias("stratum_rate"))
    same = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata]
    j = cells.join(rates, same)
    total = cells.agg((F.sum("numerator") / F.sum("denominator")).alias("overall"))
    got = j.groupBy(subject).agg(F.sum("numerator").alias("observed"), F.round(F.sum(F.col("denominator") * F.col("stratum_rate")), 6).alias("expected"))
    return got.crossJoin(F.broadcast(total)).select(subject, "observed", "expected", F.round(F.try_divide(F.col("observed"), F.col("expected")), 6).alias("ratio"), F.round(F.try_divide(F.col("observed"), F.col("expected")) * F.col("overall"), 6).alias("standardised"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks over rows that have both; null with fewer than three or a constant side."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    ok = (F.count(F.lit(1)) >= 3) & (F.count_distinct("rx") > 1) & (F.count_distinct("ry") > 1)
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.when(ok, F.round(F.corr("rx", "ry"), 9)).alias("rho"))


def group_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N, mean, quartiles and the share above zero of a score; null scores don't count."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 9).alias("mean"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), (F.count_if(v > 0) / F.count(F.lit(1))).alias("positive_share"))


def adjusted_difference(rows: DataFrame, strata: list[str], marked: str, value: str) -> DataFrame:
    """Crude difference of means between marked rows and the others, and the mean of the differences within strata
    that have both, weighted by the marked."""
    v = rows.where(F.col(value).isNotNull())
    m = F.col(marked)
    cells = v.groupBy(*strata).agg(F.count_if(m).alias("n1"), F.count_if(~m).alias("n0"), F.sum(F.when(m, F.col(value))).alias("s1"), F.sum(F.when(~m, F.col(value))).alias("s0"))
    cells = cells.withColumns({"m1": F.try_divide("s1", "n1"), "m0": F.try_divide("s0", "n0")})
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    crude = F.round(F.try_divide(F.sum("s1"), F.sum("n1")) - F.try_divide(F.sum("s0"), F.sum("n0")), 9).alias("crude")
    return cells.agg(crude, F.round(F.try_divide(F.sum(F.when(both, F.col("n1") * (F.col("m1") - F.col("m0")))), F.sum(F.when(both, F.col("n1")))), 9).alias("adjusted"), F.coalesce(F.sum(F.when(both, F.col("n1"))), F.lit(0).cast("bigint")).alias("marked_in_shared_strata"))


#: The variants of a score: policy, window, least references, least citations, metric.
VARIANTS = {
    "main_cd5_r10_c5": ("exclude_publication_year", "5y", 10, 5, "disruption_cd"),
    "cd5_no_extra_threshold": ("exclude_publication_year", "5y", 1, 0, "disruption_cd"),
    "cd5_r5_c5": ("exclude_publication_year", "5y", 5, 5, "disruption_cd"),
    "cd5_r20_c5": ("exclude_publication_year", "5y", 20, 5, "disruption_cd"),
    "cd5_r10_c0": ("exclude_publication_year", "5y", 10, 0, "disruption_cd"),
    "cd5_r10_c10": ("exclude_publication_year", "5y", 10, 10, "disruption_cd"),
    "cd3_r10_c5": ("exclude_publication_year", "3y", 10, 5, "disruption_cd"),
    "cd10_r10_c5": ("exclude_publication_year", "10y", 10, 5, "disruption_cd"),
    "cd_lifetime_r10_c5": ("exclude_publication_year", "lifetime", 10, 5, "disruption_cd"),
    "cd5_include_year_r10_c5": ("include_publication_year", "5y", 10, 5, "disruption_cd"),
    "no_nr5_r10_c5": ("exclude_publication_year", "5y", 10, 5, "disruption_no_nr"),
}
MAIN = "main_cd5_r10_c5"


def scaled(variants: dict, by: int, windows: dict[str, str] | None = None) -> dict:
    """The variants with thresholds divided and windows replaced, for records with fewer references, citations and years
    than the variants suppose; at least one reference is asked for, and one citation where any was."""
    return {n: (p, (windows or {}).get(w, w), max(1, r // by), max(1, c // by) if c else 0, m) for n, (p, w, r, c, m) in variants.items()}


def variant_scores(windows: DataFrame, variants: dict = VARIANTS) -> DataFrame:
    """work_id, variant and score for every variant whose thresholds a work's window meets."""
    cases = [F.when((F.col("window_policy") == p) & (F.col("window") == w) & (F.col("valid") >= r) & (F.col("citation_count") >= c), F.struct(F.lit(n).alias("variant"), F.col(m).alias("score"))) for n, (p, w, r, c, m) in variants.items()]
    return windows.select("work_id", F.explode(F.array_compact(F.array(*cases))).alias("v")).select("work_id", "v.variant", "v.score").where(F.col("score").isNotNull())


def shares(cells: DataFrame, keys: list[str], part: str, whole: str) -> DataFrame:
    """Share with its interval for each cell."""
    lo, hi = wilson(F.col(part), F.col(whole))
    return cells.select(*keys, part, whole, N.rate(F.col(part), F.col(whole)).alias("share"), F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"))
