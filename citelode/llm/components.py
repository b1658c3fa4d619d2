"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node, which partial aggregation shrinks before any shuffle, and a join; a node with very
many neighbours is split by the adaptive skew join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


class NotConverged(RuntimeError):
    """The rounds allowed did not suffice; no partial result is given."""


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """id and root, the least id reachable, of every id on an edge (columns a, b: long). Self-links do not count. Without
    edges there are no rows. Rounds go on until nothing changes; with a limit, NotConverged where it does not suffice."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = _state(now)
    k = 0
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialize(small, "edges", replaces=now)
        state = _state(now)
        if state == was:
            break
        was, k = state, k + 1
        if k == rounds:
            raise NotConverged(f"components after {rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
