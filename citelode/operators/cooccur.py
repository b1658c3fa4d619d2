"""Label co-occurrence between two taxonomy levels, and the normalised distance of their sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.operators.ranking import dense_ranks


def membership(labels: DataFrame, nodes0: DataFrame, nodes1: DataFrame) -> DataFrame:
    """work_id with the sorted, different labels of each level that the dictionaries know. labels: work_id, l0, l1;
    nodes0: l0; nodes1: l1. No label is added from the hierarchy."""
    a = labels.join(nodes0.withColumn("ok0", F.lit(True)), "l0", "left").join(nodes1.withColumn("ok1", F.lit(True)), "l1", "left")
    return a.groupBy("work_id").agg(F.array_sort(F.collect_set(F.when(F.col("ok0"), F.col("l0")))).alias("l0s"), F.array_sort(F.collect_set(F.when(F.col("ok1"), F.col("l1")))).alias("l1s"))


def marginals(members: DataFrame, column: str, node: str) -> DataFrame:
    """Works by label."""
    return members.select(F.explode(column).alias(node)).groupBy(node).agg(F.count(F.lit(1)).alias(f"f_{node}"))


def joints(members: DataFrame) -> DataFrame:
    """Works by pair of labels; the pairs are those of each work's own two lists."""
    return members.select(F.explode("l1s").alias("l1"), "l0s").select("l1", F.explode("l0s").alias("l0")).groupBy("l1", "l0").agg(F.count(F.lit(1)).alias("f_joint"))


def metrics(total: Column, l: Column, r: Column, joint: Column) -> dict[str, Column]:
    """Ngd, ngd_status, zero_cooccurrence, joint_over_l0, joint_over_l1, jaccard; each null by its own rule."""
    ratio = F.try_divide(F.greatest(l, r).cast("double"), joint)
    span = F.try_divide(total.cast("double"), F.least(l, r))
    status = F.when(F.least(l, r) == 0, "zero_marginal").when(joint == 0, "zero_cooccurrence").when((l == total) & (r == total), "zero_denominator").otherwise("defined")
    ngd = F.when(status == "defined", F.try_divide(F.ln(ratio), F.ln(span)))
    return {
        "ngd": ngd,
        "ngd_status": F.when((status == "defined") & (ngd < 0), "numerical_warning").otherwise(status),
        "zero_cooccurrence": joint == 0,
        "joint_over_l0": F.try_divide(joint.cast("double"), l),
        "joint_over_l1": F.try_divide(joint.cast("double"), r),
        "jaccard": F.try_divide(joint.cast("double"), l + r - joint),
    }


def matrix(members: DataFrame, nodes0: DataFrame, nodes1: DataFrame, parents: DataFrame) -> DataFrame:
    """A row for every pair of dictionary nodes, with counts, metrics and whether l0 is l1's parent. The pairs
    are of two dictionaries, whatever the number of works. parents: l1, l0."""
    total = members.agg(F.count(F.lit(1)).alias("total"))
    f0 = nodes0.join(marginals(members, "l0s", "l0"), "l0", "left").fillna(0, ["f_l0"])
    f1 = nodes1.join(marginals(members, "l1s", "l1"), "l1", "left").fillna(0, ["f_l1"])
    pairs = f1.crossJoin(F.broadcast(f0)).crossJoin(F.broadcast(total))
    pairs = pairs.join(joints(members), ["l1", "l0"], "left").fillna(0, ["f_joint"])
    tagged = pairs.join(parents.select("l1", "l0", F.lit(True).alias("is_parent_pair")), ["l1", "l0"], "left").fillna(False, ["is_parent_pair"])
    return tagged.withColumns(metrics(F.col("total"), F.col("f_l0"), F.col("f_l1"), F.col("f_joint")))


def ranked(rows: DataFrame) -> DataFrame:
    """Dense rank by distance within l1, over all and without parents; pairs without a distance have none."""
    out = dense_ranks(rows, ["l1"], "ngd", F.lit(True), "ngd_rank_for_l1")
    return dense_ranks(out, ["l1"], "ngd", ~F.col("is_parent_pair"), "ngd_rank_excluding_parent")


def audit(labels: DataFrame, nodes0: DataFrame, nodes1: DataFrame) -> DataFrame:
    """Labels that a dictionary lacks, by kind: rows and works."""
    a = labels.join(nodes0.withColumn("ok0", F.lit(True)), "l0", "left").join(nodes1.withColumn("ok1", F.lit(True)), "l1", "left")
    kind = F.explode(F.array_compact(F.array(F.when(F.col("ok0").isNull(), "unresolved_l0"), F.when(F.col("ok1").isNull(), "unresolved_l1"))))
    return a.select("work_id", kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("work_id").alias("works"))


def chain_violations(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Dictionary rows whose parent is missing or given twice. children: id, parent; parents: id."""
    p = parents.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    lost = children.join(p, "parent", "left").where(F.col("known").isNull()).select("id", F.lit("missing_parent").alias("problem"))
    twice = children.groupBy("id").agg(F.count_distinct("parent").alias("n")).where("n > 1").select("id", F.lit("several_parents").alias("problem"))
    return lost.unionByName(twice)


def containment(rows: DataFrame) -> DataFrame:
    """Parent pairs whose joint count falls short of the child's."""
    return rows.where(F.col("is_parent_pair") & (F.col("f_joint") != F.col("f_l1"))).select("l1", "l0", "f_l1", "f_joint")
