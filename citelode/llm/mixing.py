"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and with it, in a shuffled order, divided by
the source's target. A source whose target exceeds it goes round again, up to a number of epochs. All documents are
ranged by finish time and cut where the running total reaches the budget.

No source is one task: running sums go by (source, leading digits of the shuffling hash), and the sums before such a
block are added from a table of block totals. The cut is found by two rounds of totals over bins of finish time and
an exact running sum within the last bin, a sixteen-millionth of the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.llm.common import materialize, text_hash, words

BINS = 4096
FAR = 4 * BINS


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, epochs: int = 3, cycle: int = 3) -> DataFrame:
    """Source table (source, source_size, weight, rank, target) from rows (source, size). Sources by code point, null
    last, weigh 1 .. cycle in turn and share the sum of all sizes by weight; a target stops at epochs times its
    source's size and the excess is shared again by weight until none is above."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % cycle + 1)
    whole = Window.partitionBy(F.lit(0))
    full = F.col("source_size") * epochs
    fill = Window.partitionBy(F.lit(0)).orderBy((full / F.col("weight")), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    s = s.withColumns({"_total": F.sum("source_size").over(whole), "_weights": F.sum("weight").over(whole)})
    s = s.withColumns({"_full": full, "_before": F.coalesce(F.sum(full).over(fill), F.lit(0)), "_gone": F.coalesce(F.sum("weight").over(fill), F.lit(0))})
    s = s.withColumn("_sated", F.col("_full").cast("decimal(24,0)") * (F.col("_weights") - F.col("_gone")).cast("decimal(14,0)") <= F.col("weight").cast("decimal(14,0)") * (F.col("_total") - F.col("_before")).cast("decimal(24,0)"))
    left = (F.first("_total").over(whole) - F.coalesce(F.sum(F.when(F.col("_sated"), F.col("_full"))).over(whole), F.lit(0))).cast("double")
    share = F.sum(F.when(~F.col("_sated"), F.col("weight"))).over(whole)
    target = F.when(F.col("_sated"), F.col("_full").cast("double")).otherwise(F.col("weight") * F.try_divide(left, share))
    return s.select("source", "source_size", F.col("weight").cast("long").alias("weight"), "rank", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3) -> DataFrame:
    """key, source, size, source_size, target, copies (how often the mix takes it), finish (the virtual finish times of
    the copies taken, array<double>), shuffle (the hash that breaks ties) and text_hash of each row. in_order gives the mix.

    Null texts have size 0 and count 0 words taken; a null source is a source; a null key shuffles as the empty
    text; equal rows are rows of their own. Empty input gives no rows. The same rows give the same mix."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), text_hash(F.col(text)).alias("text_hash"))
    rows = materialize(rows.withColumn("h", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))), "mix-sizes")
    plan = materialize(targets(rows, epochs).withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).drop("source"), "mix-targets")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]

    rows = rows.withColumns({"src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")), "block": F.substring("h", 1, 3)})
    sums = rows.groupBy("src", "block").agg(F.sum("size").alias("n"))
    before = sums.select("src", "block", (F.sum("n").over(Window.partitionBy("src").orderBy("block")) - F.col("n")).alias("before"))
    within = Window.partitionBy("src", "block").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(within)).join(before, ["src", "block"]).withColumn("run", F.col("run") + F.col("before")).drop("before", "block")
    rows = materialize(rows.join(plan, "src"), "mix-runs")

    def finish(epoch: Column | int) -> Column:
        return F.when(F.col("target") > 0, (F.col("source_size") * epoch + F.col("run")).cast("double") / F.col("target")).otherwise(F.lit(0.0))

    items = rows.select("rank", "h", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("k"), "size", "source_size", "run", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("e")).withColumn("f", finish(F.col("e")))
    coarse = F.least(F.lit(FAR), F.floor(F.col("f") * BINS))
    fine = F.floor((F.col("f") * BINS - F.floor(F.col("f") * BINS)) * BINS)
    done = 0
    for level, bin_of in (("c", coarse), ("d", fine)):
        items = items.withColumn(level, bin_of)
        run = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(level))
        over = items.groupBy(level).agg(F.sum("size").alias("n")).select(level, "n", run.alias("to")).where(F.col("to") + done > total).orderBy(level).limit(1).collect()
        if not over:
            break
        done += over[0]["to"] - over[0]["n"]
        items = items.where(F.col(level) == over[0][level])
    else:
        order = F.struct("f", "rank", "h", "k", "e", "size")
        run = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        first = items.select(order.alias("o"), run.alias("to")).where(F.col("to") + done > total).agg(F.min("o").alias("o")).first()["o"]
        cut = F.struct(*[F.lit(first[n]).cast(t).alias(n) for n, t in (("f", "double"), ("rank", "int"), ("h", "string"), ("k", "string"), ("e", "int"), ("size", "long"))])
        own = F.coalesce(F.col("key").cast("string"), F.lit(""))
        taken = sum((F.when(F.struct(finish(e).alias("f"), F.col("rank"), F.col("h"), own.alias("k"), F.lit(e).alias("e"), F.col("size")) < cut, 1).otherwise(0) for e in range(epochs)), F.lit(0))
        rows = rows.withColumn("copies", taken)
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(epochs))
    times = F.slice(F.array(*[finish(e) for e in range(epochs)]), F.lit(1), F.col("copies"))
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", times.alias("finish"), F.col("h").alias("shuffle"), "text_hash")


def in_order(rows: DataFrame, finish: str, shuffle: str) -> DataFrame:
    """rows, each as often as it has finish times, ranged and sorted by finish time, then shuffle: the interleaved mix.
    The two columns are dropped."""
    each = rows.withColumn(finish, F.explode(finish))
    return each.orderBy(finish, shuffle).drop(finish, shuffle)
