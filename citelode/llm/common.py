"""Helpers shared by the training-data operators: scratch tables, words, hashing, Python workers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: dict[str, str] = {}


def by_value(module: str) -> None:
    """Ships the module's functions inside the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset a folder of our own serves a local
    master, whose executors see it; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='citelode-')}"
    return _OWN[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/citelode/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; for when the results that read them are written."""
    _delete(spark, _own_folder(spark))


def materialize(df: DataFrame, name: str, codec: str = "zstd", replaces: DataFrame | None = None) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back: cuts lineage and survives lost executors.
    replaces: an earlier scratch table that nothing else reads; it is deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if replaces is not None and getattr(replaces, "_scratch", None):
        _delete(spark, replaces._scratch)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Array of the words of a text; no words for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, SPACES, "")


def constant(values: DataFrame) -> Column:
    """The numbers of a frame with one column, long or double, in its order, as one constant array that every task gets
    once. For frames of a proven size only. A scalar subquery would do, but it is not allowed in higher-order functions,
    and as a column it would be copied into every row. The array is packed, else plans would spell out every number."""
    jvm = values.sparkSession._jvm
    kind = values.schema[0].dataType.simpleString()
    encoder = {"bigint": "LONG", "double": "DOUBLE"}[kind]
    boxed = getattr(values._jdf, "as")(getattr(jvm.org.apache.spark.sql.Encoders, encoder)()).collect()
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    packed = catalyst.UnsafeArrayData.fromPrimitiveArray(jvm.org.apache.commons.lang3.ArrayUtils.toPrimitive(boxed))
    array = jvm.org.apache.spark.sql.types.DataType.fromDDL(f"array<{kind}>")
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(catalyst.Literal(packed, array)))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what a Python worker holds at once where texts are long. For frames that are returned before they run."""
    spark.conf.set(BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Small batches for what runs inside; the session's own setting comes back after."""
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def tidy() -> None:
    """Gives a Python worker's free memory back to the system; workers live on into other stages."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spare_name(df: DataFrame | Iterable[str], base: str) -> str:
    """A column name the frame (or list of names) doesn't have, case aside."""
    have = {c.lower() for c in (df.columns if hasattr(df, "columns") else df)}
    while base.lower() in have:
        base += "_"
    return base


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of df whose names are none of the given ones, case aside."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def text_hash(text: Column) -> Column:
    """Tells rows with one key and different texts apart; null counts as a text of its own."""
    return F.xxhash64(text, text.isNull())


def plain(values) -> pd.Series:
    """A column of Python objects; pandas' own string type can't always go into a struct."""
    return pd.Series(list(values), dtype=object)


by_value(__name__)
