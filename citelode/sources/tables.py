"""Table loading with fixed schemas, and checks of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schemas of the driver's tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; nothing is inferred from folder names. The dictionaries are read under their fixed schemas."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An explicit list of files, as a manifest gives it."""
    return spark.read.parquet(*paths)


def load_glob(spark: SparkSession, pattern: str, with_file: bool = False) -> DataFrame:
    """A glob, with the file each row is from on request."""
    df = spark.read.parquet(pattern)
    return df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)) if with_file else df


def relation(spark: SparkSession, rows: list[tuple], schema: str, view: str | None = None) -> DataFrame:
    """A small in-memory relation, as a view on request."""
    df = spark.createDataFrame(rows, schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def load_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; a byte-order mark does not reach the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def load_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip by file name, under an explicit schema."""
    return spark.read.schema(schema).json(path)


def manifest_accounting(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose stated rows and bytes differ from the sum over their files.
    files: entity, path, rows, bytes; entities: entity, rows, bytes."""
    got = files.groupBy("entity").agg(F.sum("rows").alias("file_rows"), F.sum("bytes").alias("file_bytes"), F.count_if(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")).alias("unsafe_paths"))
    j = entities.join(got, "entity", "full_outer")
    return j.where(~F.col("rows").eqNullSafe(F.col("file_rows")) | ~F.col("bytes").eqNullSafe(F.col("file_bytes")) | (F.col("unsafe_paths") > 0))


def schema_paths(schema: T.StructType) -> list[tuple[str, str]]:
    """Every field path with its type; array elements are [], map values {}."""
    out: list[tuple[str, str]] = []

    def walk(path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{path}.{f.name}" if path else f.name, f.dataType)
        elif isinstance(kind, T.ArrayType):
            walk(f"{path}[]", kind.elementType)
        elif isinstance(kind, T.MapType):
            walk(f"{path}{{}}", kind.valueType)
        else:
            out.append((path, kind.simpleString()))

    walk("", schema)
    return out


def schema_audit(spark: SparkSession, actual: T.StructType, expected: T.StructType) -> DataFrame:
    """Path, expected, actual for every field path that differs; no rows if all agree."""
    a, e = dict(schema_paths(actual)), dict(schema_paths(expected))
    rows = [(p, e.get(p), a.get(p)) for p in sorted(a.keys() | e.keys()) if a.get(p) != e.get(p)]
    return spark.createDataFrame(rows, "path string, expected string, actual string")


def unlisted(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths that are there and that the manifest lacks."""
    return found.join(listed, "path", "left_anti")


def footprint(df: DataFrame, table: str) -> DataFrame:
    """Rows and a hash of the schema."""
    from hashlib import sha256

    return df.agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.lit(sha256(df.schema.json().encode()).hexdigest()).alias("schema_sha256"))
