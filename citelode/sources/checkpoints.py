"""Shard checkpoints, and edges stored so that neighbours lie together."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_mark(spark: SparkSession, folder: str) -> dict:
    where, fs = _file(spark, f"{folder}.done.json")
    if not fs.exists(where):
        return {}
    return json.loads(spark.read.text(str(where), wholetext=True).first()[0]) if fs.getFileStatus(where).getLen() else {}


def _files(spark: SparkSession, folder: str) -> str:
    """A digest of the data files' names and lengths."""
    where, fs = _file(spark, folder)
    if not fs.exists(where):
        return ""
    seen = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", ".")))
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def run_shards(spark: SparkSession, root: str, shards: dict[str, tuple[str, Callable[[], DataFrame]]]) -> dict[str, bool]:
    """V2: writes each shard (name: fingerprint of its inputs, and what makes it) under root, unless its mark says that the
    same fingerprint made the files that are there; says which were made. A mark is written after its shard is whole."""
    made = {}
    for name, (fingerprint, build) in shards.items():
        folder = f"{root}/{name}"
        mark = _read_mark(spark, folder)
        made[name] = mark.get("fingerprint") != fingerprint or mark.get("files") != _files(spark, folder)
        if made[name]:
            build().write.mode("overwrite").option("compression", "zstd").parquet(folder)
            where, fs = _file(spark, f"{folder}.done.json")
            out = fs.create(where, True)
            out.write(bytearray(json.dumps({"fingerprint": fingerprint, "files": _files(spark, folder)}).encode()))
            out.close()
    return made


def store_edges(edges: DataFrame, table: str, path: str, by: str, buckets: int) -> DataFrame:
    """Edges as a table of buckets by one end, each sorted by it, so that joins and aggregates on that end need no
    shuffle; the stored adjacency of the record model."""
    edges.write.mode("overwrite").option("path", path).option("compression", "zstd").bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    return edges.sparkSession.table(table)
