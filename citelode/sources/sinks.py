"""Sinks: Parquet, text exports, section chunks with a manifest, packed rows."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.functions import normalize as N


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """ZSTD Parquet; the committer makes it appear whole or not at all."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_tables(base: DataFrame, projections: dict[str, DataFrame], root: str) -> None:
    """Several typed tables of one base, which is computed once."""
    base.persist()
    try:
        for name, df in projections.items():
            write_parquet(df, f"{root}/{name}")
    finally:
        base.unpersist()


def write_text(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Gzip CSV (formula-safe text) or JSON."""
    if kind == "json":
        df.write.mode("overwrite").option("compression", "gzip").json(path)
        return
    safe = df.select(*[N.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    safe.write.mode("overwrite").option("compression", "gzip").option("header", True).option("escape", '"').csv(path)


def section_chunks(charts: dict[str, DataFrame]) -> dict:
    """Rows of small result tables as JSON sections, with their SHA-256 in a manifest."""
    sections = {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in charts.items()}
    text = {name: json.dumps(rows, sort_keys=True, ensure_ascii=False) for name, rows in sections.items()}
    return {"sections": text, "manifest": {name: hashlib.sha256(t.encode()).hexdigest() for name, t in text.items()}}


def pack_rows(rows: list[dict]) -> str:
    """Rows as columns, deflated and base64."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    packed = {"columns": names, "rows": [[r.get(k) for k in names] for r in rows]}
    return base64.b64encode(zlib.compress(json.dumps(packed, separators=(",", ":")).encode(), 9)).decode()


def unpack_rows(text: str) -> list[dict]:
    packed = json.loads(zlib.decompress(base64.b64decode(text)))
    return [dict(zip(packed["columns"], r, strict=True)) for r in packed["rows"]]


def result_views(frames: dict[str, DataFrame]) -> None:
    """Named views over results."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
