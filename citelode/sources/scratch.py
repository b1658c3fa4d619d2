"""A folder for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that spark.checkpoint.dir names; a local master may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="citelode-"))
    return f"{shared.rstrip('/')}/citelode-tables/{name}-{uuid.uuid4().hex}"
