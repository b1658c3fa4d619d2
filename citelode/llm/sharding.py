"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of a similar size (a tier: sizes within a factor of each
other) are merged, in the order in which they came, into files of about the target size. Each append and each merge
commits a new version of the manifest: the list of live shards is written as a table, then a small pointer file
is renamed into place, which fails if another writer has taken that version. Readers see one version or the next,
never a part; a version stays readable until it is expired.

A shard is a folder ``data/_folder=<write>/_group=<number>/_part=<number>`` and is known by these three; names are for
reading only, so no width limits them. A shard's size is what its texts hold in bytes, kept beside each row, so plans do
not depend on codecs and sizes are read without the texts. An arrival above the target goes to several shards, by
hash, so that no shard is one task's burden. Planning is SQL over the manifest; the rows of merged shards move once,
each output to the task of its own dense number.

Columns of the rows may have any names: those that look like the store's own are written with one more underscore and
read back without it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

KEY = ["folder", "group", "part"]
MANIFEST = "shard string, folder string, group long, part long, version long, rows long, bytes long"
LISTED = 200_000  # shards up to which a plan (under 100 bytes each) is sent to all executors
SPREAD_FILES = 4  # files a shard on average, above which rows are dealt by shard before they are written


class Conflict(RuntimeError):
    """Another writer committed the version first; nothing was changed."""


def _stored(name: str) -> str:
    return name + "_" if re.fullmatch(r"_(folder|group|part|bytes)_*", name, re.I) else name


def _shown(name: str) -> str:
    return name[:-1] if re.fullmatch(r"_(folder|group|part|bytes)_+", name, re.I) else name


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, factor: int = 4, tiers: int = 12, size_of: str = "text"):
        self.spark, self.root, self.target, self.factor, self.tiers, self.size_of = spark, root.rstrip("/"), target_bytes, factor, tiers, size_of

    # --- versions

    def _fs(self):
        jvm = self.spark._jvm
        here = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs, here.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions that are not expired, from the oldest."""
        hadoop, fs = self._fs()
        folder = hadoop.Path(f"{self.root}/versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v[0-9]+\.json", n))

    def version(self) -> int:
        """The newest committed version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _pointer(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/versions/v{version}.json", wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, by default the newest; none before the first commit."""
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self._pointer(v)['table']}")

    def schema(self, version: int | None = None) -> T.StructType:
        """Columns of the rows, as they were appended."""
        v = self.version() if version is None else version
        return T.StructType.fromJson(self._pointer(v)["schema"]) if v else T.StructType()

    def commit(self, base: int, live: DataFrame, schema: T.StructType | None = None) -> int:
        """Makes live the version after base, or raises Conflict. schema: of the rows, by default as in base."""
        hadoop, fs = self._fs()
        schema = self.schema(base) if schema is None else schema
        name = f"manifests/{uuid.uuid4().hex}"
        live.coalesce(1 + live.count() // 1_000_000).write.parquet(f"{self.root}/{name}")
        jvm = self.spark._jvm
        new, done = hadoop.Path(f"{self.root}/versions/.{uuid.uuid4().hex}"), hadoop.Path(f"{self.root}/versions/v{base + 1}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"version": base + 1, "table": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        rename = getattr(hadoop, "Options$Rename")
        flags = self.spark.sparkContext._gateway.new_array(rename, 1)
        flags[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, done, flags)
        except Exception as e:
            fs.delete(new, False)
            raise Conflict(f"version {base + 1}") from e
        return base + 1

    def expire(self, keep: int = 1) -> None:
        """Drops all versions but the newest keep, and the writes of which none of these has a shard."""
        hadoop, fs = self._fs()
        every = self.versions()
        old = every[:-keep]
        folders = {v: {r["folder"] for r in self.manifest(v).select("folder").distinct().collect()} for v in every}  # a folder a write
        tables = {v: self._pointer(v)["table"] for v in old}
        for v in old:
            fs.delete(hadoop.Path(f"{self.root}/versions/v{v}.json"), False)
            fs.delete(hadoop.Path(f"{self.root}/{tables[v]}"), True)
        live = set().union(*(folders[v] for v in every[-keep:]))
        for folder in set().union(*folders.values()) - live:
            fs.delete(hadoop.Path(f"{self.root}/data/_folder={folder}"), True)

    # --- writes

    def append(self, df: DataFrame, arrival: Column, spread: Column) -> int:
        """Adds rows as shards a<arrival>-<part>; parts by pmod(spread, parts), one a target. Without rows the shards stay
        as they are. Arrival numbers are the caller's; null counts as 0. Null texts have no bytes, equal rows are
        rows of their own. Columns may come and go between appends; one that changes its type is an error."""
        base = self.version()
        have = {f.name: f for f in self.schema(base).fields}
        for f in df.schema.fields:
            if have.setdefault(f.name, T.StructField(f.name, f.dataType, True)).dataType != f.dataType:
                raise TypeError(f"column {f.name} is {have[f.name].dataType.simpleString()} in the store")
        size = F.coalesce(F.octet_length(self.size_of), F.lit(0)).cast("long")
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(arrival.cast("long"), F.lit(0)).alias("_group"), F.coalesce(spread.cast("long"), F.lit(0)).alias("spread"), size.alias("_bytes"))
        sizes = rows.withColumn("task", F.spark_partition_id()).groupBy("_group", "task").agg(F.sum("_bytes").alias("b")).groupBy("_group").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("files"))
        sizes = sizes.select("_group", F.greatest(F.lit(1), F.ceil(F.col("b") / self.target)).cast("long").alias("parts"), "files").persist()
        seen = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files"), F.sum("parts").alias("parts"), F.count(F.when(F.col("parts") > 1, 1)).alias("many")).first()
        many = sizes.where("parts > 1").select("_group", "parts")
        if not seen["many"]:
            rows = rows.withColumn("_part", F.lit(0).cast("long"))
        else:
            rows = rows.join(F.broadcast(many) if seen["many"] <= LISTED else many, "_group", "left")
            rows = rows.withColumn("_part", F.pmod("spread", F.coalesce("parts", F.lit(1))))
        rows = rows.select(*[F.col("row")[c].alias(_stored(c)) for c in df.columns], "_bytes", "_group", "_part")
        if seen["n"] and seen["files"] > SPREAD_FILES * seen["n"]:
            rows = rows.repartition("_group", "_part")
        name = F.concat(F.lit("a"), F.col("group").cast("string"), F.lit("-"), F.col("part").cast("string"))
        out = self.commit(base, self.manifest(base).unionByName(self._write(rows, name, base + 1)), T.StructType(list(have.values())))
        sizes.unpersist()
        return out

    def _write(self, rows: DataFrame, name: Column, version: int) -> DataFrame:
        """Writes rows with _bytes, _group and _part; the manifest of what was written."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/_folder={folder}"
        rows.write.option("compression", "zstd").partitionBy("_group", "_part").parquet(path)
        hadoop, fs = self._fs()
        if not any(s.getPath().getName().startswith("_group=") for s in fs.listStatus(hadoop.Path(path))):
            return self.spark.createDataFrame([], MANIFEST)
        got = self.spark.read.schema("_bytes long, _group long, _part long").parquet(path)
        got = got.groupBy(F.col("_group").alias("group"), F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"))
        return got.select(name.alias("shard"), F.lit(folder).alias("folder"), "group", "part", F.lit(version).cast("long").alias("version"), "rows", "bytes")

    # --- reads

    def _scan(self, live: DataFrame, schema: T.StructType) -> DataFrame | None:
        """All rows of the writes that live names, in one scan, with _bytes and the three columns of the key; stored names."""
        folders = sorted(r["folder"] for r in live.select("folder").distinct().collect())  # a folder a write
        if not folders:
            return None
        fields = [T.StructField(_stored(f.name), f.dataType) for f in schema.fields]
        kinds = [("_bytes", T.LongType()), ("_folder", T.StringType()), ("_group", T.LongType()), ("_part", T.LongType())]
        whole = T.StructType(fields + [T.StructField(n, t) for n, t in kinds])
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/_folder={f}" for f in folders])

    def _joined(self, scan: DataFrame, shards: DataFrame, count: int) -> DataFrame:
        """scan with the columns of shards (key first), for these shards only."""
        shards = shards.withColumnsRenamed({c: f"_{c}" for c in KEY})
        return scan.join(F.broadcast(shards) if count <= LISTED else shards, [f"_{c}" for c in KEY])

    def read(self, version: int | None = None, as_column: str | None = None) -> DataFrame:
        """Rows of the live shards of a version, with the shard's place in the manifest (folder/group/part) where
        as_column names a column for it. A store without rows gives none, under the columns of what was appended."""
        v = self.version() if version is None else version
        live, schema = self.manifest(v), self.schema(v)
        scan = self._scan(live, schema)
        if scan is None:
            extra = [T.StructField(as_column, T.StringType())] if as_column else []
            return self.spark.createDataFrame([], T.StructType(schema.fields + extra))
        rows = self._joined(scan, live.select(*KEY), live.count())
        place = [self.place(F.col("_folder"), F.col("_group"), F.col("_part")).alias(as_column)] if as_column else []
        return rows.select(*[F.col(f"`{_stored(f.name)}`").alias(f.name) for f in schema.fields], *place)

    @staticmethod
    def place(folder: Column, group: Column, part: Column) -> Column:
        return F.concat_ws("/", folder, group.cast("string"), part.cast("string"))

    # --- compaction

    def plan(self, live: DataFrame) -> DataFrame:
        """Live shards with tier and run, the merge that each goes into; run is null for those that stay.

        Tier k holds sizes from target / factor ** k up to the next; tier 0 is full-sized. Within a tier shards go,
        in the order of version, group and part, to the run floor(bytes before / target). A run is merged if it has
        factor shards, or two or more that reach the target together. Empty shards count as the smallest tier."""
        tier = F.lit(self.tiers)
        for k in range(self.tiers - 1, -1, -1):
            tier = F.when(F.col("bytes") * self.factor**k >= self.target, k).otherwise(tier)
        before = Window.partitionBy("tier").orderBy("version", "group", "part").rowsBetween(Window.unboundedPreceding, -1)
        of = Window.partitionBy("tier", "run")
        rows = live.withColumn("tier", tier).withColumn("run", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / self.target))
        n, total = F.count(F.lit(1)).over(of), F.sum("bytes").over(of)
        merges = (F.col("tier") > 0) & (n > 1) & ((n >= self.factor) | (total >= self.target))
        return rows.withColumn("merges", merges).withColumn("run", F.when(F.col("merges"), F.col("run"))).drop("merges")

    def compact(self) -> int:
        """One round of merges, committed as one version; returns the version, the old one if nothing merges."""
        base = self.version()
        live = self.manifest(base)
        plan = self.plan(live).persist()
        moving = plan.where(F.col("run").isNotNull())
        outs = moving.select("tier", "run").distinct().withColumn("out", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", "run")) - 1)
        n = outs.count()
        if not n:
            plan.unpersist()
            return base
        step = moving.select(*KEY, "tier", "run").join(F.broadcast(outs) if n <= LISTED else outs, ["tier", "run"]).select(*KEY, F.col("tier").alias("_to_group"), F.col("run").alias("_to_part"), F.col("out").alias("_out"))
        scan = self._scan(moving, self.schema(base))
        stored = [f"`{c}`" for c in scan.columns[:-3]]
        rows = self._joined(scan, step, step.count())
        rows = rows.select(*stored, F.col("_to_group").cast("long").alias("_group"), F.col("_to_part").cast("long").alias("_part"), "_out").repartitionById(n, F.col("_out").cast("int")).drop("_out")
        name = F.concat(F.lit(f"m{base + 1}-"), F.col("group").cast("string"), F.lit("-"), F.col("part").cast("string"))
        merged = self._write(rows, name, base + 1)
        stay = plan.where(F.col("run").isNull()).select(*merged.columns)
        out = self.commit(base, stay.unionByName(merged))
        plan.unpersist()
        return out

    def compact_all(self) -> int:
        """Rounds until nothing merges; each has fewer shards than the one before, so they end."""
        at = self.version()
        while (new := self.compact()) != at:
            at = new
        return at
