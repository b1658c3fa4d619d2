"""A corpus pipeline over the training-data operators; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.llm import language_id, mixing, near_dedup, packing, secrets
from citelode.llm.common import materialize, spare_name, table, text_hash


def _keys(frame: DataFrame, names: tuple[str, str], h: Column) -> DataFrame:
    """frame with two join keys that are never null: the id, and a hash that tells its texts and a null id apart."""
    return frame.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), names[1]: F.xxhash64(F.col("doc_id").isNull(), h)})


def _matched(docs: DataFrame, found: DataFrame, values: dict[str, str]) -> DataFrame:
    """Different rows of docs by doc_id and text, with the found values for them (doc_id, text_hash and the keys of values)
    under the names that values gives. The texts move once: the join and the removal of repeated rows go by the same keys."""
    keys = (spare_name(docs, "_row_id"), spare_name(docs, "_row_hash"))
    f = _keys(found, keys, F.col("text_hash")).select(*keys, *[F.col(c).alias(n) for c, n in values.items()])
    return _keys(docs, keys, text_hash(F.col("text"))).join(f, list(keys)).dropDuplicates(list(keys)).drop(*keys)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    guess = language_id.result_names(docs)["lang_pred"]
    return language_id.identify(docs).where(F.col(guess) != language_id.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies; rows alike in id and text stay once."""
    found = near_dedup.near_duplicates(docs).where("kept")
    kept = found.groupBy("doc_id", "text_hash").agg(F.lit(True).alias("kept"))
    return _matched(docs, kept, {"kept": spare_name(docs, "_kept")}).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by <SECRET>; n_chars follows the text."""
    model = secrets.fit(secrets.samples(docs, "text", "doc_id"))
    as_column = spare_name(docs, "_found")
    got = secrets.scan(docs, model, as_column=as_column).withColumn("text", F.coalesce(F.col(f"{as_column}.redacted"), "text"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, in the mix's order; those it does not take go. Rows alike in id
    and text are one document of as many copies as they have together."""
    found = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.sort_array(F.flatten(F.collect_list("finish"))).alias("finish"), F.min("shuffle").alias("shuffle"))
    names = {n: spare_name(docs, f"_{n}") for n in ("finish", "shuffle")}
    rows = _matched(docs, found.where(F.size("finish") > 0), names)
    return mixing.in_order(rows, *names.values()).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces of documents."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("secret_scans", redact_secrets), ("source_mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


#: The language models, the set similarity join and the packing are not expressible in SQL.
ORACLE_SQL = None
