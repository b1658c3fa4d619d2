"""Identity: originals and notices from source records, matching by two identifiers, link roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def originals(records: DataFrame) -> DataFrame:
    """A10: one row an original, from records (record_id, key, label, date, event_date): sets united, earliest dates,
    a flag where records differ in date. Records of a hot original are united on the map side first."""
    return records.groupBy("key").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("record_id").alias("first_record"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.min("date").alias("date"),
        F.min("event_date").alias("event_date"),
        (F.count_distinct("event_date") > 1).alias("event_date_conflict"),
    )


def original_key(doi, pmid, record):
    """The identifier that names an original: DOI, else PubMed id, else the record's own."""
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("record:"), record.cast("string")))


def notices(records: DataFrame) -> DataFrame:
    """One row a notice (identifier, nature, date); a notice of several originals doesn't join them."""
    return records.groupBy("notice", "nature", "date").agg(F.count_distinct("key").alias("originals"), F.count(F.lit(1)).alias("records"))


def accounting(records: DataFrame, state) -> DataFrame:
    """Records by what became of them."""
    return records.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("records"))


def match(papers: DataFrame, by_doi: DataFrame, by_pmid: DataFrame) -> DataFrame:
    """Papers (key, doi, pmid) against indexes (doi or pmid, work_id).

    conflicting: both identifiers lead to works but to none in common; ambiguous: more than one work is left; unique;
    absent: the paper has no identifier; unmatched. Only a unique match selects a work; nothing breaks a tie."""
    d = papers.where(F.col("doi").isNotNull()).join(by_doi, "doi").groupBy("key").agg(F.collect_set("work_id").alias("d"))
    p = papers.where(F.col("pmid").isNotNull()).join(by_pmid, "pmid").groupBy("key").agg(F.collect_set("work_id").alias("p"))
    none = F.array().cast("array<bigint>")
    j = papers.join(d, "key", "left").join(p, "key", "left").withColumns({"d": F.coalesce("d", none), "p": F.coalesce("p", none)})
    both = (F.size("d") > 0) & (F.size("p") > 0)
    left = F.when(both, F.array_intersect("d", "p")).otherwise(F.array_union("d", "p"))
    j = j.withColumn("left", left)
    outcome = F.when(both & (F.size("left") == 0), "conflicting").when(F.size("left") > 1, "ambiguous").when(F.size("left") == 1, "unique").when(F.col("doi").isNull() & F.col("pmid").isNull(), "absent").otherwise("unmatched")
    return j.select("key", outcome.alias("outcome"), F.when(F.size("left") == 1, F.get("left", F.lit(0))).alias("work_id"), F.size("left").alias("candidates"))


def demote_shared(matches: DataFrame) -> DataFrame:
    """A work that several papers select is none's: their unique matches become ambiguous."""
    shared = matches.where("outcome = 'unique'").groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("work_id", F.lit(True).alias("shared"))
    j = matches.join(shared, "work_id", "left")
    lost = F.coalesce("shared", F.lit(False))
    return j.select("key", F.when(lost, "ambiguous").otherwise(F.col("outcome")).alias("outcome"), F.when(~lost, F.col("work_id")).alias("work_id"), "candidates")


def event_roll_up(links: DataFrame) -> DataFrame:
    """One event a work from its linked originals (work_id, event_date): kept only if all have it and agree."""
    return links.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("originals"),
        F.when((F.count_distinct("event_date") == 1) & (F.count("event_date") == F.count(F.lit(1))), F.min("event_date")).alias("event_date"),
        (F.count_distinct("event_date") > 1).alias("event_date_conflict"),
    )


def independent_notices(links: DataFrame, originals: DataFrame) -> DataFrame:
    """Works by the number of different originals their notices point to, and whether a notice stands alone
    (is no original itself). links: notice_id, original_id; originals: work_id."""
    own = originals.select(F.col("work_id").alias("notice_id"), F.lit(True).alias("is_original"))
    per = links.groupBy("notice_id").agg(F.count_distinct("original_id").alias("originals"))
    return per.join(own, "notice_id", "left").select("notice_id", "originals", F.col("is_original").isNull().alias("independent"), (F.col("originals") > 1).alias("uncertain"))
