"""Queries over the training-data operators, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.llm import fingerprints, language_id, mixing, near_dedup, packing, pii, quality, secrets, sharding, urls
from citelode.llm.common import fresh_path, table

#: The rules for pages.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in blocks of 4,096 ids, eight arrivals of 256 and one of 2,048 each, so arrivals stay small and
    grow in number with the input; every other one with the first append, the rest with the second. Compaction runs to its
    end after each, and what it replaced is expired. Every document as read back, with its shard's rows, bytes and least id."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"))
    at = F.pmod(F.col("doc_id"), F.lit(4096))
    arrival = F.floor(F.col("doc_id") / 4096) * 9 + F.when(at < 2048, F.floor(at / 256)).otherwise(8)
    for half in (0, 1):
        store.append(docs.where(F.pmod(arrival, F.lit(2)) == half), arrival, F.col("doc_id"))
        store.compact_all()
        store.expire()
    rows = store.read(as_column="place")
    least = rows.groupBy("place").agg(F.min("doc_id").alias("shard_least"))
    live = store.manifest().select(store.place(F.col("folder"), F.col("group"), F.col("part")).alias("place"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    shards = live.join(least, "place")
    small = rows.select("place", "doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return small.join(F.broadcast(shards) if live.count() <= sharding.LISTED else shards, "place").drop("place")


def _op1_sql() -> str:
    """Shards as sets of first shards (one an arrival and part) with version, group and part; two appends, three rounds of
    merges after each, which are more than these sizes need. A round that merges nothing changes nothing."""
    parts = [
        """d AS (SELECT *, coalesce(octet_length(encode(text)), 0) AS b, doc_id // 4096 * 9 + CASE WHEN doc_id % 4096 < 2048 THEN doc_id % 4096 // 256 ELSE 8 END AS arrival FROM documents)""",
        """p AS (SELECT arrival, greatest(1, (sum(b) + 134217727) // 134217728) AS parts FROM d GROUP BY arrival)""",
        """e AS (SELECT d.*, doc_id % parts AS part FROM d JOIN p USING (arrival))""",
        """s AS (SELECT arrival, part, count(*) AS n, sum(b) AS b FROM e GROUP BY ALL)""",
        """c0 AS (SELECT arrival, part, n, b, 1 AS v, arrival AS g, part AS q FROM s WHERE arrival % 2 = 0)""",
    ]
    last, v = "c0", 1
    for half in (0, 1):
        if half:
            v += 1
            parts.append(f"a{v} AS (SELECT * FROM {last} UNION ALL SELECT arrival, part, n, b, {v}, arrival, part FROM s WHERE arrival % 2 = 1)")
            last = f"a{v}"
        for _ in range(3):
            v += 1
            parts += [
                f"t{v} AS (SELECT v, g, q, sum(b) AS b, (SELECT coalesce(min(k), 12) FROM range(12) r(k) WHERE sum(x.b) * (4 ** k) >= 134217728) AS tier FROM {last} x GROUP BY ALL)",
                f"u{v} AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY tier ORDER BY v, g, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 134217728 AS run FROM t{v})",
                f"w{v} AS (SELECT *, tier > 0 AND count(*) OVER w > 1 AND (count(*) OVER w >= 4 OR sum(b) OVER w >= 134217728) AS merges FROM u{v} WINDOW w AS (PARTITION BY tier, run))",
                f"c{v} AS (SELECT arrival, part, n, x.b, CASE WHEN merges THEN {v} ELSE x.v END AS v, CASE WHEN merges THEN tier ELSE x.g END AS g, CASE WHEN merges THEN run ELSE x.q END AS q FROM {last} x JOIN w{v} USING (v, g, q))",
            ]
            last = f"c{v}"
    parts.append(f"f AS (SELECT e.*, v, g, q, count(*) OVER z AS shard_rows, (sum(e.b) OVER z)::BIGINT AS shard_bytes, min(doc_id) OVER z AS shard_least FROM e JOIN {last} USING (arrival, part) WINDOW z AS (PARTITION BY v, g, q))")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, shard_rows, shard_bytes, shard_least FROM f"


OP1_SQL = _op1_sql()


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    mixed = mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.get("finish", F.lit(0)).alias("first_finish"), "shuffle")
    return mixed.orderBy(F.col("first_finish").asc_nulls_last(), "shuffle").drop("shuffle")  # the mix, each document at its first copy


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER q, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS remaining
  FROM w WINDOW q AS (ORDER BY (3 * source_size)::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (3 * source_size)::HUGEINT * remaining <= weight::HUGEINT * (total - before) AS sated FROM f),
l AS (SELECT (max(total) - coalesce(sum(3 * source_size) FILTER (WHERE sated), 0))::DOUBLE / sum(weight) FILTER (WHERE NOT sated) AS level FROM g),
t AS (SELECT source, source_size, rnk, CASE WHEN sated THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target, total FROM g, l),
r AS (SELECT d.*, source_size, rnk, target, total, sum(size) OVER (PARTITION BY rnk ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT r.*, e, CASE WHEN target > 0 THEN (source_size * e + run)::DOUBLE / target ELSE 0 END AS f FROM r, range(3) x(e)),
c AS (SELECT *, sum(size) OVER (ORDER BY f, rnk, h, doc_id::VARCHAR, e, size ROWS UNBOUNDED PRECEDING) AS total_to FROM i)
SELECT doc_id, size, source_size, target, sum(CASE WHEN total_to <= total THEN size ELSE 0 END)::BIGINT AS taken, min(CASE WHEN total_to <= total THEN f END) AS first_finish FROM c GROUP BY doc_id, h, size, source_size, target, run
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.fit(secrets.samples(docs, "text", "doc_id"))
    got = secrets.scan(docs.select("doc_id", "text"), model)
    got = got.select("doc_id", F.col("found.kinds").alias("k"), F.col("found.starts").alias("s"), F.col("found.ends").alias("e"))

    def count(kind: int):
        return F.size(F.filter("k", lambda x: x == kind)).cast("long")

    return got.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_list(F.col("k"), F.col("s"), F.col("e"), only_base=True), 256).alias("base_sha256"),
        secrets.span_list(F.col("k"), F.col("s"), F.col("e")).alias("spans"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM w, range(1, len(ws) - 1) r(i)),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM q, range(3) x(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'capitals', 'lines', 'repeats', 'length']) AS measure, unnest([n_symbols, n_capitals, n_dup_lines, n_repeat_words, word_chars]) AS part, unnest([1, 1, 1, 6, 0]) AS unit,
  unnest([coalesce(n_symbols * 1000 // nullif(n_words, 0), 0), coalesce(n_capitals * 1000 // nullif(n_letters, 0), 0), coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0), coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0), coalesce(word_chars * 1000 // nullif(n_words, 0), 0)])::BIGINT AS val FROM b),
k AS (SELECT *, CASE WHEN val < 1000 THEN val ELSE val - val % (10 ** (length(val::VARCHAR) - 3))::BIGINT END AS bucket FROM v),
own AS (SELECT lang, source, measure, count(*) AS docs, quantile_disc(bucket, [0.1, 0.5, 0.9]) AS q FROM k WHERE NOT base_failed GROUP BY ALL),
lng AS (SELECT lang, measure, count(*) AS docs, quantile_disc(bucket, [0.1, 0.5, 0.9]) AS q FROM k WHERE NOT base_failed GROUP BY ALL),
wh AS (SELECT measure, quantile_disc(bucket, [0.1, 0.5, 0.9]) AS q FROM k WHERE NOT base_failed GROUP BY ALL),
h AS (SELECT own.lang, own.source, own.measure, CASE WHEN own.docs >= 30 THEN own.q WHEN lng.docs >= 30 THEN lng.q ELSE wh.q END AS a, CASE WHEN lng.docs >= 30 THEN lng.q ELSE wh.q END AS z
  FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.measure = lng.measure JOIN wh ON own.measure = wh.measure),
f AS (SELECT lang, source, measure, greatest(a[3] + 3 * greatest(a[3] - a[2], 3), z[3] + 3 * greatest(z[3] - z[2], 3)) AS most, least(a[1] - 3 * greatest(a[2] - a[1], 3), z[1] - 3 * greatest(z[2] - z[1], 3)) AS least FROM h),
y AS (SELECT k.doc_id, bool_and(NOT base_failed AND coalesce((val <= most OR part <= unit) AND (k.measure <> 'length' OR val >= least), false)) AS kept
  FROM k LEFT JOIN f ON k.lang IS NOT DISTINCT FROM f.lang AND k.source IS NOT DISTINCT FROM f.source AND k.measure = f.measure GROUP BY k.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM b JOIN y USING (doc_id)
"""


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda x: x["k"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.PATTERNS)]
    return got.select("doc_id", *counts, F.sha2(pii.list_of(F.col("spans"), only_base=True), 256).alias("base_sha256"), pii.list_of(F.col("spans")).alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_source_mixing, op3_minhash_near_dedup, op4_secret_scans, op5_quality_rules, op6_document_fingerprints, op7_pii, op8_language_id, op9_url_filters, op10_packing)}
ORACLE_SQL = {"op1_sharding": OP1_SQL, "op2_source_mixing": OP2_SQL, "op5_quality_rules": OP5_SQL}
