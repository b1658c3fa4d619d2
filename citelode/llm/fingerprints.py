"""Document fingerprints by I-Match with randomised lexicons.

Terms are lower-cased words, as 64-bit hashes. The lexicon is a band of inverse document frequency: terms in at most
one of ``most`` documents and at least one of ``least`` (three documents at least), whatever the corpus's size. Of each
document the sorted, different lexicon terms are kept. The lexicon is cut at random into disjoint subsets,
32 * 2 ** level of them, of which the first 32 count; a document's level is the least at which it has no more than one
term a subset on average. The fingerprint is the hash of the terms in each of the 32 subsets, at the document's level
and the next, so that documents of different length still have a level in common. Besides, each of 8 randomised lexicons
keeps three quarters of the band, and the hash of all of a document's terms in it is part of the fingerprint, so every
lexicon term takes part. A document without lexicon terms is fingerprinted by all its terms.

Likeness of two fingerprints: the share of equal hashes among the randomised lexicons, and among the subsets at the
higher of their levels, where either has a term; 0 where levels are further apart than one; for documents without
lexicon terms, 1 if equal, else 0.

Texts move once. Documents are dealt by ranges of their keys, cut at quantiles; within a range, a window in descending
order brings each text its next one. The first document of a range also goes, as a guest, to the end of the range before,
so no range waits for another. A lexicon of no more than ``shared`` terms (a parameter) is a hash table that every task
has, and terms are looked up where the text is; a larger one is joined by a shuffle of terms. Fingerprints are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.llm.common import constant, materialize, text_hash, words

SUBSETS = 32
LEXICONS = 8
RANGES = 8192  # of keys, at most
RANGE_ROWS = 1024  # documents a range while there are fewer ranges
NO_KEY = -(2**63)


def term_hashes(text: Column) -> Column:
    """Different hashes of a text's words."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str, least: int = 20_000, most: int = 50) -> DataFrame:
    """term: all of the band."""
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.where((F.col("df") >= max(3, n // least)) & (F.col("df") <= max(3, n // most)))
    return materialize(band.select("term"), "lexicon")


def subset_hashes(terms: Column, level: Column) -> Column:
    """32 hashes of the sorted terms in each subset at a level; 0 for a subset without terms."""
    subsets = F.pow(F.lit(2), level).cast("long") * SUBSETS
    kept = F.filter(F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(F.lit(9), t), subsets).alias("b"), t.alias("t"))), lambda p: p["b"] < SUBSETS)

    def one(k: Column, own: Column) -> Column:
        mine = F.filter(own, lambda p: p["b"] == k)
        return F.when(F.size(mine) == 0, F.lit(0)).otherwise(F.hash(F.transform(mine, lambda p: p["t"])))

    # the outer transform names the kept terms once, so that they are not made anew for each subset
    return F.get(F.transform(F.array(kept), lambda own: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: one(k, own))), 0)


def lexicon_hashes(terms: Column) -> Column:
    """8 hashes of all sorted terms in each randomised lexicon; 0 for a lexicon without terms. A term is left out of a
    lexicon where the two bits of its hash for this lexicon are 0, and is in all where it would be in none."""
    bits = (1 << 2 * LEXICONS) - 1
    marked = F.transform(terms, lambda t: F.struct(F.xxhash64(F.lit(11), t).bitwiseAND(bits).alias("b"), t.alias("t")))

    def one(k: int, own: Column) -> Column:
        mine = F.filter(own, lambda p: (p["b"].bitwiseAND(3 << 2 * k) != 0) | (p["b"] == 0))
        return F.when(F.size(mine) == 0, F.lit(0)).otherwise(F.hash(F.transform(mine, lambda p: p["t"])))

    return F.get(F.transform(F.array(marked), lambda own: F.array(*[one(k, own) for k in range(LEXICONS)])), 0)


def fingerprint(terms: Column, all_terms: Column) -> Column:
    """Struct level, now, next, whole (hash arrays); level -1 with one hash of all terms where no lexicon term is there.
    terms: sorted lexicon terms."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.size(terms) / SUBSETS)).cast("int"))
    none = F.array(F.hash(all_terms))
    return F.when(F.size(terms) > 0, F.struct(level.alias("level"), subset_hashes(terms, level).alias("now"), subset_hashes(terms, level + 1).alias("next"), lexicon_hashes(terms).alias("whole"))).otherwise(F.struct(F.lit(-1).alias("level"), none.alias("now"), none.alias("next"), F.array().cast("array<int>").alias("whole")))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprint structs, 0 to 1."""
    x = F.when(a["level"] >= b["level"], a["now"]).otherwise(a["next"])
    y = F.when(b["level"] >= a["level"], b["now"]).otherwise(b["next"])
    x, y = F.concat(x, a["whole"]), F.concat(y, b["whole"])
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    apart = (F.abs(a["level"] - b["level"]) > 1) | (F.least(a["level"], b["level"]) < 0) & (a["level"] != b["level"])
    return F.when(apart, F.lit(0.0)).when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same / F.size(pairs))


def as_text(f: Column) -> Column:
    def digits(hashes: Column) -> Column:
        return F.array_join(F.transform(hashes, lambda h: F.when(h == 0, F.lit("-")).otherwise(F.hex(h.cast("long").bitwiseAND(4294967295)))), ".")

    return F.concat_ws("/", f["level"].cast("string"), digits(f["now"]), digits(f["next"]), digits(f["whole"]))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below the key, by binary search."""
    if not cuts:
        return F.lit(0)
    every, steps = F.array(*[F.lit(c).cast("long") for c in cuts]), len(cuts).bit_length()

    def half(at: Column, _: Column) -> Column:
        mid = ((at["lo"] + at["hi"]) / 2).cast("int")
        below = (at["lo"] < at["hi"]) & (F.get(every, mid) < key)
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(F.least(mid, at["hi"])).alias("hi"))

    return F.aggregate(F.array(*[F.lit(0)] * steps), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), half, lambda at: at["lo"])


def in_ranges(rows: DataFrame) -> DataFrame:
    """rows (key, h, t) with range and guest: each row once, and the first of each range in descending order of (key, h)
    once more in the range before it, where it is a guest and the last; the first of all follows the last."""
    n = rows.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = []
    if ranges > 1:
        got = rows.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
        cuts = sorted(set(got))
    own = rows.withColumns({"range": range_of(F.col("key"), cuts), "guest": F.lit(0)})
    tops = sorted(own.groupBy("range").agg(F.max(F.struct("key", "h")).alias("o")).collect(), key=lambda r: r["range"])  # a row a range
    hosts = [(r["o"]["key"], r["o"]["h"], tops[(i + 1) % len(tops)]["range"]) for i, r in enumerate(tops)]
    hosts = rows.sparkSession.createDataFrame(hosts, "key long, h long, range int")
    guests = rows.join(F.broadcast(hosts), ["key", "h"]).dropDuplicates(["range"]).withColumn("guest", F.lit(1))  # a row a range
    return own.select("key", "h", "t", "range", "guest").unionByName(guests.select("key", "h", "t", "range", "guest"))


def lookup(terms: DataFrame, n: int) -> Column:
    """The n lexicon terms as a constant: a power of two of buckets, by pmod; first where each bucket starts and where the
    last ends, then the terms by bucket."""
    size = 1 << max(1, n).bit_length()
    own = F.pmod("term", F.lit(size))
    starts = terms.sparkSession.range(size + 1).select(F.col("id").alias("b")).join(terms.groupBy((own + 1).alias("b")).agg(F.count(F.lit(1)).alias("c")), "b", "left")
    before = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("b")) + size + 1
    rows = starts.select("b", F.lit(0).alias("k"), before.alias("v")).unionByName(terms.select(own.alias("b"), F.lit(1).alias("k"), F.col("term").alias("v")))
    return constant(rows.orderBy("k", "b", "v").select("v"))


def in_lexicon(hashes: Column, table: Column, n: int) -> Column:
    """Sorted 32-bit hashes of the terms that the table of n terms has."""
    size = 1 << max(1, n).bit_length()

    def known(t: Column) -> Column:
        b = F.pmod(t, F.lit(size)).cast("int")
        first, end = F.get(table, b).cast("int"), F.get(table, b + 1).cast("int")
        return F.when(first < end, F.exists(F.sequence(first, end - 1), lambda i: F.get(table, i) == t)).otherwise(F.lit(False))

    return F.array_sort(F.array_distinct(F.transform(F.filter(hashes, known), lambda t: F.hash(t))))


def _by_shuffle(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (id, a, b: term hashes) with terms0 and terms1, as in_lexicon gives them, by a join on the term."""
    both = F.array_distinct(F.concat("a", "b"))
    each = rows.select("id", F.explode(F.transform(both, lambda x: F.struct(x.alias("term"), F.array_contains("a", x).alias("in0"), F.array_contains("b", x).alias("in1")))).alias("e")).select("id", "e.*")
    hit = each.join(terms.hint("shuffle_merge"), "term").groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col(f"in{v}"), F.hash("term")))).alias(f"terms{v}") for v in (0, 1)])
    none = F.array().cast("array<int>")
    return rows.join(hit, "id", "left").withColumns({f"terms{v}": F.coalesce(f"terms{v}", none) for v in (0, 1)})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shared: int = 2_000_000, **band) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text: the last third (floor of n_chars / 3) replaced by as much of the start of the next document by
    descending key, or all of it if shorter. Null texts count as empty. Rows with one key are documents of their own,
    ordered by a hash of the text, so the next of a repeated row is its copy. A null key comes last. An only document
    is its own next. Empty input gives no rows; other columns are ignored. The key is a whole number."""
    if docs.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{key} must be a whole number")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), text_hash(t).alias("h"), t.alias("t"))
    terms = lexicon(docs, text, **band)
    order = Window.partitionBy("range").orderBy("guest", F.col("key").desc(), F.col("h").desc())
    dealt = in_ranges(rows).withColumn("next_t", F.lead("t").over(order))
    dealt = dealt.select("key", "h", "range", "guest", "t", F.length("t").alias("n"), "next_t").withColumn("take", F.floor(F.col("n") / 3).cast("int"))
    edited = F.when(F.col("guest") == 1, F.col("t")).otherwise(F.concat(F.left("t", F.col("n") - F.col("take")), F.left(F.coalesce("next_t", F.lit("")), F.col("take"))))
    dealt = dealt.select("key", "h", "range", "guest", "n", "t", edited.alias("edited"))
    dealt = dealt.select("key", "h", "range", "guest", "n", F.sha2("edited", 256).alias("sha"), term_hashes(F.col("t")).alias("a"), term_hashes(F.col("edited")).alias("b"))
    mixed = {f"all{v}": F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)) for v, c in (("0", "a"), ("1", "b"))}
    n = terms.count()
    if n <= shared:
        table = lookup(terms, n)
        dealt = dealt.withColumns({"terms0": in_lexicon(F.col("a"), table, n), "terms1": in_lexicon(F.col("b"), table, n)} | mixed)
    else:
        dealt = _by_shuffle(materialize(dealt.withColumn("id", F.monotonically_increasing_id()), "term-hashes"), terms).withColumns(mixed)
    dealt = dealt.select("key", "h", "range", "guest", "n", "sha", "terms0", "terms1", "all0", "all1")
    dealt = dealt.select("key", "h", "range", "guest", "n", "sha", fingerprint(F.col("terms0"), F.col("all0")).alias("f"), fingerprint(F.col("terms1"), F.col("all1")).alias("g"))
    done = dealt.withColumn("o", F.lead("f").over(order)).where("guest = 0")
    key_type = docs.schema[key].dataType
    return done.select(
        F.when(F.col("key") == NO_KEY, F.lit(None)).otherwise(F.col("key")).cast(key_type).alias(key),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.coalesce("o", "f")).alias("near_next"),
    )
