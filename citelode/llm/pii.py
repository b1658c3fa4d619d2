"""Personal data: fixed patterns, and bootstrapped contextual extraction.

The fixed patterns give spans of e-mail addresses, IP addresses, payment cards and phone numbers. They are the seeds.
A pattern is the word before an identifier-like word (a digit and six or more characters), the word after it, or both,
lower-cased and with every run of digits a 9; an instance is the word's own text. Occurrences make a graph of patterns and
instances. It is scored
in rounds until no pattern joins the good ones: a pattern scores the share of its different instances that are known
(their score), held back by a prior against patterns with few instances; an instance scores the best of its good
patterns, seeds one. Instances of good patterns become spans of kind ``context`` if a seed anywhere has their shape
(runs of digits and runs of letters as one sign each), whatever its context.

Everything is DataFrame functions. Positions come from splitting a text at the pattern: gaps and matches alternate, so
running sums of their lengths are the starts and ends, in code points. The patterns give no way to backtrack over long
texts; where a match can start is told by what stands before, so every text is read once per pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import materialize, text_hash

#: Kinds in the order in which spans at the same start are listed.
KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = "A-Za-z0-9._%+-"
#: The patterns, written so that each start is tried once: a start inside a run that failed at its start fails too.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


BLOCK = 256


def found(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, l, r): start, end and text of all matches, leftmost first, none overlapping, and the text
    between the match and its neighbours. Places are summed block by block, so the work is linear in the matches."""
    ms = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.array(F.struct(ms.alias("ms"), F.split(text, pattern, -1).alias("gs")))
    kind = "array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>"

    def place(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["l"])
        e = s + F.length(p["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m"), p["l"].alias("l"), p["r"].alias("r")))).alias("out"))

    def block(acc: Column, pairs: Column) -> Column:
        inner = F.aggregate(pairs, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), place)
        whole = F.array(inner)
        return F.get(F.transform(whole, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 0)

    def spans(x: Column) -> Column:
        n = F.size(x["ms"])
        pairs = F.arrays_zip(x["ms"].alias("m"), F.slice(x["gs"], 1, n).alias("l"), F.slice(x["gs"], 2, n).alias("r"))
        blocks = F.transform(F.array(pairs), lambda ps: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(ps, b * BLOCK + 1, BLOCK)))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        placed = F.aggregate(F.get(blocks, 0), start, block, lambda a: F.flatten(a["out"]))
        return F.when(n > 0, placed).otherwise(F.array().cast(kind))

    return F.get(F.transform(both, spans), 0)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check: from the right, every second is doubled, its digits added."""
    ds = F.transform(F.array_remove(F.split(F.reverse(number), ""), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))))
    return F.aggregate(ds, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"))
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, m) of the fixed patterns by start, then kind. Null text: empty."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>")
    def of(k: int, kind: str, pattern: str) -> Column:
        every = found(t, pattern)
        if SIGNS[kind]:
            every = F.when(F.contains(t, F.lit(SIGNS[kind])), every).otherwise(none)
        good = F.filter(every, lambda x: valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    parts = [of(k, kind, pattern) for k, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*parts))


#: Words of six or more characters with a digit; what else a word must have is checked after.
LIKE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]{6,}+"
NOTHING = "\n"  # no word has it
ENDS = r"""[.,;:!?"'()\[\]{}<>|]"""


def contexts(text: Column, base: Column) -> Column:
    """Array of (s, e, m, p, f, seed) of identifier-like words: place and text without outer punctuation, patterns, shape,
    and whether a base span touches the word. Patterns: the word before, the word after, both, in lower case and with 9 for
    every run of digits; a neighbour that is identifier-like itself, or missing, makes none."""
    t = F.coalesce(text, F.lit(""))

    def near(gap: Column, last: bool) -> Column:
        flat = F.translate(gap, "\t\n\x0b\f\r", "     ")
        word = F.substring_index(F.rtrim(flat), " ", -1) if last else F.substring_index(F.ltrim(flat), " ", 1)
        return F.when(F.trim(flat) == "", F.lit(NOTHING)).otherwise(F.regexp_replace(F.lower(word), "[0-9]+", "9"))

    def one(x: Column) -> Column:
        left = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], f"^{ENDS}+", ""))
        core = F.regexp_replace(x["m"], f"^{ENDS}+|{ENDS}+$", "")
        shape = F.regexp_replace(F.regexp_replace(core, "[0-9]+", "9"), "[A-Za-z]+", "a")
        s = x["s"] + left
        e = s + F.length(core)
        seed = F.exists(base, lambda b: (b["s"] < e) & (s < b["e"]))
        before, after = near(x["l"], True), near(x["r"], False)
        patterns = F.filter(F.array(F.concat(before, F.lit(" _")), F.concat(F.lit("_ "), after), F.concat(before, F.lit(" _ "), after)), lambda p: ~p.contains(NOTHING))
        return F.struct(s.alias("s"), e.alias("e"), core.alias("m"), patterns.alias("p"), shape.alias("f"), seed.alias("seed"))

    return F.filter(F.transform(found(t, LIKE), one), lambda x: F.length(x["m"]) >= 6)


def confident(edges: DataFrame, rounds: int | None = None, least: float = 0.8, prior: float = 2.0, support: int = 3) -> DataFrame:
    """p: patterns at or above the threshold. edges: different (p, m, seed).

    A pattern's score is the sum of its instances' scores over their number plus the prior; patterns with fewer
    instances than the support, or fewer seeds than two, score 0. An instance scores the best of its patterns at or above
    the threshold. Rounds go on until no pattern is added: scores only rise, so a pattern stays and the rounds end."""
    first = edges.groupBy("m").agg(F.max(F.col("seed").cast("double")).alias("score"))
    nodes, held, k = first, -1, 0
    while True:
        scored = edges.select("p", "m").join(nodes, "m").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("t"), F.sum(F.when(F.col("score") == 1, 1).otherwise(0)).alias("sure"))
        scored = scored.where((F.col("n") >= support) & (F.col("sure") >= 2)).select("p", (F.col("t") / (F.col("n") + prior)).alias("ps"))
        good = materialize(scored.where(F.col("ps") >= least), f"pii-patterns-{k}")
        now, k = good.count(), k + 1
        if now in (0, held) or k == rounds:
            return good.select("p")
        held = now
        best = edges.select("p", "m").join(good, "p").groupBy("m").agg(F.max("ps").alias("best"))
        nodes = materialize(first.join(best, "m", "left").select("m", F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score")), f"pii-instances-{k}")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """key, text_hash and spans, an array of (s, k, e) by start, then kind, of every row.

    Null texts have no spans. Rows alike in key and text have the same spans. A null key stays null. Extra columns,
    whatever their names, are ignored. An empty docs gives no rows."""
    rows = docs.select(F.col(key).alias("key"), text_hash(F.col(text)).alias("h"), F.col(text).alias("t"))
    rows = rows.select("*", base_spans(F.col("t")).alias("base"))
    rows = rows.select("key", "h", F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("base"), contexts(F.col("t"), F.col("base")).alias("c"))
    rows = materialize(rows, "pii-spans")
    seen = rows.where(F.size("c") > 0).select("key", "h", F.explode("c").alias("c")).select("key", "h", "c.*")
    edges = materialize(seen.select(F.explode("p").alias("p"), "m", "seed").groupBy("p", "m").agg(F.max("seed").alias("seed")), "pii-edges")
    good = confident(edges, **limits)
    shapes = seen.where("seed").select("f").distinct()
    fresh = seen.where(~F.col("seed")).withColumn("p", F.explode("p")).join(good, "p").join(shapes, "f", "left_semi").select("key", "h", F.struct("s", F.lit(len(PATTERNS)).alias("k"), "e").alias("x"))
    more = fresh.groupBy("key", "h").agg(F.collect_set("x").alias("more")).select(F.col("key").alias("_k"), F.col("h").alias("_h"), "more")
    joined = rows.join(more, rows["key"].eqNullSafe(more["_k"]) & (rows["h"] == more["_h"]), "left")
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    return joined.select(F.col("key").alias(key), F.col("h").alias("text_hash"), F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def list_of(spans: Column, only_base: bool = False) -> Column:
    """kind:start:end, comma-joined, of (s, k, e) structs."""
    kept = F.filter(spans, lambda x: x["k"] < len(KINDS) - 1) if only_base else spans
    return F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), x["s"].cast("string"), x["e"].cast("string"))))
