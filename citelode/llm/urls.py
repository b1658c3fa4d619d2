"""URL filters: host and path rules first, then a ratio of character language models.

Two smoothed Markov models of variable order (contexts of none, one and two characters, each order backing off to
the one below) are counted over the URLs that a rule accepts and over those that a rule rejects. A URL's score is the
difference of its log-likelihoods under the two, divided by its length. The threshold is calibrated on URLs held out
from the counts: the score that best separates accepted from rejected ones, halfway between the nearest of either.
Characters fall into 40 classes, so the models are one dense table of 40 ** 3 numbers however many URLs there are: a
constant of 512 kB that every task has, so a URL is scored where it is read and nothing is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.llm.common import constant, spare_name

#: Character classes 1 to 37 (digits are one class); 0 is any other character, 39 the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-._/?=&#%:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, BASE = 39, 40
CELLS = BASE**3
BINS = 100  # of score a nat
FAR = 2000  # bins beyond which scores are alike


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where url is null or has no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty where url is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host/path). A rule fits its
    host and all subdomains where the path starts with the rule's; among rules alike in length the first wins."""
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    out = none
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def cells(url: Column) -> Column:
    """Table cell of each character after the two before it; the scheme does not count."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    plain = F.translate(rest, UPPER + "123456789", LOWER + "0" * 9)
    codes = F.transform(F.array_remove(F.split(plain, ""), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.array(F.lit(START), F.lit(START))
    padded = F.concat(start, codes)
    pairs = F.arrays_zip(F.slice(padded, 1, F.size(codes)).alias("a"), F.slice(padded, 2, F.size(codes)).alias("b"), codes.alias("c"))
    return F.transform(pairs, lambda p: (p["a"] * BASE + p["b"]) * BASE + p["c"])


def table_of(counts: DataFrame, weight: float = 4.0) -> DataFrame:
    """cell, ratio: log(p accepted / p rejected) for every cell. counts: cell, accepted, rejected."""
    spine = counts.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    c = spine.join(counts, "cell", "left").fillna(0, ["accepted", "rejected"])
    c = c.withColumns({"x": (F.col("cell") / (BASE * BASE)).cast("int"), "y": (F.col("cell") / BASE).cast("int") % BASE, "z": F.col("cell") % BASE})
    by_z = c.groupBy("z").agg(*[F.sum(n).alias(n + "0") for n in ("accepted", "rejected")])
    by_yz = c.groupBy("y", "z").agg(*[F.sum(n).alias(n + "1") for n in ("accepted", "rejected")])
    all_z = Window.partitionBy(F.lit(0))
    p0 = by_z.select("z", *[((F.col(n + "0") + 0.5) / (F.sum(n + "0").over(all_z) + 0.5 * BASE)).alias(n + "0") for n in ("accepted", "rejected")])
    y = Window.partitionBy("y")
    p1 = by_yz.join(F.broadcast(p0), "z").select("y", "z", *[((F.col(n + "1") + weight * F.col(n + "0")) / (F.sum(n + "1").over(y) + weight)).alias(n + "1") for n in ("accepted", "rejected")])
    xy = Window.partitionBy("x", "y")
    p2 = c.join(F.broadcast(p1), ["y", "z"]).select("cell", *[F.log((F.col(n) + weight * F.col(n + "1")) / (F.sum(n).over(xy) + weight)).alias(n) for n in ("accepted", "rejected")])
    return p2.select("cell", (F.col("accepted") - F.col("rejected")).alias("ratio"))


def score(url: Column, model: Column) -> Column:
    """Mean ratio of the URL's characters; 0 for a null or empty one. model: ratios by cell."""
    one = F.array(cells(url))
    total = F.transform(one, lambda cs: F.aggregate(cs, F.lit(0.0), lambda a, c: a + F.get(model, c)) / F.greatest(F.size(cs), F.lit(1)))
    return F.get(total, 0)


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", accept: str = "allow", reject: str = "block", fold: int = 4) -> DataFrame:
    """All rows and columns of pages with host, path, rule, score and verdict: the rule's, else the models'.

    One of fold URLs, by hash, calibrates; the others are counted. A null or empty URL scores 0. Without accepted or
    without rejected URLs there is nothing to compare and what no rule decides is accepted. Repeated rows count as often
    as they occur and stay. Where pages has a column of one of the new names, the new one gets an underscore at its end."""
    u = F.col(url)
    names = {n: spare_name(pages, n) for n in ("host", "path", "rule", "score", "verdict")}
    found = spare_name([*pages.columns, *names.values()], "_rule")
    rows = pages.withColumns({names["host"]: host(u), names["path"]: path(u)})
    rows = rows.withColumn(found, matched(F.col(names["host"]), F.col(names["path"]), rules))
    known = rows.where(F.col(found)["rule"].isNotNull()).select(u.alias("u"), (F.col(found)["verdict"] == accept).alias("ok"), (F.crc32(u.cast("binary")) % fold == 0).alias("held"))
    counts = known.where(~F.col("held")).select("ok", F.explode(cells(F.col("u"))).alias("cell")).groupBy("cell").agg(F.count(F.when(F.col("ok"), 1)).alias("accepted"), F.count(F.when(~F.col("ok"), 1)).alias("rejected"))
    model = constant(table_of(counts).orderBy("cell").select("ratio"))  # CELLS numbers

    def bin_of(s: Column) -> Column:
        return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(s * BINS))).cast("int")

    held = known.where(F.col("held") & (F.length("u") > 0)).select("ok", bin_of(score(F.col("u"), model)).alias("bin"))
    bins = held.groupBy("bin").agg(F.count(F.when(F.col("ok"), 1)).alias("a"), F.count(F.when(~F.col("ok"), 1)).alias("r")).orderBy("bin").collect()  # 2 * FAR + 1 rows at most
    good, bad = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    cut, best, a, r, last = -FAR - 1, 0.0, 0, 0, -FAR - 1
    for b in bins if good and bad else []:  # below the cut: rejected; the cut is halfway between the scores it parts
        if r / bad - a / good > best:
            cut, best = (last + b["bin"] + 1) // 2, r / bad - a / good
        a, r, last = a + b["a"], r + b["r"], b["bin"]
    if good and bad and 1 - a / good > best:
        cut = FAR + 1
    rows = rows.withColumn(names["score"], score(u, model))
    by_model = F.when(bin_of(F.col(names["score"])) < cut, F.lit(reject)).otherwise(F.lit(accept))
    return rows.withColumns({names["rule"]: F.col(found)["rule"], names["verdict"]: F.coalesce(F.col(found)["verdict"], by_model)}).drop(found)
