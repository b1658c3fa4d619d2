"""Quality rules with adaptive thresholds.

Every document gets whole-number measures, in thousandths: symbols a word, capitals among its letters as given by
A-Z and a-z, repeated lines among lines, words in repeated three-word windows among words, characters a word. For
each language and source a quantile sketch counts the measures in buckets of three significant digits (log-linear,
so a quantile is within 1 %); sketches merge by adding counts, and a language and source with few documents uses its
language's sketch, or the whole corpus's.

A measure's upper fence is its 90 % quantile + 3 times the distance from the median to it; characters a word also have
a lower fence, the 10 % quantile - 3 times its distance to the median. The distance counts as three thousandths at
least, which is the sketch's resolution. A document must be beyond the fences of its language and source and of its
language as a whole, and by more than one unit of what is counted (a symbol, a capital, a line, a window twice: six
words), since a single one can't tell a short text from a bad one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citelode.llm.common import SPACES, materialize, spare_name, squeezed, words

#: Fixed value: symbols that are counted.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = CAPITALS.lower()
FEW = 30
WIDTH = 3
LEAST = 3
UNIT = {"symbols": 1, "capitals": 1, "lines": 1, "repeats": 6, "length": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")
RESULT = (*COUNTS[:5], "base_failed", "kept")


def repeated_words(ws: str, windows: str, n: str) -> Column:
    """Words in a window that is found twice or more. windows: 64-bit hashes of the three-word windows in order.
    A window's hash and place share one number, so a sort of numbers brings windows together that may be equal; those
    are then compared word by word."""
    room = f"cast(floor(4611686018427387904 / {n}) as bigint)"
    alike = f"""flatten(transform(array(sort_array(transform({windows}, (h, i) -> pmod(h, {room}) * {n} + i))), s ->
          transform(filter(transform(s, (x, i) -> struct(x, get(s, i - 1) as a, get(s, i + 1) as b)),
            t -> coalesce(t.x div {n} = t.a div {n}, false) OR coalesce(t.x div {n} = t.b div {n}, false)), t -> cast(t.x % {n} as int))))"""
    return F.expr(
        f"""CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
        cast(size(array_distinct(flatten(flatten(transform(array(sort_array(transform({alike}, p -> struct(concat_ws(' ', slice({ws}, p + 1, 3)) as g, p as p)))), s ->
          transform(filter(transform(s, (x, i) -> struct(x, get(s, i - 1).g as a, get(s, i + 1).g as b)),
            t -> coalesce(t.x.g = t.a, false) OR coalesce(t.x.g = t.b, false)), t -> array(t.x.p, t.x.p + 1, t.x.p + 2))))))) as bigint) END"""
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with a struct column ``_m`` (or a spare name, see spare_name) of COUNTS. A null text has
    none of anything."""
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    own = spare_name(docs, "_m")
    keep = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    df = docs.select(keep.alias("_row"), t.alias("_t"), words(F.col(text)).alias("_w"), lines.alias("_l"))
    windows = F.expr("CASE WHEN size(_w) < 3 THEN cast(array() as array<bigint>) ELSE transform(slice(_w, 1, size(_w) - 2), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))) END")
    df = df.select("*", F.size("_w").cast("long").alias("_n"), windows.alias("_g"))
    tight = F.length(squeezed(F.col("_t")))

    def count(chars: str) -> Column:
        return (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")

    counts = F.struct(
        F.col("_n").alias("n_words"),
        tight.cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words("_w", "_g", "_n").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(CAPITALS).alias("n_capitals"),
        count(CAPITALS + SMALL).alias("n_letters"),
    )
    return df.select(*[F.col("_row")[c].alias(c) for c in rest], counts.alias(own))


MEASURES = {"symbols": ("n_symbols", "n_words"), "capitals": ("n_capitals", "n_letters"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "length": ("word_chars", "n_words")}


def thousandths(m: Column, part: str, whole: str) -> Column:
    return F.when(m[whole] > 0, F.floor(m[part] * 1000 / F.greatest(m[whole], F.lit(1)))).otherwise(F.lit(0)).cast("long")


def bucket(v: Column) -> Column:
    """v to three significant digits, rounded down."""
    step = F.pow(F.lit(10), F.length(v.cast("string")) - 3).cast("long")
    return F.when(v < 1000, v).otherwise(v - v % step)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by lang, source, measure and bucket; base failures do not count. rows: lang, source, base_failed and v, a
    struct of the measures."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col("v")[m]).alias("bucket")) for m in MEASURES]))
    return rows.where("NOT base_failed").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, docs and the buckets at 10, 50 and 90 % (q10, q50, q90) of a sketch or merged sketches. The totals go
    by the thousands of the buckets first, so that no group is one sorted run."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("bucket") / 100))
    by = [*keys, "measure"]
    parts = merged.groupBy(*by, "part").agg(F.sum("n").alias("pn"))
    whole = Window.partitionBy(*by)
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in (*by, "part")], (F.sum("pn").over(whole.orderBy("part")) - F.col("pn")).alias("before"), F.sum("pn").over(whole).alias("docs"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in keys else F.col(c) == F.col(f"_{c}") for c in (*by, "part")]
    within = F.sum("n").over(Window.partitionBy(*by, "part").orderBy("bucket"))
    rows = merged.join(parts, same).select(*by, "part", "bucket", "n", "before", "docs").withColumn("to", F.col("before") + within)
    return rows.groupBy(*by).agg(F.max("docs").alias("docs"), *[F.min(F.when(F.col("to") * 100 >= F.col("docs") * q, F.col("bucket"))).alias(f"q{q}") for q in (10, 50, 90)])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and a column <measure>_most for each measure, with length_least."""
    names = ("docs", "q10", "q50", "q90")
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), *[F.col(c).alias(f"l_{c}") for c in names])
    whole = quantiles(sketch, []).select("measure", *[F.col(c).alias(f"w_{c}") for c in names])
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure"))).drop("_lang", "_measure").join(F.broadcast(whole), "measure")  # five rows

    def fences(q: dict[str, Column]) -> tuple[Column, Column]:
        up, down = F.greatest(q["q90"] - q["q50"], F.lit(LEAST)), F.greatest(q["q50"] - q["q10"], F.lit(LEAST))
        return q["q90"] + WIDTH * up, q["q10"] - WIDTH * down

    wide = {c: F.when(F.col("l_docs") >= FEW, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}")) for c in names}
    near = {c: F.when(F.col("docs") >= FEW, F.col(c)).otherwise(wide[c]) for c in names}
    (near_most, near_least), (wide_most, wide_least) = fences(near), fences(wide)
    both = both.select("lang", "source", "measure", F.greatest(near_most, wide_most).alias("most"), F.least(near_least, wide_least).alias("least"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("most"))).alias(f"{m}_most") for m in MEASURES], F.max(F.when(F.col("measure") == "length", F.col("least"))).alias("length_least"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """All rows of docs without the text, with RESULT: the counts, base_failed and kept.

    Fixed rule: base_failed with fewer than least_words words, or more than most_repeats % of them in repeated windows.
    Null languages and sources are groups of their own. A group all of whose documents fail the base keeps none. Repeated
    rows count as often as they occur and stay. Where docs has a column of one of the new names, the new one gets an
    underscore at its end. An empty docs gives no rows."""
    rows = measure(docs, text)
    own = rows.columns[-1]
    rest = rows.columns[:-1]
    m = F.col(own)
    failed = (m["n_words"] < least_words) | (m["n_repeat_words"] * 100 > m["n_words"] * most_repeats)
    # columns of the caller travel in a struct, so that no name can clash
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    rows = rows.select(packed, F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), m.alias("m"), failed.alias("base_failed"), F.struct(*[thousandths(m, *p).alias(k) for k, p in MEASURES.items()]).alias("v"))
    rows = materialize(rows, "quality-measures")
    limits = materialize(thresholds(sketches(rows)), "quality-thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    good = F.col("v.length") >= F.col("length_least")
    for k, (part, _) in MEASURES.items():
        good = good & ((F.col(f"v.{k}") <= F.col(f"{k}_most")) | (F.col(f"m.{part}") <= UNIT[k]))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = {c: F.col(f"m.{c}") for c in RESULT[:5]} | {"base_failed": F.col("base_failed"), "kept": ~F.col("base_failed") & F.coalesce(good, F.lit(False))}
    return joined.select(*[F.col("row")[c].alias(c) for c in rest], *[c.alias(spare_name(rest, k)) for k, c in out.items()])
