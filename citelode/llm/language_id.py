"""Language identification by prediction by partial matching (PPM).

One byte context tree per language, contexts of up to three bytes. Within a language the probability of a byte
after a context is count / (n + d) where it was seen (n: bytes seen after the context, d: different ones), else
the escape probability d / (n + d) times the probability after the context without its first byte; below the
empty context all 256 bytes are alike. A context the language never had costs no escape. Statistics are frozen
after fitting; a text goes to the language whose model gives the shortest code for its UTF-8 bytes.

The trees are fitted on a sample of the labelled rows: each label contributes about ``docs_per_label`` whole
documents, chosen by hash, and its own ``grams_per_label`` most frequent 4-grams, however many labels there are; both
are parameters. A label's model is sparse: only what it has seen is stored, so the models grow with the labels' own
4-grams, and a text's different 4-grams are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citelode.llm.common import by_value, plain, small_batches, spare_name, tidy

by_value(__name__)

UNKNOWN = "und"
ORDER = 3
STEP = 1 << 20
PAD = b"\n" * ORDER


@dataclass
class Model:
    """labels: languages by code point. trees: for each language and order, the contexts with the following byte that were
    seen (sorted), the code lengths of these, the contexts (sorted) and the code lengths of their escapes."""

    labels: list[str]
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(PAD + text, np.uint8).astype(np.uint32)
    return (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for label, texts in b.groupby("label")["text"]:
            parts = [_grams(t.encode("utf-8", "replace")) for t in texts if t]
            if parts:
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"label": label, "gram": g.astype(np.int64), "n": n.astype(np.int64)})


def fit(labelled: DataFrame, text: str, label: str, key: str, docs_per_label: int = 1500, grams_per_label: int = 50_000) -> Model:
    """Fits the trees on rows with a label. Rows with null text or label are passed over; an empty sample gives a
    model without languages, which answers ``und``. key only spreads the sample over the rows."""
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(STEP)).alias("spot")).where(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], [])
    limits = [(k, i, int(min(STEP, STEP * docs_per_label // sizes[k] + 1))) for i, k in enumerate(labels)]
    bounds = labelled.sparkSession.createDataFrame(limits, "label string, at int, bound int")
    sample = rows.join(F.broadcast(bounds), "label").where(F.col("spot") < F.col("bound")).select(F.col("at").alias("label"), "text")  # a row a label
    counts = sample.mapInPandas(_count, "label int, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    most = counts.withColumn("rank", rank).where(F.col("rank") <= grams_per_label).drop("rank").toPandas()
    own = dict(list(most.groupby("label")))
    return Model(labels, [_tree(own[i]["gram"].to_numpy(np.int64), own[i]["n"].to_numpy(np.float64)) if i in own else [] for i in range(len(labels))])


def _tree(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The orders of one language, from the empty context up. gram: four bytes each, the last follows the others."""
    tree = []
    for k in range(ORDER + 1):
        seen, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(at, n)
        contexts, of, kinds = np.unique(seen >> 8, return_inverse=True, return_counts=True)
        total = np.bincount(of, c) + kinds
        tree.append((seen.astype(np.uint32), -np.log2(c / total[of]), contexts.astype(np.uint32), -np.log2(kinds / total)))
    return tree


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in sorted keys, and whether they are there."""
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def _bits(tree: list, grams: np.ndarray) -> np.ndarray:
    """Code length of the last byte of each 4-gram after the first three."""
    out, left = np.zeros(len(grams)), np.arange(len(grams))
    for k in range(len(tree) - 1, -1, -1):
        seen, code, contexts, escape = tree[k]
        g = grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)
        i, there = _at(seen, g)
        out[left[there]] += code[i[there]]
        left, g = left[~there], g[~there]
        i, there = _at(contexts, g >> np.uint32(8))
        out[left[there]] += escape[i[there]]
    out[left] += 8
    return out


def code_lengths(trees: list, texts: list[bytes], chunk: int = 1 << 18) -> np.ndarray:
    """Bits of each text under each language's tree, a row per text; whole texts, in slices of bounded size."""
    out = np.zeros((len(texts), len(trees)))
    todo, size = [], 0

    def flush() -> None:
        if todo:
            raw = np.frombuffer(b"".join(t for _, t in todo), np.uint8).astype(np.uint32)
            grams, at = np.unique((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:], return_inverse=True)
            ends = np.cumsum([len(t) for _, t in todo])
            starts = np.concatenate([[0], ends[:-1]])
            keep = np.ones(len(at), bool)
            for e in ends[:-1]:  # contexts that span two texts
                keep[e - 3 : e] = False
            of = [i for i, _ in todo]
            for j, tree in enumerate(trees):
                np.add.at(out[:, j], of, np.add.reduceat(np.where(keep, _bits(tree, grams)[at], 0), starts))
            todo.clear()

    for i, t in enumerate(texts):
        for at in range(0, len(t), chunk):
            part = (PAD + t[:chunk]) if at == 0 else t[at - ORDER : at + chunk]
            todo.append((i, part))
            size += len(part)
            if size >= chunk:
                flush()
                size = 0
    flush()
    return out


def predict(text: Column, model: Model, spark) -> Column:
    """Struct of lang_pred and score for a text column. ``und`` with score 0 where the text is null or has no letter,
    or where no language was learned. Ties go to the first label by code point. score: the language's share of
    2 ** -(code length) over all languages."""
    shared = spark.sparkContext.broadcast((list(model.labels), model.trees))  # plain lists and arrays: executors need no copy of this package
    small_batches(spark, 256)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, trees = shared.value
        labels = np.array(names, object)
        for texts in batches:
            raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
            if len(labels) == 0:
                yield pd.DataFrame({"lang_pred": plain([UNKNOWN] * len(raw)), "score": np.zeros(len(raw))})
                continue
            bits = code_lengths(trees, raw)
            best = bits.argmin(1)
            with np.errstate(over="ignore", under="ignore"):
                score = 1 / np.exp2(-(bits - bits.min(1, keepdims=True))).sum(1)
            yield pd.DataFrame({"lang_pred": plain(labels[best]), "score": score})
        tidy()

    found = udf(text)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.struct(F.when(letters, found["lang_pred"]).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(letters, found["score"]).otherwise(F.lit(0.0)).alias("score"))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """True where crc32 of the key as text leaves the fold; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", **bounds) -> DataFrame:
    """All rows and columns of df, with held_out, lang_pred and score; fitted on the labelled rows that are not held out.
    Where df has a column of one of these names, the new one gets an underscore at its end (see result_names). Repeated
    rows are rows of their own; an empty df gives no rows."""
    names = result_names(df)
    found = spare_name([*df.columns, *names.values()], "_ppm")
    model = fit(df.where(~held_out(F.col(key))), text, label, key, **bounds)
    got = df.withColumns({names["held_out"]: held_out(F.col(key)), found: predict(F.col(text), model, df.sparkSession)})
    return got.withColumns({names[n]: F.col(found)[n] for n in ("lang_pred", "score")}).drop(found)


def result_names(df: DataFrame) -> dict[str, str]:
    """Names that identify gives its three columns."""
    return {n: spare_name(df, n) for n in ("held_out", "lang_pred", "score")}
