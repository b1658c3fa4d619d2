"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two second-order Markov chains over ASCII characters are trained from labelled samples, one on secrets (label 1)
and one on ordinary identifiers (label 0). A long token is a secret where the log-likelihood ratio of the chains,
per character, reaches a threshold. Statistics of a sample of bounded size are summed by Spark; the frozen tables
have 98 ** 3 cells at most, so what executors get does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import by_value, plain, small_batches, tidy

by_value(__name__)

#: Kinds in the order in which spans at the same start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
CUES = ("passw", "secret", "token", "api")
STEP = 1 << 20
THRESHOLD = 1.0  # bits a character
SYMBOLS = 98  # printable ASCII, one for everything else, one for the start


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _cells(tokens: list[str]) -> np.ndarray:
    """Table cells of all characters of the tokens, each after two start symbols."""
    a = np.frombuffer("".join(["\n\n" + t.replace("\n", "\0") for t in tokens]).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = a == 10
    a -= 31
    a[(a < 1) | (a > 95)] = 96
    a[start] = 97
    return ((a[:-2] * SYMBOLS + a[1:-1]) * SYMBOLS + a[2:])[~start[2:]]


def _samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled tokens of texts: values of the fixed patterns, and plain words alone and joined as identifiers are."""
    for b in batches:
        tokens, labels = [], []
        for t in b["text"]:
            if not t:
                continue
            for m in re.finditer(ASSIGN, t):
                if m.end(1) - m.start(1) >= 6:
                    tokens.append(m[1])
                    labels.append(1)
            for p in (ACCESS, HEX):
                for m in re.finditer(p, t):
                    tokens.append(m[0])
                    labels.append(1)
            ordinary = re.findall(r"\b[A-Za-z]{2,}\b", t)
            for i in range(0, len(ordinary) - 3, 4):
                w = ordinary[i : i + 4]
                tokens += ["_".join(w).lower(), "".join(x.capitalize() for x in w), "-".join(w[:3]).lower() + str(i % 100), "/".join(w)]
                labels += [0, 0, 0, 0]
        yield pd.DataFrame({"token": plain(tokens), "label": np.array(labels, np.int64)})


def _random(n: int) -> list[str]:
    """Labelled random strings over the usual alphabets, the same on every run."""
    import random

    r = random.Random(11)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    sets = [upper + lower + digit, upper + lower + digit + "+/", upper + lower + digit + "_-", digit + "abcdef", upper + digit, lower + digit]
    return ["".join(r.choices(sets[i % len(sets)], k=r.randint(20, 64))) for i in range(n)]


def samples(docs: DataFrame, text: str, key: str, sample_docs: int = 500, random_strings: int = 4000) -> DataFrame:
    """Labelled tokens (token, label) from about sample_docs documents, chosen by hash, and from a fixed generator."""
    n = docs.count()
    bound = min(STEP, STEP * sample_docs // max(n, 1) + 1)
    some = docs.where(F.pmod(F.xxhash64(F.lit(23), F.col(key)), F.lit(STEP)) < bound).select(F.col(text).alias("text"))
    made = docs.sparkSession.createDataFrame([(t, 1) for t in _random(random_strings)], "token string, label int")
    return some.mapInPandas(_samples, "token string, label int").unionByName(made)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for label, tokens in b.groupby("label")["token"]:
            cells, n = np.unique(_cells(list(tokens)), return_counts=True)
            yield pd.DataFrame({"label": int(label), "cell": cells, "n": n.astype(np.int64)})


def fit(labelled: DataFrame) -> np.ndarray:
    """Log-likelihood ratio in bits of each character after each two, from (token, label) rows; empty tokens and
    other labels do not count. Backs off to one character and to none by interpolation."""
    rows = labelled.where((F.length("token") > 0) & F.col("label").isin(0, 1)).select("token", "label")
    counts = rows.mapInPandas(_count, "label int, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()
    logs = []
    for label in (0, 1):
        c = np.zeros(SYMBOLS**3)
        own = counts[counts["label"] == label]
        c[own["cell"].to_numpy(np.int64)] = own["n"].to_numpy(float)
        c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        zero = (c.sum((0, 1)) + 0.5) / (c.sum() + 0.5 * SYMBOLS)
        one = (c.sum(0) + 8 * zero) / (c.sum(0).sum(-1, keepdims=True) + 8)
        logs.append(np.log2((c + 8 * one) / (c.sum(-1, keepdims=True) + 8)))
    return (logs[1] - logs[0]).reshape(-1).astype(np.float32)


def ratio(table: np.ndarray, token: str) -> float:
    """Bits per character by which the token looks random rather than ordinary; 0 for an empty token."""
    return float(table[_cells([token])].mean()) if token else 0.0


def all_spans(text: str, table: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Base spans, and tokens of 20 or more characters with a letter and a digit that the chains call random and
    that touch no base span."""
    out = base_spans(text)
    more, at, reach = [], 0, 0
    for m in re.finditer(TOKEN, text):
        while at < len(out) and out[at][0] < m.end():  # tokens and spans both go by their starts
            reach, at = max(reach, out[at][2]), at + 1
        t = m[0]
        if reach <= m.start() and any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and ratio(table, t) >= threshold:
            more.append((m.start(), 3, m.end()))
    return sorted(out + more)


def scan(df: DataFrame, table: np.ndarray, text: str = "text", threshold: float = THRESHOLD, as_column: str = "found") -> DataFrame:
    """df with a struct column: kinds, starts, ends (arrays of all spans by start, then kind), and the text with each
    span replaced by <SECRET>; overlapping spans are replaced as one. Null text: no spans, redacted stays null. Repeated
    rows stay; a column named as_column is replaced; an empty df gives no rows."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    small_batches(df.sparkSession, 256)
    kind = T.StructType([T.StructField("kinds", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("redacted", T.StringType())])

    @F.pandas_udf(kind)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [all_spans(t, shared.value, threshold) if t else [] for t in texts]
            yield pd.DataFrame({"kinds": plain([k for _, k, _ in s] for s in found), "starts": plain([a for a, _, _ in s] for s in found), "ends": plain([b for _, _, b in s] for s in found), "redacted": plain(redact(t, s) if s else None for t, s in zip(texts, found, strict=True))})
        tidy()

    return df.withColumn(as_column, udf(F.col(text)))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<SECRET>") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def span_list(kinds: Column, starts: Column, ends: Column, only_base: bool = False) -> Column:
    """kind:start:end, comma-joined, from the arrays of a scan."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.zip_with(kinds, F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda k, p: F.struct(k.alias("k"), F.concat_ws(":", F.get(names, k), p["s"].cast("string"), p["e"].cast("string")).alias("t")))
    if only_base:
        parts = F.filter(parts, lambda p: p["k"] < len(KINDS) - 1)
    return F.concat_ws(",", F.transform(parts, lambda p: p["t"]))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
