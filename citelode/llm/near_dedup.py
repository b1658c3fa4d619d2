"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of hashed five-word shingles. Equal sets are one class, represented once. Each class has 64 minwise
tokens. A tree branches the classes by the token at a chosen coordinate; a node with more classes than a limit branches
again, by two coordinates of the level's own nine that its path chooses. Small nodes are compared exhaustively.
Independent trees repeat this: a pair at similarity 0.85 stays together in one tree with probability 0.82 or more, so
ten trees miss it with probability below 1e-7. Nodes are compared by 8-bit sketches of the tokens (down to five standard
deviations below the bound), and each link is confirmed on the full sets.

A node that keeps most of what was above it holds classes that are alike, and branching does not part them: a dense node.
There every class is compared with a pivot, another one in every node, and those that the links so far leave outside
the node's main component meet all of the node, set against set in blocks: no link that joins two components
is lost, and no group is expanded into all pairs. Nodes large at full depth are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import batches_of, by_value, materialize, plain, text_hash, tidy
from citelode.llm.components import components

by_value(__name__)

TOKENS = 64
TREES = 10
DEPTH = 7
SLOTS = 9  # coordinates of each level below the roots
LIMIT = 24
DENSE = 0.6
BLOCK = 2 << 20
SALTS = 16  # shares of a node's rows, where rows are matched with what is known of their node
PIVOTS = 1
SHINGLE = 5
NO_KEY = -(2**63)
LEAST_SKETCH = 0.63


class _Words(dict):
    """64-bit hashes of words, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, cache: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the shingles: A-Z lower-cased, words split at ASCII white space; the whole sequence
    if there are fewer words; none without words."""
    ws = text.encode("utf-8", "replace").lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    k = min(size, len(ws))
    out = np.full(len(ws) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(ws) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(5))
    return r.integers(0, 2**32, TOKENS, np.uint32)[:, None], (r.integers(0, 2**31, TOKENS, np.uint32) * 2 + 1).astype(np.uint32)[:, None]


def minwise(s: np.ndarray, family: tuple[np.ndarray, np.ndarray], slab: int = 1 << 13) -> np.ndarray:
    out, x = np.full(TOKENS, 2**32 - 1, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), slab):
        out = np.minimum(out, ((x[None, at : at + slab] ^ family[0]) * family[1]).min(1))
    return out


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text_hash, n_shingles, cls (128 bits of the set; null for an empty one), tokens (array<int>)."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        cache, family = _Words(), _family()
        for b in batches:
            rows = []
            for t in b["t"]:
                s = shingles(t, cache)
                rows.append((len(s), xxhash.xxh128_hexdigest(s.tobytes()) if len(s) else None, minwise(s, family).view(np.int32) if len(s) else None))
            yield pd.DataFrame({"k": b["k"].astype(object).where(b["k"].notna(), None), "h": b["h"], "n": [r[0] for r in rows], "cls": plain(r[1] for r in rows), "tokens": plain(r[2] for r in rows)})
        del cache
        tidy()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), text_hash(F.col(text)).alias("h"))
    got = rows.mapInPandas(run, f"k {key_type}, h long, n long, cls string, tokens array<int>")
    return got.select(F.coalesce(F.col("k").cast("long"), F.lit(NO_KEY)).alias("key"), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"), "cls", "tokens")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of each small node that sizes and sketches allow."""
    for b in batches:
        left, right = [], []
        for ids, ns, sk in zip(b["ids"], b["ns"], b["sketches"], strict=True):
            ids, ns = np.asarray(ids, np.int64), np.asarray(ns, np.int64)
            m = np.frombuffer(b"".join(sk), np.uint8).reshape(len(ids), TOKENS)
            i, j = np.triu_indices(len(ids), 1)
            ok = 100 * np.minimum(ns[i], ns[j]) >= 85 * np.maximum(ns[i], ns[j])
            i, j = i[ok], j[ok]
            ok = (m[i] == m[j]).mean(1) >= LEAST_SKETCH
            left.append(ids[i[ok]])
            right.append(ids[j[ok]])
        yield _pairs(np.concatenate(left), np.concatenate(right)) if left else _pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, b, x, y: sketches) that are alike enough."""
    for b in batches:
        x = np.frombuffer(b"".join(b["x"]), np.uint8).reshape(len(b), TOKENS)
        y = np.frombuffer(b"".join(b["y"]), np.uint8).reshape(len(b), TOKENS)
        ok = (x == y).mean(1) >= LEAST_SKETCH
        yield _pairs(b["a"].to_numpy()[ok], b["b"].to_numpy()[ok])


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = []
        for x, y in zip(b["x"], b["y"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, big = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(big, small)
            both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
            ok.append(100 * both >= 85 * (len(x) + len(y) - both))
        yield b.loc[ok, ["a", "b"]]
    tidy()


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id and the set's bytes for the wanted classes (key, id, cls), from the texts of the rows that have the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        cache = _Words()
        for b in batches:
            sets = [shingles(t, cache).tobytes() for t in b["t"]]
            own = [xxhash.xxh128_hexdigest(s) == c for s, c in zip(sets, b["cls"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "s": plain(sets)})[own]
        del cache
        tidy()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("t"))
    return materialize(rows.join(wanted, "key").select("id", "cls", "t").mapInPandas(run, "id long, s binary").dropDuplicates(["id"]), "sets", "lz4")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) from small nodes and pivots, and the members (path, id) of dense nodes.
    classes: id, n, sketch, tokens."""
    small_parts, dense_parts = [], []
    root = F.posexplode(F.slice("tokens", 1, TREES)).alias("t", "v")
    step = classes.select("id", root).select(F.xxhash64("t", "v").alias("path"), "id", F.lit(2**62).alias("above"))
    for depth in range(1, DEPTH + 1):
        sizes = step.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.max("above").alias("above")).where("size > 1")
        alive = materialize(_of_node(step.select("path", "id"), sizes), "nodes")
        is_dense = (F.col("size") >= DENSE * F.col("above")) | F.lit(depth == DEPTH)
        small_parts.append(alive.where(F.col("size") <= LIMIT).select("path", "id"))
        dense_parts.append(alive.where((F.col("size") > LIMIT) & is_dense).select("path", "id"))
        onward = alive.where((F.col("size") > LIMIT) & ~is_dense)
        if depth == DEPTH or onward.isEmpty():
            break
        first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(SLOTS))
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(SLOTS - 1)), F.lit(SLOTS))
        at = TREES + SLOTS * (depth - 1)
        pick = F.explode(F.array(*[F.struct(c.alias("j"), F.get("tokens", (c + at).cast("int")).alias("v")) for c in (first, second)]))
        step = onward.join(classes.select("id", "tokens"), "id").select("path", "id", F.col("size").alias("above"), pick.alias("c"))
        step = step.select(F.xxhash64("path", "c.j", "c.v").alias("path"), "id", "above")
    small, dense = small_parts[0], dense_parts[0]
    for p in small_parts[1:]:
        small = small.unionByName(p)
    for p in dense_parts[1:]:
        dense = dense.unionByName(p)
    wide = small.join(classes.select("id", "n", "sketch"), "id")
    nodes = wide.groupBy("path").agg(F.collect_list(F.struct("id", "n", "sketch")).alias("m")).select(F.col("m.id").alias("ids"), F.col("m.n").alias("ns"), F.col("m.sketch").alias("sketches"))
    pairs = nodes.mapInPandas(_compare, "a long, b long")
    dense = materialize(dense, "dense-nodes")
    tops = dense.groupBy("path").agg(*[F.min_by("id", F.xxhash64("path", "id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = tops.select("path", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p"))
    stars = _of_node(dense, pivots).where("id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    return pairs.unionByName(_sketched(stars, classes)).distinct(), dense


def _of_node(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (path, id, ...) with what nodes knows of their path, one row a path. A node's rows are dealt by shares of their
    ids, so a large node is not one task's."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    every = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["path", "salt"]).drop("salt")


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    c = classes.select("id", "n", "sketch")
    x = c.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    y = c.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 85
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "x", "y").mapInPandas(_alike, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInPandas(_confirm, "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    ra = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    j = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return j.where(F.coalesce("ra", F.col("a")) != F.coalesce("rb", F.col("b"))).select("a", "b")


def _resolve(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Roots after confirming pairs: first one pair for each class, then those that are left between components; pairs
    that links already join need no confirmation."""
    for phase in range(2):
        pick = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if phase == 0 else pairs
        links = _links(pick, sets)
        if phase:
            links = links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = components(links)
        if phase == 0:
            pairs = materialize(_apart(pairs.join(pick, ["a", "b"], "left_anti"), roots), "pairs")
            if pairs.isEmpty():
                break
    return roots


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each class of the left block, a link to one class of each component in the right block that it has a link to.
    All sets of the block are one sorted list of shingles, so a class meets the whole block at once."""
    for b in batches:
        out = []
        for xi, xr, xs, yi, yr, ys in zip(b["xi"], b["xr"], b["xs"], b["yi"], b["yr"], b["ys"], strict=True):
            sets = [np.frombuffer(y, np.uint64) for y in ys]
            sizes = np.array([len(y) for y in sets])
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            yi, yr = np.asarray(yi, np.int64), np.asarray(yr, np.int64)
            for i, r, x in zip(xi, xr, xs, strict=True):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                linked = np.flatnonzero((100 * both >= 85 * (len(x) + sizes - both)) & (yr != r))
                if len(linked):
                    _, first = np.unique(yr[linked], return_index=True)
                    out += [(int(i), int(yi[k])) for k in linked[first]]
        yield pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)
    tidy()


def _rest(dense: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Roots after the classes outside the main component of each dense node have met all of the node, set against set.

    Both sides go in blocks of about BLOCK bytes, and a block pair gives links between components only."""
    spark = dense.sparkSession
    named = dense.join(roots, "id", "left").join(classes.select("id", "n"), "id").select("path", "id", "n", F.coalesce("root", F.col("id")).alias("root"))
    named = materialize(named, "named")
    parts = named.groupBy("path", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    most = parts.groupBy("path").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all_n"), F.max_by("n", F.struct("c", "root")).alias("main_n"))
    open_nodes = most.where("roots > 1").select("path", "main", F.ceil(F.col("all_n") * 8 / BLOCK).alias("right"), F.ceil((F.col("all_n") - F.col("main_n")) * 8 / BLOCK).alias("left"))
    rows = _of_node(named, open_nodes).join(sets, "id")

    def blocks(df: DataFrame, side: str, name: str) -> DataFrame:
        m = F.collect_list(F.struct("id", "root", "s")).alias("m")
        grouped = df.groupBy("path", F.pmod(F.xxhash64("id"), F.col(side)).alias(f"{name}b")).agg(m)
        return grouped.select("path", f"{name}b", F.col("m.id").alias(f"{name}i"), F.col("m.root").alias(f"{name}r"), F.col("m.s").alias(f"{name}s"))

    # a pair of blocks is a row of its own key, so that a node's pairs go to many tasks
    meet = open_nodes.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)).alias("xb"), F.col("right")).select("path", "xb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("right") - 1)).alias("yb"))
    pairs = meet.join(blocks(rows.where("root <> main"), "left", "x"), ["path", "xb"]).join(blocks(rows, "right", "y"), ["path", "yb"])
    with batches_of(spark, 4):
        links = materialize(pairs.mapInPandas(_across, "a long, b long"), "rest-links")
    if links.isEmpty():
        return roots
    return components(links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept and text_hash of every row.

    Rows are linked where 100 * common shingles >= 85 * shingles of either. component_id: the least key reachable.
    Null, empty and blank texts have no shingles and no links, and are kept. Rows with one key and different texts are
    linked by their texts alone. The key is a whole number; a null key stands below all others and stays null. Extra
    columns, whatever their names, are ignored. An empty docs gives no rows."""
    if docs.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{key} must be a whole number")
    with batches_of(docs.sparkSession, 256):
        return _near_duplicates(docs, key, text)


def _near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = materialize(signatures(docs, key, text), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    low = F.transform("tokens", lambda t: F.substring(F.hex(t.cast("long").bitwiseAND(255) + 256), 2, 2))
    classes = materialize(classes.select("cls", "key", F.xxhash64("cls").alias("id"), "n", "tokens", F.unhex(F.array_join(low, "")).alias("sketch")), "classes")
    pairs, final = candidates(classes)
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(final.select("id")).distinct()
    sets = _sets(docs, key, text, classes.join(ids, "id", "left_semi").select("key", "id", "cls"))
    roots = _resolve(pairs, sets)
    if not final.isEmpty():
        roots = _rest(final, roots, classes, sets)
    rooted = classes.select("cls", "key", "id").join(roots, "id", "left").select("cls", "key", F.coalesce("root", F.col("id")).alias("root"))
    least = rooted.groupBy("root").agg(F.min("key").alias("component"))
    by_class = rooted.join(least, "root").select("cls", "component")
    out = rows.select("key", "n_shingles", "cls", "text_hash").join(by_class, "cls", "left").withColumn("component", F.coalesce("component", F.col("key")))
    key_type = docs.schema[key].dataType

    def back(c):
        return F.when(c == NO_KEY, F.lit(None)).otherwise(c).cast(key_type)

    return out.select(back(F.col("key")).alias(key), F.col("n_shingles").cast("long").alias("n_shingles"), back(F.col("component")).alias("component_id"), (F.col("key") == F.col("component")).alias("kept"), "text_hash")
