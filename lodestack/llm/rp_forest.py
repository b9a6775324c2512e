"""Embedding near-dedup: a forest of random-projection trees with spill overlap, compared within leaves.

Each tree splits the unit vectors again and again by random directions at the middle of what falls on them; vectors
near the middle go both ways (spill). The upper levels are fitted on a bounded sample of at most `fit_rows` vectors and
FIT_NUMBERS components of each dimension, as deep as its sample carries (a dimension with few sampled vectors, or none,
has one leaf for each tree), and every vector is routed through them; a leaf that holds more than `leaf` vectors of one label is split further, by
directions drawn from a hash of its path and middles averaged over all its vectors, until none does or its spread is
near the link radius: a split would cut true links there. Within a leaf every two vectors of equal label are compared in
double precision; a leaf of more than `BLOCK` vectors by pairs of blocks, each a group of its own. A pair is counted in
the first leaf that holds both, so leaves send counts and the edges of a spanning forest, never all pairs of a group.

Large groups of near copies are looked for in the sample. All vectors within the link radius of a group's centre leave
the trees and are compared with every vector within twice that radius, which holds all that can link with them.

Vectors that are equal in label and components (told by a 64-bit hash of both) are one class: a class is compared once
and its members counted.
Vectors that are null, zero, or hold null or non-finite components, or whose label is null, link with nothing. A null
vec_id takes part and is never the smallest id while another is there. Rows that repeat a vec_id are vectors of their
own. Vectors of unequal lengths never link. The sample bounds what is fitted, not what is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, table
from .jaccard import components

TREES, FIT_ROWS, DEPTH, LEAF, SPILL = 8, 50_000, 6, 600, 0.16
#: Components of the sample that reach the driver, for each dimension; 64 MB of them.
FIT_NUMBERS = 8_000_000
#: Sampled vectors that a leaf of a fitted tree should have.
FIT_LEAF = 30
#: Leaves above this many vectors are compared by pairs of blocks of about this size.
BLOCK = 1_000
#: Sampled vectors whose surroundings are counted to find large groups.
CANDIDATES = 512


def fit_tree(x: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, middles and half widths of the spill of a full tree over unit vectors; node i has 2i+1 and 2i+2."""
    rng = np.random.default_rng(seed)
    n = (1 << depth) - 1
    d = rng.normal(size=(n, x.shape[1]))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    mid, half = np.zeros(n), np.zeros(n)
    rows = {0: np.arange(len(x))}
    for i in range(n):
        at = rows.pop(i, np.zeros(0, dtype=int))
        if len(at):
            p = x[at] @ d[i]
            mid[i] = np.median(p)
            half[i] = np.quantile(np.abs(p - mid[i]), SPILL)
            rows[2 * i + 1], rows[2 * i + 2] = at[p <= mid[i]], at[p > mid[i]]
    return d, mid, half


def route(x: np.ndarray, tree) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a row reaches."""
    d, mid, half = tree
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for _ in range(int(np.log2(len(mid) + 1))):
        p = np.einsum("ij,ij->i", x[row], d[node]) - mid[node]
        left, right = p <= half[node], p >= -half[node]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def heavy(x: np.ndarray, label: np.ndarray, cosine: float, least: int, seed: int) -> list[tuple[int, np.ndarray]]:
    """(label, centre) of groups with at least `least` sampled unit vectors within the link radius of one of them."""
    out: list[tuple[int, np.ndarray]] = []
    for i in np.random.default_rng(seed).permutation(len(x))[:CANDIDATES]:
        if any(k == label[i] and x[i] @ c >= 2 * cosine**2 - 1 for k, c in out):
            continue
        same = np.flatnonzero(label == label[i])
        near = same[x[same] @ x[i] >= cosine]
        centre = x[near].sum(axis=0)
        if len(near) >= least and np.linalg.norm(centre) > 0:
            out.append((int(label[i]), centre / np.linalg.norm(centre)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, cls, label, v: cls tells vectors that are equal in label and components; null where none can link."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0)
    key = F.when(fine, F.xxhash64("label", F.transform("embedding", lambda c: c + 0)))
    return vectors.select("vec_id", key.alias("cls"), "label", F.when(fine, F.col("embedding")).alias("v"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, fit_rows: int = FIT_ROWS, seed: int = 3) -> DataFrame:
    """vec_id, rp_links (other vectors linked directly), rp_component (smallest vec_id reachable) for every row."""
    spark = vectors.sparkSession
    rows = cut(classes(vectors), "vectors")
    one = cut(rows.where(F.col("cls").isNotNull()).groupBy("cls", "label").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("members")).withColumn("dim", F.size("v")), "vector-classes")
    # Few dimensions, most often one; each is sampled by its own share.
    forest, balls = {}, {}
    for dim, total in sorted((r["dim"], r["count"]) for r in one.groupBy("dim").count().collect()):
        most = min(fit_rows, max(1, FIT_NUMBERS // dim))
        share = min(1.0, most / total)
        picked = one.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(seed), "cls"), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
        sample = picked.orderBy("cls").limit(2 * most).select("v", F.col("label").cast("long").alias("label")).toArrow().combine_chunks()
        x = _matrix(sample["v"].combine_chunks()) if sample.num_rows else np.zeros((0, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        deep = min(depth, max(0, int(np.log2(max(1, len(x)) / FIT_LEAF))))
        forest[dim] = [fit_tree(x, deep, seed * 1000 + t) for t in range(trees)]
        balls[dim] = heavy(x, sample["label"].to_numpy(), cosine, max(20, int(leaf * share) + 1), seed)
    shared = spark.sparkContext.broadcast((forest, balls))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            label = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(2).take(pa.array(at)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                trees_of, balls_of = shared.value[0][int(dim)], shared.value[1][int(dim)]
                alone = np.ones(len(at), dtype=bool)
                for g, (k, centre) in enumerate(balls_of):
                    p = np.where(label[at] == k, x @ centre, -2.0)
                    alone &= p < cosine
                    # Twice the radius, a hair wider than rounding needs.
                    yield placing(batch, at[p >= 2 * cosine**2 - 1 - 1e-6], -1 - g, f"{dim}.near")
                at, x = at[alone], x[alone]
                for t, tree in enumerate(trees_of):
                    row, node = route(x, tree)
                    yield placing(batch, at[row], t, [f"{dim}.{n}" for n in node])

    def placing(batch: pa.RecordBatch, at: np.ndarray, tree: int, node: str | list[str]) -> pa.RecordBatch:
        part, n = batch.take(pa.array(at)), len(at)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(n, tree, np.int32)), pa.array([node] * n if isinstance(node, str) else node, pa.string()), part.column(2)], names=["cls", "label", "tree", "node", "v"])

    kind = one.schema["v"].dataType.simpleString()
    placed = one.select("cls", F.col("label").cast("long").alias("label"), "v", "dim").mapInArrow(index, f"cls long, label long, tree int, node string, v {kind}")
    placed, level = cut(placed, "vector-leaves"), 0
    keys, done = ["label", "tree", "node"], None
    while True:
        sizes = placed.where(F.col("tree") >= 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        big = cut(sizes.where(F.col("n") > leaf), "vector-big")
        if level > 40 or big.isEmpty():
            break
        # Mean cosine of a leaf's pairs: from 1 - 4 * (1 - cosine) on, its spread is at most twice the link radius.
        sums = placed.join(few(big.select(*keys)), keys, "left_semi").select(*keys, "v").mapInArrow(_sums, "label long, tree int, node string, n long, s array<double>")
        big = cut(sums.groupBy(*keys).applyInPandas(_mean_cosine, "label long, tree int, node string, mean double").where(F.col("mean") < 1 - 4 * (1 - cosine)), "vector-big")
        if big.isEmpty():
            break

        # A direction for each large leaf is drawn from its path; its middle and spread are averages over its rows.
        def project(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.empty(batch.num_rows)
                for t, n, at, x in _by_leaf(batch, 2, 3, 4):
                    p[at] = x @ _direction(x.shape[1], seed, level, t, n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p"])

        large = placed.join(big.select(*keys), keys, "left_semi").select("cls", "label", "tree", "node", "v").mapInArrow(project, f"cls long, label long, tree int, node string, v {kind}, p double")
        large = cut(large, "vector-large")
        middle = large.groupBy(*keys).agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s"))
        off = F.col("p") - F.col("m")
        ways = F.array_compact(F.array(F.when(off <= 0.2 * F.col("s"), "L"), F.when((off >= -0.2 * F.col("s")) & (F.col("s") > 0), "R")))
        split = large.join(cut(middle, "vector-middle"), keys).select("cls", "label", "tree", "node", "v", F.explode(ways).alias("way")).withColumn("node", F.concat("node", "way")).drop("way")
        small = placed.join(big.select(*keys), keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        placed, level = cut(split, "vector-leaves"), level + 1
    leaves = placed if done is None else cut(done.unionByName(placed), "vector-leaves")
    # The leaves of each class, so that a leaf can tell whether an earlier one has counted a pair.
    leaves = leaves.withColumn("leaf", F.xxhash64("tree", "node"))
    own = cut(leaves.groupBy("cls").agg(F.collect_set("leaf").alias("leaves")).join(one.select("cls", "members"), "cls"), "vector-own")
    # Large leaves are compared by pairs of blocks: each row goes to as many groups as its leaf has blocks.
    wide = cut(leaves.groupBy("label", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "vector-wide")
    dealt = leaves.join(own, "cls").join(few(wide), ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cls", "label", "leaf", "v", "leaves", "members", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = dealt.groupBy("label", "leaf", "lo", "hi").applyInPandas(lambda g: _compare(g, cosine), "a long, b long, links long")
    found = cut(found, "vector-links")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    comps = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "cls")
    info = one.select("cls", "members").join(counts, "cls", "left").join(comps, "cls", "left")
    info = cut(info.select("cls", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), F.coalesce("comp", "cls").alias("comp")), "vector-info")
    got = cut(rows.select("vec_id", "cls").join(info, "cls", "left"), "vector-got")
    least = cut(got.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("vec_id").alias("least")), "vector-least")
    return got.join(least, "comp", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("rp_links"), F.coalesce("least", "vec_id").alias("rp_component"))


def _by_leaf(batch: pa.RecordBatch, tree: int, node: int, v: int) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(tree, node, rows, matrix) of each leaf in a batch; the arguments are places of columns."""
    places = pd.DataFrame({"t": batch.column(tree).to_numpy(), "n": batch.column(node).to_pylist()})
    for (t, n), at in places.groupby(["t", "n"]).indices.items():
        yield int(t), n, at, _matrix(batch.column(v).take(pa.array(at)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by label and leaf, over what a task reads."""
    held: dict[tuple, list] = {}
    for batch in batches:
        label = batch.column(0).to_numpy()
        for t, n, at, x in _by_leaf(batch, 1, 2, 3):
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for k in np.unique(label[at]):
                mine = x[label[at] == k]
                one = held.setdefault((int(k), t, n), [0, 0.0])
                one[0], one[1] = one[0] + len(mine), one[1] + mine.sum(axis=0)
    if held:
        k, t, n = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(t, pa.int32()), pa.array(n, pa.string()), pa.array([c for c, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], names=["label", "tree", "node", "n", "s"])


def _mean_cosine(g: pd.DataFrame) -> pd.DataFrame:
    mean = np.sum([np.asarray(s) for s in g["s"]], axis=0) / g["n"].sum()
    return g[["label", "tree", "node"]].head(1).assign(mean=float(mean @ mean))


def _direction(dim: int, seed: int, level: int, tree: int, node: str) -> np.ndarray:
    return np.random.default_rng([seed, level, tree, *node.encode()]).normal(size=dim) / np.sqrt(dim)


def _met_before(link: np.ndarray, leaves: list, here: int) -> np.ndarray:
    """Which linked pairs have an earlier common leaf, where they are counted."""
    before = [[f for f in v if f < here] for v in leaves]
    some = np.array([k for k, v in enumerate(before) if v], dtype=int)
    out = np.zeros_like(link)
    if len(some) < 2 or not link[np.ix_(some, some)].any():
        return out
    i, j = np.nonzero(np.triu(link[np.ix_(some, some)], 1))
    if len(i) <= 20_000:
        sets = [frozenset(before[k]) for k in some]
        met = np.fromiter((not sets[a].isdisjoint(sets[b]) for a, b in zip(i, j, strict=True)), dtype=bool, count=len(i))
        out[some[i[met]], some[j[met]]] = True
        return out | out.T
    code, of = np.unique(np.concatenate([before[k] for k in some]), return_inverse=True)
    row = np.repeat(np.arange(len(some)), [len(before[k]) for k in some])
    has = np.zeros((len(some), len(code)), dtype=np.float32)
    has[row, of] = 1
    has = has[:, has.sum(axis=0) > 1]
    out[np.ix_(some, some)] = has @ has.T > 0
    return out


def _compare(g: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of a leaf or of two of its blocks: how many vectors each class links with here first, and edges that connect them."""
    g = g.drop_duplicates("cls")
    cls, members, block, n = g["cls"].to_numpy(), g["members"].to_numpy(), g["block"].to_numpy(), len(g)
    x = np.stack([np.asarray(v, dtype=np.float64) for v in g["v"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
    link = np.zeros((n, n), dtype=bool)
    if lo == hi:
        link = np.triu(x @ x.T >= cosine, 1)
    else:
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        link[np.ix_(a, b)] = x[a] @ x[b].T >= cosine
    link |= link.T
    link &= ~_met_before(link, list(g["leaves"]), int(g["leaf"].iloc[0]))
    links = link @ members
    edges, todo = [], links > 0
    for start in np.flatnonzero(links):
        if not todo[start]:
            continue
        todo[start], queue = False, [start]
        while queue:
            k = queue.pop()
            new = np.flatnonzero(link[k] & todo)
            todo[new] = False
            edges.extend((cls[k], cls[m]) for m in new)
            queue.extend(new)
    some = np.flatnonzero(links)
    counted = pd.DataFrame({"a": cls[some], "b": pd.array([pd.NA] * len(some), dtype="Int64"), "links": links[some].astype("int64")})
    joined = pd.DataFrame({"a": [a for a, _ in edges], "b": pd.array([b for _, b in edges], dtype="Int64"), "links": 0})
    return pd.concat([counted, joined.astype({"a": "int64", "links": "int64"})], ignore_index=True)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", F.col("rp_links").alias("n_links"), F.col("rp_component").alias("component_id"), (F.col("vec_id") == F.col("rp_component")).alias("kept"))


SQL: dict[str, str] = {}
QUERIES = {"op4_vector_dedup": op4_vector_dedup}
