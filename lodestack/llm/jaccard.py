"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

A document's set is its distinct shingles of `width` words (lower-cased A-Z, split at ASCII white space); shorter
documents have one shingle, their whole sequence; documents without words have none and link with nothing. Two
documents link when 100 * |A & B| >= percent * |A | B|.

Equal sets are one node. A sketch of how often shingles occur orders them rare first (the order decides how much work
there is, never what is found). Each node sends its prefix to the shingles' partitions; a shingle met once ends there.
Links are found in rounds: first each node of a shingle against the shingle's first node and the one before it, which
settles groups of copies in linear work; then, only for shingles whose nodes are still in different components, those
outside the largest one against its most central node, again and again while that saves much work; at last those still
outside against all the others. Every pair that may link is thus verified or already connected, so components are exact.
A pair that was compared is not compared again.

The suffix filter bounds how many shingles two sets do not share from 512 parities (of how many of a set's shingles
fall on each bit): before their first common shingle they share nothing, so the bound holds for what comes after it.

Null text is no words. A null doc_id takes part and is never the smallest id unless its component has no other; a
component of null ids only has component_id null. Rows that repeat a doc_id are documents of their own. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, WS, cut, few, forget, table

#: Counters of the sketch; its size is fixed, whatever the corpus.
SKETCH = 1 << 21
#: Shingles seen more often than this (by the sketch) are dealt to several partitions, this many rows to each.
HOT = 2_000
#: Comparisons of rows for each row of a shared shingle that are made without looking for centres first.
CHEAP = 1_000
#: Earlier shared shingles that a row carries into the comparison of all, so that pairs meet once.
EARLIER = 6
#: Bytes of files of the table of components, two numbers a row, up to which it is broadcast to the rows of shingles.
COMPONENTS = 16 << 20
#: Bytes of texts that are hashed at a time.
AT_ONCE = 1 << 18
#: Parities of a node's set, 64 to a column.
PARITY = [f"g{i}" for i in range(8)]

_rng = np.random.default_rng(1)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[np.frombuffer(UPPER.encode(), np.uint8)] = _BYTE[np.frombuffer(UPPER.lower().encode(), np.uint8)]
_BYTE[np.frombuffer(WS.encode(), np.uint8)] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end, and where each text's words begin; bounds: texts' offsets.

    A word's hash is a polynomial over its bytes' numbers, then spread; white space counts 0 and ends a word.
    """
    value = _BYTE[raw]
    start = value != 0
    start[1:] &= value[:-1] == 0
    inside = bounds[bounds < len(raw)]
    start[inside] = value[inside] != 0
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    value = value[at[0] :]
    length = np.diff(at, append=len(raw))
    power = np.full(int(length.max()), _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value *= power[np.arange(len(value)) - np.repeat(at - at[0], length)]
    return _mix(np.add.reduceat(value, at - at[0])), np.searchsorted(at, bounds)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, end to end, and the offsets of the texts' parts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body else np.empty(0, np.uint8)
    h, at = _words(raw, bounds - bounds[0])
    grams = np.full(max(0, len(h) - width + 1), width, dtype=np.uint64)
    for i in range(width):
        grams = _mix(grams * _STEP + h[i : i + len(grams)])
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width or a == b:
            s = grams[a : max(a, b - width + 1)]
        else:
            s = np.full(1, b - a, dtype=np.uint64)
            for word in h[a:b]:
                s = _mix(s * _STEP + word)
        s.sort()
        sets.append(s)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    ends = np.cumsum([0, *map(len, sets)])
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[ends[:-1][ends[:-1] < ends[1:]]] = True
    return flat[new], np.r_[0, np.cumsum(new)][ends]


def _id(s: np.ndarray) -> int:
    """A node's id: a hash of its set, as a signed number."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes()))))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about AT_ONCE bytes in all, or one longer text."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            yield batch.slice(a, b - a)
            a = b


def _new(flat: np.ndarray, at: np.ndarray, seen: set[int]) -> Iterator[tuple[int, int, int]]:
    """(node, begin, end) of each set that is not empty and whose node the task has not seen."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if a < b and (node := _id(flat[a:b])) not in seen:
            seen.add(node)
            yield node, a, b


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def parities(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each set: 8 signed 64-bit numbers, whose bits tell if an odd number of its shingles fall on them."""
    bits = 64 * len(PARITY)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    odd = np.bincount(of * bits + (_mix(flat ^ _STEP) >> np.uint64(55)).astype(np.int64), minlength=(len(at) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, len(PARITY))


BLOCK = 1 << 15


def nodes_and_sketch(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: (doc_id, node, n) of each document, with parities where a task first meets the node, and (block,
    counts) of each task's sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), *[(g, pa.int64()) for g in PARITY], ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts, seen, held, size = np.zeros(SKETCH, dtype=np.uint32), set(), [], 0
        for part in _slices(batches):
            flat, at = shingle_sets(part.column(1), width)
            n = np.diff(at)
            node = [_id(flat[a:b]) if a < b else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            again = np.ones(len(n), dtype=bool)
            for i, k in enumerate(node):
                if k is not None and k not in seen:
                    seen.add(k)
                    again[i] = False
                    held.append((flat[at[i] : at[i + 1]] & np.uint64(SKETCH - 1)).astype(np.int64))
                    size += int(n[i])
            odd = [pa.array(g, mask=again) for g in parities(flat, at).T.copy()]
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array(n), *odd, *none], schema=schema)
            if size > SKETCH:
                counts += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
        for at in range(0, SKETCH, BLOCK):
            if counts[at : at + BLOCK].any():
                yield _batch([(*[None] * (3 + len(PARITY)), at // BLOCK, _pack(counts[at : at + BLOCK]))], schema)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{f} long" for f in ("doc_id", "node", "n", *PARITY)) + ", block int, counts binary")


def _pack(counts: np.ndarray) -> bytes:
    """Where there are counts, and the counts, compressed."""
    at = np.flatnonzero(counts).astype(np.uint16)
    return zlib.compress(np.uint32(len(at)).tobytes() + np.diff(at, prepend=np.uint16(0)).tobytes() + counts[at].astype(np.uint32).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    out = np.zeros(BLOCK, dtype=np.uint32)
    out[np.cumsum(np.frombuffer(raw[4 : 4 + 2 * n], np.uint16), dtype=np.uint16).astype(np.int64)] = np.frombuffer(raw[4 + 2 * n :], np.uint32)
    return out


def sketch_of(parts: DataFrame) -> np.ndarray:
    """Sum the tasks' sketches: by block and a salt first, then by block; a fixed number of numbers reaches the driver."""

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = _unpack(raw)
                sums[b] = sums[b] + new if b in sums else new
        schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
        for b, c in sums.items():
            yield _batch([(b, _pack(c))], schema)

    df = parts.where(F.col("block").isNotNull()).select("block", "counts")
    df = df.mapInArrow(add, "block int, counts binary")  # what a task holds is at most one sketch
    df = df.repartition(16, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(SKETCH, dtype=np.uint32)
    for r in df.collect():  # at most SKETCH counters
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += _unpack(r["counts"])
    return out


def prefixes(docs: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """Rows (shingle, share, node, at): the prefix of each node, rare first.

    share: -1, or the share of a hot shingle's rows that this one belongs to. at: the size of the node's set times 2^32,
    plus the shingle's place in the node's order. A task sends a node once.
    """
    schema = pa.schema([("shingle", pa.int64()), ("share", pa.int32()), ("node", pa.int64()), ("at", pa.int64())])

    def run(batches):
        seen, counts = set(), sketch.value
        noise = int(counts.mean())
        for part in _slices(batches):
            flat, at = shingle_sets(part.column(0), width)
            often = counts[(flat & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64)
            # Rare first; shingles as frequent as each other by a hash, then by value: the same in all documents.
            key = (np.minimum(often, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (_mix(flat) >> np.uint64(20))
            picked, nodes, places = [], [], []
            for node, a, b in _new(flat, at, seen):
                n = b - a
                k = n - (percent * n + 99) // 100 + 1
                order = key[a:b].argsort()
                ranked = key[a:b][order]
                if (ranked[1:] == ranked[:-1]).any():
                    order = key[a:b].argsort(kind="stable")
                picked.append(a + order[:k])
                nodes.append((node, k))
                places.append((n << 32) + np.arange(k, dtype=np.int64))
            if picked:
                i = np.concatenate(picked)
                node = np.repeat(*np.array(nodes, dtype=np.int64).T)
                ways = np.where(often[i] > noise + HOT, (often[i] - noise) // HOT + 1, 0)
                share = np.where(ways > 0, (node >> 7) % np.maximum(ways, 1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(flat[i].view(np.int64)), pa.array(share), pa.array(node), pa.array(np.concatenate(places))], schema=schema)

    return docs.select("text").mapInArrow(run, "shingle long, share int, node long, at long")


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Length and positional filters for two nodes at the first shingle that both have; a, b: their columns `at`."""
    na, nb = F.shiftright(a, 32), F.shiftright(b, 32)
    left = lambda at, n: n - at.bitwiseAND(F.lit((1 << 32) - 1)) - 1
    need = 1 + F.least(left(a, na), left(b, nb))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * need >= percent * (na + nb))


def apart(a: str, b: str) -> Column:
    """At least so many shingles are in one only of the sets whose parities are the fields of a and b."""
    return sum((F.bit_count(F.col(f"{a}.{g}").bitwiseXOR(F.col(f"{b}.{g}"))) for g in PARITY[1:]), F.bit_count(F.col(f"{a}.g0").bitwiseXOR(F.col(f"{b}.g0"))))


def near_enough(a: str, b: str, percent: int) -> Column:
    """Suffix filter, with the length filter again: |A ^ B| is |A| + |B| - 2 |A & B|."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return ((100 + percent) * (na + nb - apart(a, b)) >= 2 * percent * (na + nb)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def both_ends(pairs: DataFrame) -> DataFrame:
    """(node): a and b of each pair."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def candidates(pairs: DataFrame, known: DataFrame, seen: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b), each once, that pass the suffix filter and are not among those seen. known: node, n, parities."""
    new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    if seen is not None:
        new = new.join(seen, ["a", "b"], "left_anti")
    # Pairs are written first: few of them leave what is known of all nodes where it is.
    new = cut(new, "jaccard-new")
    met = cut(known.join(few(both_ends(new)), "node", "left_semi"), "jaccard-ends")
    ends = few(met.select(F.col("node"), F.struct("n", *PARITY).alias("s")))
    both = new.join(ends.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    out = cut(both.where(near_enough("x", "y", percent)).select("a", "b"), "jaccard-pairs")
    forget(new, met)
    return out


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: compared over whole sets, which only candidates' texts are made into."""
    if pairs.isEmpty():
        return pairs
    ids = both_ends(pairs).distinct()
    reps = nodes.join(ids, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").where(F.col("doc_id").isNotNull())
    reps = cut(reps, "jaccard-ids")
    known = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(few(reps), "doc_id", "left_semi")
    lost = docs.select("doc_id", "text").where(F.col("doc_id").isNull())
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        seen: set[int] = set()
        for part in _slices(batches):
            flat, at = shingle_sets(part.column(0), width)
            if rows := [(node, flat[a:b].view(np.int64)) for node, a, b in _new(flat, at, seen)]:
                yield _batch(rows, schema)

    # One row has each candidate's id; where ids repeat or are null some links are told more often than once.
    sets_of = lambda df: df.select("text").mapInArrow(run, "node long, members array<long>")
    sets = cut(sets_of(known).unionByName(sets_of(lost).dropDuplicates(["node"])), "jaccard-sets")
    end = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"m{name}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    links = cut(both.where(100 * shared >= percent * (F.size("ma") + F.size("mb") - shared)).select("a", "b").distinct(), "jaccard-links")
    forget(reps, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of the links (a, b); comp is the least node it is connected with.

    Large and small stars in turn until nothing moves; each round is one job, written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges, before = cut(edges, "stars"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # A node has few smaller neighbours now: centres are at the other end.
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        moved = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        told = Observation()
        after = small.select("a", F.col("m").alias("b")).unionByName(moved).distinct()
        after = cut(after.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")), "stars")
        forget(edges)
        edges, now = after, (told.get["n"], told.get["h"])
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _unsettled(met: DataFrame, comps: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (shingle, share, node, at, comp, members, degree) of shingles with nodes of several components."""
    placed = met.select("shingle", "share", "node", "at").join(few(comps, COMPONENTS), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # The table is nearly in the order of shingles, so tasks have summed most of a shingle before anything moves.
    mixed = placed.groupBy("shingle").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") != F.col("c1")).select("shingle")
    rows = cut(placed.join(mixed, "shingle", "left_semi"), "jaccard-mixed")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    degrees = both_ends(links).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    told = rows.select("node", "comp").distinct().join(sizes, "comp", "left").join(degrees, "node", "left")
    return rows.join(told.select("node", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("degree", F.lit(0)).alias("degree")), "node")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, cheap: int = CHEAP) -> DataFrame:
    """doc_id, jc_shingles, jc_component (smallest doc_id reachable by links, itself included) for every row of docs.

    cheap: comparisons for each row of a shared shingle that are made without looking for centres first; it decides the
    work, not the result.
    """
    parts = cut(nodes_and_sketch(docs, width), "jaccard-nodes")
    nodes = parts.where(F.col("block").isNull()).select("doc_id", "node", "n")
    known = cut(parts.where(F.col("g0").isNotNull()).select("node", "n", *PARITY).dropDuplicates(["node"]), "jaccard-known")
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(parts))
    # Each shingle's first node is its pivot; hot shingles have one in each share of their rows.
    group = Window.partitionBy("shingle", "share").orderBy("node")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {"lo": F.first("node").over(group), "lo_at": F.first("at").over(group), "prev": F.lag("node").over(group), "prev_at": F.lag("at").over(group), "hi": F.last("node").over(whole), "held": F.count(F.lit(1)).over(whole)}
    met = prefixes(docs, sketch, width, percent).withColumns(near)
    met = met.where((F.col("lo") != F.col("hi")) | (F.col("share") >= 0)).where(F.col("prev").isNull() | (F.col("prev") != F.col("node")))
    met = cut(met.drop("hi"), "jaccard-met")
    sketch.destroy()
    fits = lambda a, b: may_link(F.col(a), F.col(b), percent)
    pair = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    shares = met.where((F.col("share") >= 0) & (F.col("node") == F.col("lo"))).select("shingle", "node", "at")
    tops = shares.groupBy("shingle").agg(F.min(F.struct("node", "at")).alias("top"))
    across = shares.join(tops, "shingle").where(fits("at", "top.at"))
    first = pair(met.where(fits("at", "lo_at")), "node", "lo").unionByName(pair(met.where(fits("at", "prev_at")), "node", "prev")).unionByName(pair(across, "node", "top.node"))
    seen = candidates(first, known, None, percent)
    links = verify(docs, nodes, seen, width, percent)
    comps, tried, last, work, size = cut(components(links), "jaccard-comps"), None, False, float("inf"), met.count()
    # Of three nodes or fewer every two have met by now: each was held against the first and the one before.
    table_of_met, met = met, met.where((F.col("held") > 3) | (F.col("share") >= 0))
    while not last:
        rows = _unsettled(met, comps, links)
        if tried is not None:
            rows = rows.join(few(tried), "node", "left").withColumn("degree", F.when(F.col("tried"), F.lit(-1)).otherwise(F.col("degree"))).drop("tried")
        rows = cut(rows, "jaccard-rows")
        forget(table_of_met)
        table_of_met = met = rows  # components only grow: a shingle whose nodes are in one is done with
        if rows.isEmpty():
            break
        # The most central node, not tried before, of a shingle's largest component; those outside it meet it.
        counted = rows.groupBy("shingle", "comp").agg(F.max(F.struct("members", "comp", "degree", "node", "at")).alias("main"), F.max("share").alias("shares"), F.count(F.lit(1)).alias("rows"))
        counted = counted.select("shingle", F.struct("main.*", "rows").alias("main"), "shares", "rows")
        main = counted.groupBy("shingle").agg(F.max("main").alias("main"), F.max("shares").alias("shares"), F.sum("rows").alias("rows")).withColumn("inside", F.col("main.rows"))
        main = cut(main, "jaccard-main")
        # What comparing those outside with all the others would take; cheap, it is done at once.
        before, work = work, main.agg(F.coalesce(F.sum((F.col("rows") - F.col("inside")) * F.col("rows").cast("double")), F.lit(0.0))).first()[0]
        last = work <= cheap * size or work > 0.7 * before
        if last:
            # Those outside against all the others, a hot shingle's share by share.
            # Two nodes that share an earlier shingle have met there: at their first common one they share none. Rows are
            # dealt by node once, for what they carry of their node and for its earlier shingles.
            earlier = Window.partitionBy("node").orderBy("at").rowsBetween(-EARLIER, -1)
            placed = rows.select("shingle", "share", "node", "at", "comp").join(few(main.select("shingle", "shares", F.col("main.comp").alias("main"))), "shingle")
            traced = placed.join(few(known), "node").withColumn("before", F.collect_list("shingle").over(earlier))
            traced = cut(traced.select("shingle", "share", "shares", "main", F.struct("node", "at", "comp", "n", "before", *PARITY).alias("y")), "jaccard-traced")
            to = F.when(F.col("shares") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("shares")))
            x = traced.where(F.col("y.comp") != F.col("main")).select("shingle", F.explode(to).alias("share"), F.col("y").alias("x"), "main")
            once = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
            late = x.join(traced.select("shingle", "share", "y"), ["shingle", "share"]).where(once & fits("x.at", "y.at") & near_enough("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before"))
            pairs = candidates(pair(late, "x.node", "y.node"), known, seen, percent)
        else:
            outside = rows.join(few(main), "shingle").where(F.col("comp") != F.col("main.comp"))
            pairs = candidates(pair(outside.where((F.col("main.degree") >= 0) & fits("at", "main.at")), "node", "main.node"), known, seen, percent)
        more = verify(docs, nodes, pairs, width, percent)
        seen, links = seen.unionByName(pairs), links.unionByName(more)
        centres = main.select(F.col("main.node").alias("node")).distinct().withColumn("tried", F.lit(True))
        tried = cut(centres if tried is None else centres.unionByName(tried).distinct(), "jaccard-tried")
        comps = cut(components(pair(comps, "node", "comp").unionByName(more)), "jaccard-comps")
        forget(main)
    placed = cut(nodes.join(few(comps), "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp")), "jaccard-placed")
    least = cut(placed.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("least")), "jaccard-least")
    forget(parts, known, table_of_met, comps)
    return placed.join(few(least), "comp", "left").select("doc_id", F.col("n").alias("jc_shingles"), F.coalesce("least", "doc_id").alias("jc_component"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("jc_shingles").alias("n_shingles"), F.col("jc_component").alias("component_id"))


SQL: dict[str, str] = {}
QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
