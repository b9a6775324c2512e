"""Hard-negative mining: slot-decomposed selection over integer inner products.

For every anchor and each of its positives (its best rows of the same label) the best rows of other labels are returned
whose score lies between `low` percent of the positive's score and that score. The positives' scores are upper limits of
overlapping windows. They split the scores into disjoint slots, so a row falls into one slot; tasks keep the best k rows
of each anchor and slot, tasks' rows meet and are cut to k again, and what stays in the slots at and below a positive,
in falling order, holds the answer of its window: k rows a slot answer all windows together.

Anchors are held against all rows by blocks: few anchors' blocks are broadcast (their size is checked), more of them are
dealt over salted groups of rows. Positives look at blocks of their own label only. A score is a float product where
that is exact (below 2^53), else one of 64-bit integers; scores of 2^56 and more are an error.

Rows with a null id, label or vector, or with a null entry, take no part; vectors of different lengths are not compared.
Rows that repeat an id are candidates of their own, tied, but not for the anchor of that id; as an anchor, the one with
the largest label, then vector, stands for all. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, few, forget, quantised, table

#: Rows of a block of candidates and of anchors.
ROWS, ANCHORS = 2048, 256
#: Numbers that a task keeps for its anchors before it sends them on.
HELD = 1 << 21
LOWEST, HIGHEST = -(1 << 62), 1 << 62

_BLOCK = "dim int, label long, ids binary, labels binary, x binary, limits binary"


def _packed(dim: int, label: int | None, parts: list[tuple]) -> pa.RecordBatch:
    ids, labels, x, limits = (np.concatenate(c) for c in zip(*parts, strict=True))
    small = next((t for t in (np.int16, np.int32) if not x.size or max(-x.min(), x.max()) <= np.iinfo(t).max), np.int64)
    raw = [np.ascontiguousarray(v).tobytes() for v in (ids, labels, x.astype(small), limits)]
    columns = [pa.array([dim], pa.int32()), pa.array([label], pa.int64()), *[pa.array([r], pa.binary()) for r in raw]]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "label", "ids", "labels", "x", "limits"])


def blocks(rows: DataFrame, size: int, by_label: bool) -> DataFrame:
    """Rows (vec_id, label, x, and limits, an array, if there) packed into blocks of at most `size`, of one length, and of one label or any."""
    limited = "limits" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = defaultdict(list), defaultdict(int)
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x, dims = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(dims)]
            limits = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if limited else np.empty((len(ids), 0), np.int64)
            keys = np.stack([dims.astype(np.int64), labels if by_label else np.zeros(len(ids), np.int64)], axis=1)
            for key in np.unique(keys, axis=0):
                of = np.flatnonzero((keys == key).all(axis=1))
                dim, label = int(key[0]), int(key[1]) if by_label else None
                for i in range(0, len(of), size):
                    some = of[i : i + size]
                    held[dim, label].append((ids[some], labels[some], x[(at[some][:, None] + np.arange(dim)).ravel()], limits[some].ravel()))
                    counts[dim, label] += len(some)
                    if counts[dim, label] >= size:
                        yield _packed(dim, label, held.pop((dim, label)))
                        del counts[dim, label]
            if sum(counts.values()) > 8 * size:
                yield from (_packed(*k, held[k]) for k in held)
                held.clear()
                counts.clear()
        yield from (_packed(*k, held[k]) for k in held)

    return rows.select("vec_id", F.col("label").cast("long"), "x", *["limits"] * limited).mapInArrow(run, _BLOCK)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    most = float(np.abs(a.astype(np.float64)).sum(axis=1).max()) * float(np.abs(b.astype(np.float64)).max())
    if most < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most >= 1 << 56:
        raise OverflowError("scores of 2^56 and more are not supported")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tops:
    """The best k candidates met so far for each anchor of a block and each slot of scores.

    limits: a row of upper limits, falling, for each anchor. Slot i holds scores at most limits[i] and above
    limits[i + 1]; of these only the ones at least `low` percent of limits[i] count, as no window reaches lower.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, limits: np.ndarray, k: int, low: int | None):
        self.ids, self.labels, self.x, self.limits, self.k = ids, labels, x, limits, k
        least = np.full_like(limits, LOWEST) if low is None else -((-low * limits.astype(object)) // 100).astype(np.int64)
        self.least = np.where(limits == LOWEST, HIGHEST, least)
        self.score = np.full((*limits.shape, k), LOWEST, dtype=np.int64)
        self.at = np.full((*limits.shape, k), HIGHEST, dtype=np.int64)

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool) -> None:
        s = product(self.x, x)
        least = np.maximum(self.least, self.score[:, :, -1])
        i, j = np.nonzero((s >= least.min(axis=1)[:, None]) & (s <= self.limits[:, :1]))
        fine = ((self.labels[i] == labels[j]) == same) & (self.ids[i] != ids[j])
        i, j = i[fine], j[fine]
        v, new = s[i, j].astype(np.int64), ids[j]
        slot = (self.limits[i] >= v[:, None]).sum(axis=1) - 1
        fine = v >= least[i, slot]
        i, slot, v, new = i[fine], slot[fine], v[fine], new[fine]
        if not len(i):
            return
        # What the touched slots hold joins the new rows; the first k of each stay.
        touched = np.unique(i * self.limits.shape[1] + slot)
        ti, ts = np.divmod(touched, self.limits.shape[1])
        old_v, old_at = self.score[ti, ts], self.at[ti, ts]
        kept = old_v > LOWEST
        i = np.r_[i, np.repeat(ti, self.k)[kept.ravel()]]
        slot = np.r_[slot, np.repeat(ts, self.k)[kept.ravel()]]
        v, new = np.r_[v, old_v[kept]], np.r_[new, old_at[kept]]
        order = np.lexsort((new, -v, slot, i))
        i, slot, v, new = i[order], slot[order], v[order], new[order]
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (slot[1:] != slot[:-1])])
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        first = rank < self.k
        self.score[ti, ts], self.at[ti, ts] = LOWEST, HIGHEST
        self.score[i[first], slot[first], rank[first]] = v[first]
        self.at[i[first], slot[first], rank[first]] = new[first]

    def rows(self) -> pa.RecordBatch:
        i, slot, r = np.nonzero(self.score > LOWEST)
        columns = [self.ids[i], slot.astype(np.int32), self.score[i, slot, r], self.at[i, slot, r]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "score", "vec_id"])


def best(anchors: DataFrame, rows: DataFrame, k: int, low: int | None, same: bool) -> DataFrame:
    """(anchor_id, slot, score, vec_id): the best k rows of the anchor's label, or of other labels, in each slot.

    anchors: vec_id, label, x, limits. What leaves a task is at most k rows an anchor and slot, each time it lets go.
    """
    packed = cut(blocks(anchors, ANCHORS, same), "negatives-anchors")
    left = packed.select(F.col("dim"), F.col("label"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "x", "limits")])
    right = blocks(rows, ROWS, same)
    on = ["dim", "label"] if same else ["dim"]
    left, right = (df if same else df.drop("label") for df in (left, right))
    if (small := few(left)) is not left:
        both = right.join(small, on)
    else:  # every group of the rows meets all anchors
        ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = left.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        both = left.join(right.withColumn("way", F.pmod(F.xxhash64("ids"), F.lit(ways)).cast("int")), [*on, "way"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Tops] = {}
        whole = lambda raw: np.frombuffer(raw, np.int64)

        def matrix(raw, n, dim):
            return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (n * dim)] if dim else np.int16).reshape(n, dim)

        for batch in batches:
            for dim, a_ids, a_labels, a_x, a_limits, ids, labels, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a_ids not in held:
                    if sum(t.score.size for t in held.values()) > HELD:
                        yield from (t.rows() for t in held.values())
                        held.clear()
                    n = len(a_ids) // 8
                    held[a_ids] = Tops(whole(a_ids), whole(a_labels), matrix(a_x, n, dim), whole(a_limits).reshape(n, -1), k, low)
                held[a_ids].add(whole(ids), whole(labels), matrix(x, len(ids) // 8, dim), same)
        yield from (t.rows() for t in held.values())

    found = both.select("dim", "a_ids", "a_labels", "a_x", "a_limits", "ids", "labels", "x").mapInArrow(run, "anchor_id long, slot int, score long, vec_id long")
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    out = cut(found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k), "negatives-best")
    forget(packed)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, x (array of long).

    An anchor's positives are its best `positives` rows of the same label; each has the best `negatives` rows of other
    labels with `low` percent of the positive's score at least and that score at most. Ties go to the smaller id.
    """
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False)))
    rows = cut(rows.select("vec_id", "label", "x"), "negatives-rows")
    anchors = cut(rows.where(is_anchor).groupBy("vec_id").agg(F.max(F.struct("label", "x")).alias("a")).select("vec_id", "a.*"), "negatives-anchors")
    found = best(anchors.withColumn("limits", F.array(F.lit(HIGHEST))), rows, positives, None, same=True)
    found = found.select("anchor_id", F.col("k").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # At most `positives` limits an anchor, falling; missing ones are slots that nothing enters.
    pad = F.array_repeat(F.lit(LOWEST).cast("long"), positives)
    limits = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.slice(F.concat(F.sort_array(F.collect_list("positive_score"), asc=False), pad), 1, positives).alias("limits"))
    mined = best(anchors.join(limits, "vec_id"), rows, negatives, low, same=False)
    # Slots in order are scores in order: a window is the first rows of the slots from its own on, down to its low end.
    slots = mined.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("fall"), "vec_id"))).alias("slots"))
    suffix = F.filter("slots", lambda s: s["fall"] >= -F.col("positive_score"))
    window = F.filter(F.slice(suffix, 1, negatives), lambda s: F.lit(low) * F.col("positive_score") <= F.lit(-100) * s["fall"])
    told = found.join(slots, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "n"))
    return told.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.fall")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
        FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
