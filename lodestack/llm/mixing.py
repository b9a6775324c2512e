"""Mixing sources to target weights: subset-sum budget fitting over counts by exact token length.

A source's target is its weighted share of the budget, at most max_copies times its size (water-filling: the excess
goes to the others by weight). Whole passes over the source come first; what is left of the target is fitted by a
bounded-knapsack dynamic programme over how many documents of each exact length there are; the documents of a length
are then picked by a seeded hash. Reruns agree: nothing depends on partitioning.

Null or blank text: size 0, taken 0. A null source is a source of its own, ranked last. An empty table gives no rows.
Rows that repeat a doc_id are documents of their own. Only histograms (one row for each source and exact length)
reach a Python worker, one source at a time; documents never do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
#: Bytes of sums that the dynamic programme remembers at once; what it forgets it works out again.
HELD = 32 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_copies: int = 2) -> DataFrame:
    """One row for each source: source, source_size, target. sized: source, size.

    min(max_copies * size, weight * level) with the one level that spends the budget; sorting sources by the level at
    which each is full gives it in closed form. The global windows run over sources, not documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    full = Window.orderBy("fills_at", "source_rank")
    rank = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)) + 1)
    df = by_source.withColumns({"source_rank": rank, "weight": weight, "cap": F.col("source_size") * float(max_copies)})
    df = df.withColumns({"fills_at": F.col("cap") / F.col("weight"), "total": F.sum("source_size").over(every) * F.lit(float(budget))})
    below = full.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "level": (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))),
    })
    # The first source that does not fill at the level set by those before it fixes the level for itself and the rest.
    df = df.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "source_rank", "level"))).over(every)["level"])
    return df.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of counts[i] items of lengths[i] > 0 to take so that their total is as near budget as can be.

    An even share of every length comes first, then the longest that still fit. The dynamic programme then exchanges
    items: over sums that differ from there by at most `span`, it tells what can be reached by giving some back and
    taking others. The span grows until the nearest sum that the lengths' common divisor allows is found, or until it
    holds every exchange that can be needed: with lengths up to L, exchanges of more than 2 L items have a part that
    sums to nothing and can be left out, so 2 L^2 is enough.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * int(budget) // total for c in counts], dtype=np.int64)
    left = int(budget) - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        k = min(left // int(lengths[i]), int(counts[i] - take[i]))
        take[i] += k
        left -= k * int(lengths[i])
    if not left:
        return take
    longest, divisor = int(lengths.max()), int(np.gcd.reduce(lengths[counts > 0]))
    least = min(left % divisor, divisor - left % divisor) if left % divisor else 0
    span, enough = max(2 * longest, min(16 * longest, 1 << 18)), min(total, 2 * longest * (longest // divisor)) + longest
    while True:
        found, off = _exchange(lengths, counts, take, left, span, least)
        if off == least or span >= enough:
            return found
        span = min(8 * span, enough)


def _exchange(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: int, span: int, least: int) -> tuple[np.ndarray, int]:
    """take with items exchanged so that it gains a sum as near `left` as can be within the span, and how far off that is."""
    goal, mask = span + left, (1 << (2 * span + 1)) - 1
    # What a step may do: give back, or take, so many items of a length; in powers of two, so that every number comes up.
    steps = []
    for i in np.argsort(lengths, kind="stable"):
        for sign, room in ((-1, int(take[i])), (1, int(counts[i] - take[i]))):
            room, part = min(room, 2 * span // int(lengths[i]) + 1), 1
            while room > 0:
                k = min(part, room)
                steps.append((int(i), sign * k, sign * k * int(lengths[i])))
                room -= k
                part *= 2

    def after(reach: int, step: tuple[int, int, int]) -> int:
        return reach | ((reach << step[2]) & mask if step[2] > 0 else reach >> -step[2])

    reach, ended = 1 << span, 0
    for ended, step in enumerate(steps, 1):
        reach = after(reach, step)
        if reach >> goal & 1 or (least and (reach >> goal - least & 1 or reach >> goal + least & 1)):
            break
    under = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = reach >> goal
    over = goal + (over & -over).bit_length() - 1 if over else None
    at = over if over is not None and over - goal < goal - under else under
    off, take = abs(at - goal), take.copy()

    def back(lo: int, hi: int, reach: int) -> None:
        """Undo steps hi - 1 to lo from `at`; reach: what the steps before lo reach. Few sets of sums are held at once."""
        nonlocal at
        if hi - lo > 1 and (hi - lo) * (span // 4) > HELD:
            mid, half = (lo + hi) // 2, reach
            for step in steps[lo:mid]:
                half = after(half, step)
            back(mid, hi, half)
            back(lo, mid, reach)
            return
        held = []
        for step in steps[lo:hi]:
            held.append(reach)
            reach = after(reach, step)
        for (i, k, words), before in zip(reversed(steps[lo:hi]), reversed(held), strict=True):
            if not before >> at & 1:
                take[i] += k
                at -= words

    back(0, ended, 1 << span)
    return take, off


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", kind="stable")
    n, size, target = pdf["n"].to_numpy(), pdf["size"].to_numpy(), float(pdf["target"].iloc[0])
    total = int((n * size).sum())
    passes = min(int(target // total), int(pdf["max_copies"].iloc[0])) if total else 0
    live = size > 0
    extra = np.zeros(len(pdf), dtype=np.int64)
    if passes < int(pdf["max_copies"].iloc[0]):
        extra[live] = fit_counts(size[live], n[live], int(round(target - passes * total)))
    return pdf[["sk", "size"]].assign(passes=passes, extra=extra)


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, budget: float = 1.5, max_copies: int = 2, by: tuple[str, ...] = ("doc_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, mx_size, mx_source_size, mx_target, mx_copies for every row of docs, and its columns named in carry.

    The hash of `by` says which rows of a length come first; rows equal in it are picked in any order.
    """
    sk = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # joins as an equal, null or not
    key = F.xxhash64(F.lit(seed), *by)
    d = docs.select(*carry, "doc_id", "source", sk.alias("sk"), n_words(F.col("text")).alias("size"), key.alias("h"), F.pmod(key, F.lit(BUCKETS)).cast("int").alias("b"))
    d = cut(d, "mix-sizes")
    hist = d.groupBy("sk", "size", "b").agg(F.count(F.lit(1)).alias("n"))
    lengths = hist.groupBy("sk", "size").agg(F.sum("n").alias("n"))
    goal = cut(targets(d, weights, budget, max_copies).withColumn("sk", sk), "mix-targets")
    planned = lengths.join(goal.select("sk", "target"), "sk").withColumn("max_copies", F.lit(max_copies))
    plan = cut(planned.groupBy("sk").applyInPandas(_plan_source, "sk string, size long, passes int, extra long"), "mix-plan")
    # Buckets of the hash in order: all of a bucket, none, or (in one bucket of each length) the first few by hash.
    run = Window.partitionBy("sk", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = hist.withColumn("before", F.sum("n").over(run) - F.col("n"))
    buckets = at.join(plan, ["sk", "size"]).select("sk", "size", "b", "n", (F.col("extra") - F.col("before")).alias("room"), "passes")
    rows = d.join(buckets, ["sk", "size", "b"])
    split = (F.col("room") > 0) & (F.col("room") < F.col("n"))
    whole = rows.where(~split).withColumn("picked", F.col("room") > 0)
    order = Window.partitionBy("sk", "size", "b").orderBy("h", "doc_id")
    parts = rows.where(split).withColumn("picked", F.row_number().over(order) <= F.col("room"))
    out = whole.unionByName(parts).join(goal.select("sk", "source_size", "target"), "sk")
    return out.select(*carry, "doc_id", "source", F.col("size").alias("mx_size"), F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target"), (F.col("passes") + F.col("picked").cast("int")).alias("mx_copies"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_size") * F.col("mx_copies")).alias("taken"))


SQL: dict[str, str] = {}
QUERIES = {"op9_source_mixing": op9_source_mixing}
