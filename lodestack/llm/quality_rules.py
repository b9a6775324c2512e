"""Quality rules as a bitmask ledger: every rule once, its failure a bit, its measurement kept.

:func:`ledger` measures each document once and stores one bit for each failed rule. :func:`apply_policy` reads a
versioned policy (a mask of the rules in force) off the ledger; :func:`ablations` tells by bitwise aggregation what
each rule of a policy rejects alone and with others, without another look at a text.

Null text is no words. A document without words fails the base rule. Rows that repeat a doc_id are judged one by one.
Columns beside doc_id and text are kept, but for those named as a measurement, qr_fails or the verdict, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_caps_words", "n_punct_words", "n_stuck_words")


def _rules() -> dict[str, Column]:
    """Rules in the order of their bits; each is true where a document fails it. Integers only, so that reruns agree."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "short_words": 10 * c("word_chars") < 20 * c("n_words"),
        "long_words": 10 * c("word_chars") > 150 * c("n_words"),
        "capitals": 100 * c("n_caps_words") > 50 * c("n_words"),
        "same_words": (c("n_words") >= 20) & (100 * c("n_distinct_words") < 2 * c("n_words")) & (c("n_distinct_words") < 20),
        "shouting": 100 * c("n_punct_words") > 50 * c("n_words"),
        "stuck_words": 100 * c("n_stuck_words") > 30 * c("n_words"),
    }


#: Policies by version: the names of the rules in force.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "capitals", "same_words", "shouting", "stuck_words"),
}
BASE, CURRENT = 1, 2


def policy_mask(version: int) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in POLICIES[version])


def _covered(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more: ids are compared exactly, by doubling 1, 2, 4, 8."""
    n, width = len(ids), 1
    if n <= WINDOW:
        return 0
    while width < WINDOW:
        left, right = ids[:-width].astype(np.int64), ids[width:]
        ids = pd.factorize(left * (n + 1) + right)[0]
        width *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()  # splits at ASCII white space, no other
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # Code points are the bytes that do not continue one.
    chars = sum(map(len, words)) if raw.isascii() else len(b"".join(words).decode())
    caps = punct = 0
    times = np.bincount(ids)
    for w, i in index.items():
        if len(w) > 1 and w.decode().isupper():
            caps += int(times[i])
        if w.endswith((b"!!", b"??")):
            punct += int(times[i])
    return n, chars, sum(map(raw.count, (s.encode() for s in SYMBOLS))), len(lines), len(lines) - len(set(lines)), _covered(ids), len(index), caps, punct, int((ids[1:] == ids[:-1]).sum())


def ledger(docs: DataFrame) -> DataFrame:
    """docs without text, with qr_fails (bit i: the i-th rule failed) and the measurements."""
    keep = [f for f in docs.schema.fields if f.name != "text" and f.name not in MEASURES]
    schema = T.StructType(keep + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            columns += [pa.array([g[i] for g in got], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    bits = [F.when(rule, F.lit(1 << i)).otherwise(0) for i, rule in enumerate(_rules().values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return docs.mapInArrow(run, schema).withColumn("qr_fails", mask.cast("long"))


def apply_policy(rows: DataFrame, version: int = CURRENT, out: str = "kept") -> DataFrame:
    return rows.withColumn(out, F.col("qr_fails").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row for each rule of the policy: rule, failed, failed_alone (kept if the rule went), kept_by_policy, docs.

    Documents are first counted by their bits, so what is shuffled is at most one row for each set of failed rules.
    """
    spark, mask = rows.sparkSession, policy_mask(version)
    sets = rows.groupBy(F.col("qr_fails").bitwiseAND(F.lit(mask)).alias("fails")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame([(r, 1 << list(_rules()).index(r)) for r in POLICIES[version]], "rule string, bit long")
    hit = F.col("fails").bitwiseAND(F.col("bit")) != 0
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return F.broadcast(rules).join(sets, F.lit(True), "left").groupBy("rule", "bit").agg(
        count(hit).alias("failed"), count(F.col("fails") == F.col("bit")).alias("failed_alone"), count(F.col("fails") == 0).alias("kept_by_policy"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = apply_policy(apply_policy(rows, BASE, "base_ok"), CURRENT, "kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "qr_fails")


SQL: dict[str, str] = {}
QUERIES = {"op2_quality_rules": op2_quality_rules}
