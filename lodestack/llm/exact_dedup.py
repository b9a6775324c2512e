"""Exact dedup: frequent digests leave by a broadcast of their verified winners, the others by an ordinary shuffle.

DataFrame functions only. Texts are equal when their SHA-256 after lower-casing A-Z is; null counts as empty. Of equal
texts the row with the largest doc_id stays; a null doc_id is below every number; of rows that also repeat that doc_id
one stays. A table of digests is written once, so texts are read once and never move to be compared.

Spark's frequent-items sketch (approx_top_k: a Misra-Gries summary, whose counters are decremented in batches) finds
every digest that more than about one in 4,700 rows have, for `counters` = 8192. Tasks' sketches meet in `WAYS` groups,
then in one: what a task gets is bounded. The sketch only names candidates: their rows are counted and their winners found
exactly, and the winners that more than one in `counters` rows have, which are fewer than `counters`, are broadcast.
Whatever the sketch names, the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, few, forget, table

#: Counters of a task's sketch; the broadcast table has no more rows than this.
COUNTERS = 8192
#: Groups in which the tasks' sketches are merged before they are merged into one.
WAYS = 64


def digests(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: xd_row (a number of its own), doc_id, xd_digest; written to the shared folder."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return cut(docs.select(F.monotonically_increasing_id().alias("xd_row"), "doc_id", F.unhex(F.sha2(text, 256)).alias("xd_digest")), "exact-digests")


def frequent(rows: DataFrame, counters: int) -> DataFrame:
    """Hashes (xd_hash) of `counters` digests at most that may stand in many rows; no digest of many rows is missing."""
    sketch = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(WAYS)).alias("way")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(xd_digest), {counters})").alias("s"))
    # By a key, so that tasks without rows have no sketch: combining would fail on theirs.
    top = sketch.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {counters})").alias("top"))
    return top.select(F.explode("top").alias("t")).where(F.col("t.count") > 1).select(F.col("t.item").alias("xd_hash"))


def _winners(rows: DataFrame) -> DataFrame:
    """xd_digest, xd_size and the winner (xd_best: doc_id, xd_row) of each digest; tasks sum before anything moves."""
    return rows.groupBy("xd_digest").agg(F.count(F.lit(1)).alias("xd_size"), F.max(F.struct("doc_id", "xd_row")).alias("xd_best"))


def classes(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Rows of :func:`digests` with xd_size, xd_keep (doc_id of the row that stays) and xd_kept."""
    group = Window.partitionBy("xd_digest")
    alone = lambda df: df.withColumns({"xd_size": F.count(F.lit(1)).over(group), "xd_best": F.max(F.struct("doc_id", "xd_row")).over(group)})
    told = lambda df: df.select(*rows.columns, "xd_size", F.col("xd_best.doc_id").alias("xd_keep"), (F.col("xd_best.xd_row") == F.col("xd_row")).alias("xd_kept"))
    n = rows.count()
    named = cut(frequent(rows, counters), "exact-candidates").withColumnRenamed("xd_hash", "h")
    # Verified: counted in full, and frequent indeed.
    heavy = cut(_winners(rows.join(F.broadcast(named), F.xxhash64("xd_digest") == F.col("h"), "left_semi")).where(F.col("xd_size") > n // counters), "exact-heavy")
    # A row of a frequent digest is settled where it is read.
    settled = rows.join(F.broadcast(heavy), "xd_digest").select(*rows.columns, "xd_size", "xd_best")
    rest = rows.join(F.broadcast(heavy.select("xd_digest")), "xd_digest", "left_anti")
    return told(settled.unionByName(alone(rest)))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called.

    Rows are written once with their numbers; those that go are left out by number, so texts move evenly, or not at all
    where few go.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("xd_row"), F.struct(*docs.columns).alias("xd_doc")), "exact-rows")
    text = ascii_lower(F.coalesce("xd_doc.text", F.lit("")))
    keys = cut(rows.select("xd_row", F.col("xd_doc.doc_id").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("xd_digest")), "exact-digests")
    gone = cut(classes(keys, counters).where(~F.col("xd_kept")).select("xd_row"), "exact-gone")
    forget(keys)
    return rows.join(few(gone), "xd_row", "left_anti").select("xd_doc.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(digests(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.col("xd_keep").alias("keep_id"), F.col("xd_size").alias("group_size"), F.col("xd_kept").alias("kept"), F.lower(F.hex("xd_digest")).alias("text_sha256"))


SQL = {
    "op11_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
  g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)"""
}
QUERIES = {"op11_exact_dedup": op11_exact_dedup}
