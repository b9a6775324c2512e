"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

DataFrame functions only. Null and empty texts are one empty line. All rows with a null doc_id count as one document, which
sorts below every number, so it keeps a line only where nobody else has it. Rows that repeat a doc_id count as one document
and are decided alike. Columns beside doc_id and text are kept by :func:`dedup_lines` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WS, ascii_lower, cut, few, table

ADDED = ("ll_lines", "ll_dropped", "ll_text")


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line long enough to count: doc_id, text hash, position and a 96-bit hash of its key."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return (
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.posexplode(lines).alias("pos", "line"))
        .select("doc_id", "th", "pos", ascii_lower(F.btrim("line", F.lit(WS))).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with ll_lines (before), ll_dropped and ll_text (kept lines, joined by newlines).

    Lines whose key has min_chars code points and stands in min_docs documents go, but for the largest doc_id's.
    Counting shuffles hashes, not lines; texts move once, to meet the positions they lose.
    """
    keys = cut(line_keys(docs, min_chars), "line-keys")
    common = keys.groupBy("h1", "h2").agg(F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    # Written first, so that the join is a stage of its own: small, it needs no shuffle; else hot lines can be split.
    dropped = keys.join(few(cut(common, "line-common")), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    gone = dropped.select(F.coalesce("doc_id", F.lit(-1)).alias("ll_k"), F.col("doc_id").isNull().alias("ll_null"), F.col("th").alias("ll_th"), F.col("gone").alias("ll_gone"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"ll_k": F.coalesce("doc_id", F.lit(-1)), "ll_null": F.col("doc_id").isNull(), "ll_th": F.xxhash64(text)})
    joined = rows.join(gone, ["ll_k", "ll_null", "ll_th"], "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("ll_gone", F.array().cast("array<int>")))
    kept = F.when(F.col("ll_gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda p: F.element_at(lines, p + 1)), "\n"))
    return joined.select(*docs.columns, F.size(lines).cast("long").alias("ll_lines"), F.coalesce(F.size("ll_gone"), F.lit(0)).cast("long").alias("ll_dropped"), kept.alias("ll_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ll_lines").alias("n_lines"), F.col("ll_dropped").alias("n_dropped"), F.sha2("ll_text", 256).alias("kept_sha256"))


#: DuckDB's form of the whole operator; kept is the text that stays.
KEPT_SQL = f"""
  l AS (SELECT doc_id, i AS pos, lines[i] AS line,
               translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM docs))),
  common AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  flagged AS (SELECT l.*, common.key IS NOT NULL AND l.doc_id <> common.keeper AS gone FROM l LEFT JOIN common USING (key)),
  kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM flagged GROUP BY doc_id)
"""
SQL = {"op7_line_dedup": f"WITH docs AS (SELECT doc_id, text FROM documents), {KEPT_SQL} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"}
QUERIES = {"op7_line_dedup": op7_line_dedup}
