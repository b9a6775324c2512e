"""Training-data pipeline: quality, line dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents (the last one
returns tokens). It works on all rows it gets, whatever was kept before. :func:`run` writes each stage to the shared
folder as Parquet and reads it again, so a lost executor costs one stage at most.

Rows that repeat a doc_id are kept and dropped alike: where one of them is the row of its group that stays, all are. Rows
with a null doc_id stay whatever they copy, as no id could say which of them to keep. The mix takes each row by itself.
Null texts are empty texts; no stage drops a row for it but the classifier, which scores an empty text like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, factorisation, jaccard, line_dedup, mixing
from lodestack.llm.common import cut, few, forget, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    machine = factorisation.train(docs, table(spark, sf_dir, "labels"))
    return factorisation.score(docs, machine).where(F.col("fm_score") >= 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in three or more, but for the last that has them."""
    out = line_dedup.dedup_lines(docs).withColumn("text", F.col("ll_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    comps = jaccard.jaccard_components(docs.select("doc_id", "text"))
    keep = cut(comps.where(F.col("doc_id") == F.col("jc_component")).select("doc_id").distinct(), "pipeline-keep")
    known = docs.where(F.col("doc_id").isNotNull()).join(few(keep), "doc_id", "left_semi")
    return known.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whether or not its doc_id is null or stands in other rows."""
    # Numbers of rows hold once they are written.
    rows = cut(docs.withColumn("mx_row", F.monotonically_increasing_id()), "pipeline-rows")
    mixed = mixing.mix(rows.select("mx_row", "doc_id", "source", "text"), by=("doc_id", "text"), carry=("mx_row",))
    copies = cut(mixed.select("mx_row", "mx_copies").where(F.col("mx_copies") > 0), "pipeline-copies")
    rows = rows.join(few(copies), "mx_row")
    return rows.withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and their number; the decoded text's digest shows that the ids can be read back."""
    path = bpe.tokenizer_path()
    return bpe.bpe_round_trip(docs.select("doc_id", "source", "text"), path).select("doc_id", "source", "bpe_ids", F.size("bpe_ids").cast("long").alias("n_tokens"), F.sha2("bpe_text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokens),
]
#: A trained classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
            if before is not None:
                forget(before)  # read by the stage that is written now, and by no other
            before = docs
    return docs
