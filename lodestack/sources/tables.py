"""Tables: reading, chunk storage by brand, idempotent replacement, cascades, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reachable
from . import store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{directory}/{name}.parquet")


def load_tables(spark: SparkSession, directory: str, names=TABLES) -> dict[str, DataFrame]:
    """The named tables, lazily; only the columns that a job selects are read."""
    return {n: load(spark, directory, n) for n in names}


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database, read by ranges of its key in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def file_inventory(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path (relative to root) and size of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    tail = F.element_at(F.split("path", root.rstrip("/") + "/", 2), -1)
    return files.select(tail.alias("path"), F.col("length").alias("size"))


def read_chunks(spark: SparkSession, path: str, brand: str | None = None) -> DataFrame | None:
    """Chunks of the last whole write (None before the first); a brand's filter prunes folders."""
    chunks = store.read(spark, path, "chunks")
    return chunks if brand is None or chunks is None else chunks.where(F.col("brand_slug") == brand)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the brands that chunks has, all at once, and leave the others alone; see sources.store."""
    store.commit(chunks.sparkSession, path, {"chunks": chunks})


def without(rows: DataFrame, gone: DataFrame, keys) -> DataFrame:
    """rows whose keys (null is a value like others) are not in gone."""
    gone = gone.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"_{k}"))
    return rows.join(gone, same, "left_anti")


def upsert_chunks(existing: DataFrame, new: DataFrame, keys=("brand_slug", "doc_id", "page_number")) -> DataFrame:
    """existing without the pages that new touches, and new. Doing it twice is doing it once."""
    return without(existing, new, keys).unionByName(new)


def replace_pages(spark: SparkSession, path: str, pages: DataFrame, new: DataFrame, writer: str | None = None, batch: int = 0) -> bool:
    """In the store at path, new chunks in place of all chunks of pages (brand_slug, doc_id, page_number), and the documents' status.

    One commit: readers see all of it or nothing; a batch that a writer repeats is left out (False). A document of the
    pages is `indexed` if it has chunks then, else `error`. Only brands of the pages are read and written again. pages
    and new are read more than once, so they should be written tables.
    """
    brands = [r[0] for r in pages.select("brand_slug").distinct().collect()]  # tenants
    held = F.col("brand_slug").isin([b for b in brands if b is not None]) | (F.col("brand_slug").isNull() if None in brands else F.lit(False))
    old, told = store.read(spark, path, "chunks"), store.read(spark, path, "status")
    docs = pages.select("brand_slug", "doc_id").distinct()
    chunks = new if old is None else without(old.where(held), pages, ["brand_slug", "doc_id", "page_number"]).unionByName(new)
    counts = chunks.groupBy("brand_slug", "doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_number").alias("pages")).select(F.col("brand_slug").alias("_b"), F.col("doc_id").alias("_d"), "chunks", "pages")
    docs = docs.join(counts, F.col("brand_slug").eqNullSafe(F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = docs.select("brand_slug", "doc_id", F.when(F.col("chunks") > 0, "indexed").otherwise("error").alias("status"), zero("chunks"), zero("pages"))
    if told is not None:
        status = without(told.where(held), status, ["brand_slug", "doc_id"]).unionByName(status)
    return store.commit(spark, path, {"chunks": chunks, "status": status}, brands, writer, batch)


def document_status(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """documents (brand_slug, doc_id) with status, chunks and pages of the store; `pending` where it has not met them."""
    told = store.read(spark, path, "status")
    rows = documents.select("brand_slug", "doc_id")
    if told is None:
        return rows.select("*", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("pages"))
    told = told.select(F.col("brand_slug").alias("_b"), F.col("doc_id").alias("_d"), "status", "chunks", "pages")
    rows = rows.join(told, F.col("brand_slug").eqNullSafe(F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return rows.select("brand_slug", "doc_id", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("pages", F.lit(0)).alias("pages"))


def delete_documents(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, limit: int = 500_000) -> dict[str, DataFrame]:
    """Each (table, key) without the documents in ids (column id). Ids go to every task if there are few enough."""
    ids = ids.select("id").where(F.col("id").isNotNull()).distinct()
    gone = F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
    return {n: df.join(gone.withColumnRenamed("id", key), key, "left_anti") for n, (df, key) in tables.items()}


def merge_collections(chunks: DataFrame, source: str, target: str) -> DataFrame:
    """Move one brand's chunks into another; of equal ids the moved one stays."""
    moved = F.col("brand_slug") == source
    tagged = chunks.withColumns({"from_source": moved, "doc_filename": F.when(moved, F.regexp_replace("doc_filename", f"^{source}/", f"{target}/")).otherwise(F.col("doc_filename")), "brand_slug": F.when(moved, F.lit(target)).otherwise(F.col("brand_slug"))})
    names = [c for c in chunks.columns if c not in ("id", "brand_slug")]
    best = tagged.groupBy("brand_slug", "id").agg(F.max_by(F.struct(*names), F.struct("from_source", *names)).alias("x"))
    return best.select("id", "brand_slug", "x.*").select(*chunks.columns)


#: A judged run: counts and one result for each case. passed is true, false or "partial", so it is read as a string.
EVAL_SCHEMA = "timestamp string, total int, passed int, partial int, failed int, errors int, results array<struct<id: int, passed: string, details: array<string>, error: string>>"


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    report = spark.read.schema(EVAL_SCHEMA).option("multiLine", "true").json(path)
    return report.select(F.explode("results").alias("r")).select("r.*")


def write_eval_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


CITATION = T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def parse_sources(c: Column) -> Column:
    """A JSON list of citations as an array; null, blank or broken text is an empty one."""
    return F.coalesce(F.from_json(c, CITATION), F.array().cast(CITATION))
