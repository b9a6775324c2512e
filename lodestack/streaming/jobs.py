"""Structured Streaming forms of the incremental work: quotas, ingestion, duplicates on arrival, changes of status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.chunking import chunk_records
from ..sources import tables
from ..sources.scratch import cut, forget
from ..sources.store import CODEC
from .state import Changes, Quota, use_rocksdb


def stream_quota(events: DataFrame, late: str = "1 hour", keep_hours: int = 24, sweep_ms: int = 60_000) -> DataFrame:
    """events (event_id, user_id, ts, daily_limit) as a stream, each with whether the quota allows it, as it arrives.

    Late events count, however late: each falls into the window of its own time. State is the windows of a user that
    ended less than keep_hours before the watermark (`late` behind the newest event); what falls before them opens a
    window anew. Within a batch events are taken in time order.
    """
    use_rocksdb(events.sparkSession)
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Quota(24, keep_hours, sweep_ms), "user_id long, event_id long, allowed boolean", "append", "processingTime")


def stream_status(events: DataFrame, status: str, terminal: tuple[str, ...] = (), key: str = "user_id", late: str = "1 hour", keep_hours: int = 24, sweep_ms: int = 60_000) -> DataFrame:
    """(key, event_id, status) of a stream of events (key, event_id, ts, status): rows that change the key's status, up to its end.

    What :func:`status_changes` gives for the same rows, if they come in time order; see :class:`Changes`.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select(key, "event_id", "ts", status).withWatermark("ts", late).groupBy(key)
    return rows.transformWithStateInPandas(Changes(key, status, terminal, keep_hours, sweep_ms), f"{key} long, event_id long, {status} string", "append", "processingTime")


def stream_ingest(pages: DataFrame, store: str, checkpoint: str):
    """Chunk arriving pages (brand, doc_id, name, page, text) and replace those pages in the store, with their documents' status.

    All chunks of a page, with the signals of all their text: see operators.chunking.chunk_records.
    Chunks and status are one commit, which carries the query's id and the batch's number: a batch that is replayed
    after a crash is done once, whether the crash came before the commit or after it. A page that has become empty
    loses its chunks; a document is `indexed` if it has chunks, else `error` (see sources.tables.document_status).
    Each batch reads and writes the brands it touches, so batches should be large beside a brand, or brands small.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        new = cut(chunk_records(batch, "brand", "doc_id", "name", "page"), "ingest-new", CODEC)
        met = cut(batch.select(F.col("brand").alias("brand_slug"), "doc_id", F.col("page").alias("page_number")).distinct(), "ingest-pages")
        tables.replace_pages(spark, store, met, new, query, number)
        forget(new, met)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(names: DataFrame, existing: DataFrame, name: str, brand: str) -> DataFrame:
    """Arriving names that neither the existing documents nor earlier arrivals have; the names seen are state for good."""
    known = existing.select(F.col(brand), t.normalize_filename(name).alias("norm")).distinct()
    fresh = names.withColumn("norm", t.normalize_filename(name)).join(known, [brand, "norm"], "left_anti")
    return fresh.dropDuplicates([brand, "norm"])


def status_changes(events: DataFrame, key: str, status: str, order: list[str], terminal: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose status differs from the one before, up to and with the key's first terminal status."""
    w = Window.partitionBy(key).orderBy(*order)
    ended = F.max(F.coalesce(F.col(status).isin(*terminal), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, -1)) if terminal else F.lit(False)
    rows = events.withColumns({"_before": F.lag(status).over(w), "_n": F.row_number().over(w), "_ended": F.coalesce(ended, F.lit(False))})
    return rows.where(~F.col("_ended") & ((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(status)))).drop("_before", "_n", "_ended")
