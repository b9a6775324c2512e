"""Cosine search of tables of queries in tables of chunks, by blocks of both as rows.

Vectors are packed into blocks of one brand and one length where they are read. Few queries' blocks are broadcast (their
size is checked) and chunks stay where they are; more of them are dealt, with chunks, over salted groups of each brand,
so neither a million queries nor a brand with most chunks ends in one task or on the driver. What leaves a pair of
blocks is at most `top` rows a query, or `per_doc` rows a query and document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut, few

#: Vectors of a block of queries and of chunks.
QUERIES, CHUNKS = 256, 2048


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, doc, brand, vector) as blocks (brand, dim, ids, docs, x); x has unit vectors. Vectors that are null, zero or hold nulls are left out, as are null ids and brands."""
    brand = rows.schema["brand"].dataType
    schema = T.StructType([T.StructField("brand", brand), T.StructField("dim", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("ids", "docs", "x"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = defaultdict(list), defaultdict(int)

        def packed(key):
            ids, docs, x = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
            counts.pop(key)
            columns = [pa.array([key[0]], kind), pa.array([key[1]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (ids, docs, x.astype(np.float64))]]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.column(2).type
            brands, lengths = batch.column(2).dictionary_encode(), pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            names, coded = brands.dictionary.to_pylist(), brands.indices.to_numpy(zero_copy_only=False)
            flat, starts = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(lengths)].astype(np.int64)
            ids, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = np.stack([coded, lengths], axis=1).astype(np.int64)
            for code, dim in np.unique(keys, axis=0).tolist():
                of = np.flatnonzero((keys == (code, dim)).all(axis=1))
                x = flat[starts[of][:, None] + np.arange(dim)]
                norm = np.linalg.norm(x, axis=1)
                fine = np.isfinite(norm) & (norm > 0)
                of, x = of[fine], x[fine] / norm[fine, None]
                for i in range(0, len(of), size):
                    key = names[code], dim
                    held[key].append((ids[of[i : i + size]], docs[of[i : i + size]], x[i : i + size]))
                    counts[key] += len(of[i : i + size])
                    if counts[key] >= size:
                        yield packed(key)
            if sum(counts.values()) > 8 * size:
                for key in list(held):
                    yield packed(key)
        for key in list(held):
            yield packed(key)

    rows = rows.select(F.col("id").cast("long"), F.col("doc").cast("long"), "brand", "vector")
    return rows.dropna().where(F.size("vector") > 0).mapInArrow(run, schema)


def best_of(s: np.ndarray, fine: np.ndarray, groups: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the best n fine entries of each row i and group of columns; ties go to the smaller id."""
    i, j = np.nonzero(fine)
    if not len(i):
        return i, j
    order = np.lexsort((ids[j], -s[i, j], groups[j], i))
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (groups[j][1:] != groups[j][:-1])])
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    return i[rank < n], j[rank < n]


def nearest(queries: DataFrame, chunks: DataFrame, n: int, least: float, by_doc: bool = False, strict: bool = False) -> DataFrame:
    """(query_id, doc_id, chunk_id, similarity) of the best n chunks of each query, or query and document.

    queries: query_id, brand, vector; chunks: chunk_id, brand, vector, and doc_id if by_doc (else doc_id is null). Only
    chunks of the query's brand and the same length count, with a cosine of `least` or more (above it, if strict).
    Cosines are rounded to 12 digits, so that equal vectors tie wherever they stand; ties go to the smaller chunk_id.
    """
    zero = F.lit(0).cast("long")
    left = cut(blocks(queries.select(F.col("query_id").alias("id"), zero.alias("doc"), "brand", "vector"), QUERIES), "query-blocks")
    left = left.select("brand", "dim", F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    right = blocks(chunks.select(F.col("chunk_id").alias("id"), (F.col("doc_id") if by_doc else zero).alias("doc"), "brand", "vector"), CHUNKS)
    if (small := few(left)) is not left:
        both = right.join(small, ["brand", "dim"])
    else:
        ways = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = left.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        both = left.join(right.withColumn("way", F.pmod(F.xxhash64("ids"), F.lit(ways)).cast("int")), ["brand", "dim", "way"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[bytes, np.ndarray] = {}  # of queries, what their n-th best chunk of a block had
        for batch in batches:
            for dim, q_ids, q, ids, docs, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine, ids, docs = (np.frombuffer(v, np.int64) for v in (q_ids, ids, docs))
                s = np.round(np.frombuffer(q).reshape(-1, dim) @ np.frombuffer(x).reshape(-1, dim).T, 12)
                if len(bars) > 4096:
                    bars.clear()
                bar = bars.setdefault(q_ids, np.full(len(mine), least))
                fine = (s > least) & (s >= bar[:, None]) if strict else s >= bar[:, None]
                i, j = best_of(s, fine, docs, ids, n)
                if not by_doc and len(i):  # what is below a block's n-th best is not among the best n
                    counts = np.bincount(i, minlength=len(mine))
                    lowest = np.full(len(mine), np.inf)
                    np.minimum.at(lowest, i, s[i, j])
                    bars[q_ids] = np.where(counts >= n, np.maximum(bar, lowest), bar)
                yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(docs[j]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "doc_id", "chunk_id", "similarity"])

    found = both.select("dim", "q_ids", "q", "ids", "docs", "x").mapInArrow(run, "query_id long, doc_id long, chunk_id long, similarity double")
    w = Window.partitionBy("query_id", *["doc_id"] * by_doc).orderBy(F.desc("similarity"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
