"""Vector search by blocks against numpy over all pairs."""

import numpy as np
import pytest

from lodestack.operators import retrieval, vectors


def by_hand(queries, chunks, n, least, by_doc, strict):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = []
    for q, brand, v in queries:
        if v is None or None in v or not any(v):
            continue
        groups = {}
        for c, d, b, w in chunks:
            if b == brand and b is not None and w is not None and len(w) == len(v) and None not in w and any(w):
                s = unit(v) @ unit(w)
                if s > least if strict else s >= least:
                    groups.setdefault(d if by_doc else 0, []).append((-round(s, 9), c))
        out += [(q, c) for g in groups.values() for _, c in sorted(g)[:n]]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_blocks_equal_all_pairs(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(8)
    vector = lambda: [float(x) for x in rng.integers(-3, 4, 5)]
    chunks = [(i, i % 7, "hot" if i % 3 else f"b{i % 4}", vector()) for i in range(600)] + [(900, 1, "hot", None), (901, 1, None, vector()), (902, 2, "hot", [0.0] * 5), (903, 2, "hot", [1.0, 2.0]), (904, 3, "hot", [1.0, None, 1.0, 1.0, 1.0])]
    queries = [(i, ["hot", "b0", "b1", "none"][i % 4], vector()) for i in range(60)] + [(70, "hot", [2.0, 4.0]), (71, None, vector()), (72, "hot", None)]
    q = spark.createDataFrame(queries, "query_id long, brand string, vector array<float>").repartition(2)
    c = spark.createDataFrame(chunks, "chunk_id long, doc_id long, brand string, vector array<float>").repartition(3)
    if not broadcast:
        monkeypatch.setattr(vectors, "few", lambda df: df)
    monkeypatch.setattr(vectors, "QUERIES", 16)
    monkeypatch.setattr(vectors, "CHUNKS", 50)
    near = retrieval.cosine_topk(q, c, 6, 0.3).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in near) == by_hand(queries, chunks, 6, 0.3, False, False)
    assert {r["rank"] for r in near} == set(range(1, 7))
    strict = retrieval.match_documents(q, c, 0.5, 4).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in strict) == by_hand(queries, chunks, 4, 0.5, False, True)
    per_doc = retrieval.nearest_per_doc(q, c, 2, 0.1).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in per_doc) == by_hand(queries, chunks, 2, 0.1, True, False)
    assert all(r["doc_id"] == r["chunk_id"] % 7 for r in per_doc if r["chunk_id"] < 900)
    assert retrieval.cosine_topk(q.limit(0), c, 6, 0.3).count() == retrieval.cosine_topk(q, c.limit(0), 6, 0.3).count() == 0


def test_what_leaves_a_block_is_bounded():
    rng = np.random.default_rng(9)
    s = rng.integers(0, 5, (8, 400)) / 5
    i, j = vectors.best_of(s, s >= 0.2, np.arange(400) % 3, np.arange(400), 4)
    assert len(i) <= 8 * 3 * 4 and (np.bincount(i * 3 + j % 3) <= 4).all()


def test_no_query_on_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def none(*_):
        raise AssertionError("rows on the driver")

    q = spark.range(3000).selectExpr("id AS query_id", "'a' AS brand", "array(cast(1 + id % 7 AS double), 1D) AS vector")
    c = spark.range(50).selectExpr("id AS chunk_id", "'a' AS brand", "array(cast(1 + id % 5 AS double), 1D) AS vector")
    for name in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(type(q), name, none)
    retrieval.cosine_topk(q, c, 3, 0.3).write.format("noop").mode("overwrite").save()
    assert isinstance(q, DataFrame)
