"""Exact dedup, hard negatives and whitening against plain Python and numpy on small rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import common, exact_dedup, hard_negatives, whitening

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").translate(UPPER).encode()).hexdigest()


def dedup_by_hand(rows):
    """(doc_id, keep_id, size, digest) of each row, and how many rows each text keeps."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[sha(text)].append(i)
    best = {d: max((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    return sorted((str(i), str(best[sha(t)]), len(groups[sha(t)]), sha(t)) for i, t in rows), groups


def test_exact_dedup(spark):
    texts = ["hot", "HOT", "hOt", "É", "é", "", None, "a b", "a  b", "x" * 100_000, "X" * 100_000]
    rows = [(i, "Hot" if i % 3 == 0 else texts[i % len(texts)] if i % 5 else f"only {i}") for i in range(3000)]
    rows += [(None, "hot"), (None, "null only"), (None, "null only"), (7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want, groups = dedup_by_hand(rows)
    for counters in (64, 8192):  # with few counters only the largest groups leave by the broadcast
        out = exact_dedup.classes(exact_dedup.digests(df), counters).collect()
        assert sorted((str(r["doc_id"]), str(r["xd_keep"]), r["xd_size"], bytes(r["xd_digest"]).hex()) for r in out) == want
        kept = [r for r in out if r["xd_kept"]]
        assert len(kept) == len(groups) == len({bytes(r["xd_digest"]) for r in kept})
        assert all(r["doc_id"] == r["xd_keep"] for r in kept)


def test_exact_dedup_names_the_frequent(spark):
    # Half of the rows have one digest, a tenth another: both are among the candidates of a small sketch.
    df = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'A' WHEN id % 10 = 1 THEN 'B' ELSE cast(id AS string) END AS text")
    rows = exact_dedup.digests(df)
    named = {r[0] for r in exact_dedup.frequent(rows, 64).collect()}
    assert len(named) <= 64
    hot = spark.createDataFrame([(sha(t),) for t in ("a", "b")], "d string").select(F.xxhash64(F.unhex("d")))
    assert {r[0] for r in hot.collect()} <= named


def test_exact_dedup_keeps_columns(spark):
    df = spark.createDataFrame([(1, "A", 1, "p"), (2, "a", 2, "q"), (None, "a", 3, None), (3, None, 4, "r")], "doc_id long, text string, xd_row int, xd_digest string")
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns and sorted((r["doc_id"], r["xd_row"]) for r in out.collect()) == [(2, 2), (3, 4)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.classes(exact_dedup.digests(df.limit(0))).count() == 0


def test_exact_dedup_stays_native(spark):
    out = exact_dedup.classes(exact_dedup.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def mined_by_hand(rows, is_anchor, k=5, low=80):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in {r[0] for r in rows if is_anchor(r[0])}:
        _, label, x = max(r for r in rows if r[0] == a)
        others = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, lab) for i, lab, y in rows if i != a and len(y) == len(x))
        for s, p, _ in [o for o in others if o[2] == label][:k]:
            fits = [o for o in others if o[2] != label and low * -s <= 100 * -o[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, o[1], -s, -o[0]) for n, o in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_hard_negatives(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(3)
    # Small numbers tie often; two rows repeat an anchor's id, others are left out or of another length.
    rows = [(int(i), int(rng.integers(3)) if rng.random() < 0.7 else 0, [int(v) for v in rng.integers(-2, 4, 6)]) for i in range(400)]
    rows += [(10, 1, [3] * 6), (10, 2, [1] * 6), (11, 2, [3] * 6), (11, 2, [3] * 6), (None, 1, [1] * 6), (12, None, [1] * 6), (13, 1, None), (14, 1, [1, None, 1, 1, 1, 1]), (500, 0, [2, 2]), (501, 0, [2, 2]), (502, 1, [2, 2]), (510, 0, []), (511, 0, []), (512, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<long>").withColumn("score", F.lit("clash")).repartition(5)
    if not broadcast:
        monkeypatch.setattr(hard_negatives, "few", lambda df: df)
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "HELD", 100)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    want = mined_by_hand(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and any(r[0] == 500 for r in want) and got == want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_products_are_exact():
    a, b = np.array([[(1 << 26) + 1, 3]]), np.array([[(1 << 26) + 1, 1], [5, -7]])
    assert hard_negatives.product(a, b).tolist() == [[((1 << 26) + 1) ** 2 + 3, 5 * ((1 << 26) + 1) - 21]]
    with pytest.raises(OverflowError):
        hard_negatives.product(a << 10, b)


def whitened_by_hand(x, most=4):
    """Eigenvalues over their trace and absolute values of the whitened rows, from an eigendecomposition of the covariance."""
    fit = np.unique(np.array(x, dtype=np.int64), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, e / np.trace(y.T @ y / n), np.abs(((n * np.array(x) - s) / n) @ v / np.sqrt(e)), [int(d) for d in ((n * np.array(x, dtype=object) - s) ** 2).sum(axis=1)]


def whiten(spark, x):
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    out = whitening.whiten(df, whitening.fit_whitening(df.select("x").distinct())).toPandas()
    return {c: g.sort_values("vec_id") for c, g in out.groupby("component")}


@pytest.mark.parametrize("kind", ["plain", "constant", "few", "scales", "dependent"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.integers(-250, 250, (300, 12)) * np.arange(1, 13)
    if kind == "constant":
        x[:, [2, 7]] = 9
    if kind == "few":
        x = x[:7]
    if kind == "scales":
        x = rng.integers(-250, 250, (300, 4)) * np.array([10**6, 1000, 10, 1])
    if kind == "dependent":
        x = np.c_[x[:, :5], x[:, :5] * 3, x[:, 0] - x[:, 1]]
    x = np.r_[x, x[:3], x[:1]]
    got = whiten(spark, x)
    n, explained, z, deviations = whitened_by_hand(x)
    assert sorted(got) == [1, 2, 3, 4]
    for c, g in got.items():
        assert set(g.n) == {n} and g.identity_error.max() < 1e-9
        fits = [d < 1 << 63 for d in deviations]
        assert g.deviation.notna().tolist() == fits and all(fits) == (kind != "scales")
        assert not all(fits) or g.deviation.tolist() == deviations
        assert np.allclose(g.explained, explained[c - 1], rtol=1e-9 if kind != "scales" else 1e-3)
        if kind != "scales":  # where an eigendecomposition of the covariance has enough digits itself
            assert np.allclose(np.abs(g.whitened), z[:, c - 1], atol=1e-7)


def test_whitening_keeps_small_components(spark):
    # Independent entries of known deviations 10^9, 10^6, 10^3 and 1: a covariance in double precision loses the last.
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(200, 5)) - 0)[0]
    x = np.rint(q[:, :4] * 14 * np.array([10.0**9, 10.0**6, 10.0**3, 100])).astype(np.int64)
    model = whitening.fit_whitening(spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "x array<long>"))[4]
    y = x - x.mean(axis=0)
    s = np.linalg.svd(y, compute_uv=False)
    assert np.allclose(np.sqrt(model.variances * model.n), s, rtol=1e-6) and model.identity_error < 1e-6


def test_whitening_edges(spark):
    rows = [(1, [1.0, 2.0]), (None, [2.0, 5.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5]), (8, [0.5]), (9, []), (10, [1.0, -0.001]), (11, [1.0, 2.0]), (12, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash"))
    x = common.quantised(df.select("vec_id", "embedding"))
    assert {r["vec_id"]: r["x"] for r in x.collect()}[10] == [256, -1]
    models = whitening.fit_whitening(x.select("x").distinct())
    out = whitening.whiten(x, models).collect()
    # One vector of a length has no extent; two of length 2 spread over two components.
    assert sorted((str(r["vec_id"]), r["component"]) for r in out) == sorted((i, c) for i in ("1", "None", "10", "11") for c in (1, 2))
    assert {r["n"] for r in out} == {3}
    assert whitening.whiten(x.limit(0), whitening.fit_whitening(x.limit(0).select("x"))).count() == 0
