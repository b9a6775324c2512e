"""Replacement by brand: readers see a whole commit or the one before."""

import pytest

from lodestack.sources import store, tables


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("brand_slug", "doc_id", "text").collect())


def test_failed_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    make = lambda *r: spark.createDataFrame(list(r), "brand_slug string, doc_id long, text string")
    assert tables.read_chunks(spark, path) is None
    tables.write_chunks(make(("a/b {1}", 1, "x"), ("b", 2, "y"), (None, 3, "z"), ("07", 4, "w")), path)
    old = [("07", "4", "w"), ("None", "3", "z"), ("a/b {1}", "1", "x"), ("b", "2", "y")]
    assert rows(tables.read_chunks(spark, path)) == old
    reader = tables.read_chunks(spark, path)
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.write_chunks(make(("b", 5, "new")), path)
    assert rows(tables.read_chunks(spark, path)) == old
    monkeypatch.setattr(store, "_publish", publish)
    for _ in range(2):  # repeated, it is the same
        tables.write_chunks(make(("b", 5, "new")), path)
        assert rows(tables.read_chunks(spark, path)) == [r for r in old if r[0] != "b"] + [("b", "5", "new")]
    assert rows(tables.read_chunks(spark, path, "b")) == [("b", "5", "new")]
    assert rows(reader) == old  # what was opened before stays readable
    assert store.tidy(spark, path, keep=1) > 0
    assert rows(tables.read_chunks(spark, path)) == [r for r in old if r[0] != "b"] + [("b", "5", "new")]
    plan = tables.read_chunks(spark, path, "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(brand_slug" in plan


def test_two_writers_and_touched_brands(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "brand_slug string, doc_id long")
    assert store.commit(spark, path, {"t": df, "u": df}, writer="w", batch=4)
    assert not store.commit(spark, path, {"t": df}, writer="w", batch=4)
    assert store.commit(spark, path, {"t": df.where("false")}, touched=["a", "c"], writer="w", batch=5)
    assert [r["doc_id"] for r in store.read(spark, path, "t").collect()] == [2]
    assert store.read(spark, path, "t", 1).count() == store.read(spark, path, "u").count() == 2
    store.commit(spark, path, {"t": df.where("false")}, touched=["b"])
    assert store.read(spark, path, "t").count() == 0
    # Another writer takes the number first: the later one fails and can repeat.
    manifest = store.manifest
    monkeypatch.setattr(store, "manifest", lambda *a: (manifest(*a)[0] - 1, manifest(*a)[1]))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store.commit(spark, path, {"t": df})
    monkeypatch.setattr(store, "manifest", manifest)
    store.commit(spark, path, {"t": df})
    assert store.read(spark, path, "t").count() == 2
