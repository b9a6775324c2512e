"""Streams with availableNow give what the batch jobs give."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestack.operators import metrics
from lodestack.sources import store, tables
from lodestack.streaming import jobs


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return df.sparkSession.table(name)


def test_stream_quota_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + timedelta(hours=5 * i), [2, 0, None][i % 3]) for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, daily_limit int")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run(jobs.stream_quota(stream), "quota").groupBy("user_id").agg(F.count_if("allowed").alias("used"), F.count_if(~F.col("allowed")).alias("blocked"))
    want = metrics.quota_windows(events.drop("daily_limit"), events.select("user_id", "daily_limit").distinct()).select("user_id", "used", "blocked")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def two_batches(spark, tmp_path, make, parts, name, **options):
    """What a stream makes of the parts, a file and a batch each, and its last progress."""
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(stream, **options).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name), [p for p in q.recentProgress if p.stateOperators]


def test_stream_quota_counts_late_events(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "event_id long, user_id long, ts timestamp, daily_limit int"
    first = [(1, 1, t0, 3), (2, 1, t0 + timedelta(hours=20), 3), (3, 2, t0, 1), (4, 1, t0 + timedelta(hours=25), 3)]
    # Late by 17 hours into a full day, and by 48: each belongs to the window of its own time.
    second = [(5, 1, t0 + timedelta(hours=8), 3), (6, 2, t0 + timedelta(hours=8), 1), (7, 1, t0 + timedelta(hours=50), 3), (8, 3, t0 + timedelta(hours=2), None)]
    parts = [spark.createDataFrame(r, schema) for r in (first, second)]
    got, progress = two_batches(spark, tmp_path, jobs.stream_quota, parts, "quota_late")
    assert len(progress) >= 2
    allowed = {r["event_id"]: r["allowed"] for r in got.collect()}
    assert allowed == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True}
    events = spark.createDataFrame(first + second, schema)
    want = metrics.quota_windows(events.drop("daily_limit"), events.select("user_id", "daily_limit").distinct())
    counts = got.groupBy("user_id").agg(F.count_if("allowed").alias("used"), F.count_if(~F.col("allowed")).alias("blocked"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.select("user_id", "used", "blocked").collect()))


def test_stream_quota_forgets(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    days = [[(i, i, t0 + timedelta(days=20 * i), 1)] for i in range(4)]
    parts = [spark.createDataFrame(r, "event_id long, user_id long, ts timestamp, daily_limit int") for r in days]
    _, progress = two_batches(spark, tmp_path, jobs.stream_quota, parts, "quota_state", sweep_ms=1)
    # A window of the newest user stays; those before the watermark are gone, their timers too.
    assert progress[-1].stateOperators[0].numRowsTotal < progress[0].stateOperators[0].numRowsTotal * 3


def test_stream_status_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    statuses = ["a", "a", "b", None, None, "b", "done", "a", "done", "b"]
    rows = [(i, i % 3, t0 + timedelta(minutes=i), statuses[(i // 3 + i % 3) % 10]) for i in range(30)]
    parts = [spark.createDataFrame(rows[a:b], "event_id long, user_id long, ts timestamp, status string") for a, b in ((0, 7), (7, 16), (16, 30))]
    for n, terminal in enumerate([(), ("done",)]):
        got, _ = two_batches(spark, tmp_path / str(n), jobs.stream_status, parts, f"status{n}", status="status", terminal=terminal)
        whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
        want = jobs.status_changes(whole, "user_id", "status", ["ts", "event_id"], terminal).select("user_id", "event_id", "status")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        if terminal:
            ends = {r["user_id"]: r["event_id"] for r in got.where("status = 'done'").collect()}
            assert set(ends) == {0, 1, 2} and all(r["event_id"] <= ends[r["user_id"]] for r in got.collect())


def test_stream_status_state_goes(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [[(1, 1, t0, "a"), (2, 1, t0 + timedelta(hours=1), "done"), (3, 1, t0 + timedelta(hours=2), "a")], [(4, 2, t0 + timedelta(days=9), "done")], [(5, 3, t0 + timedelta(days=19), "done")], [(6, 1, t0 + timedelta(days=29), "a")]]
    parts = [spark.createDataFrame(r, "event_id long, user_id long, ts timestamp, status string") for r in rows]
    got, progress = two_batches(spark, tmp_path, jobs.stream_status, parts, "status_state", status="status", terminal=("done",), sweep_ms=1)
    # Nothing after the end; long after it the key is new, as its mark has gone.
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 4, 5, 6]


def test_stream_dedupe(spark, tmp_path):
    names = spark.createDataFrame([("a", "X.pdf"), ("a", "x"), ("a", "Old"), ("b", "Old")], "brand string, name string")
    names.coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.createDataFrame([("a", "old.pdf")], "brand string, name string")
    stream = spark.readStream.schema(names.schema).parquet(str(tmp_path / "in"))
    got = run(jobs.stream_dedupe(stream, old, "name", "brand"), "dedupe")
    assert sorted((r["brand"], r["norm"]) for r in got.collect()) == [("a", "x"), ("b", "old")]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "n", 1, "some text"), ("b", 2, "m", 1, "other text")], "brand string, doc_id long, name string, page int, text string")
    path = str(tmp_path / "store")
    for k in range(2):
        pages.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(stream, path, str(tmp_path / "check")).awaitTermination(120)
        assert tables.read_chunks(spark, path).count() == 2
    assert [r["text"] for r in tables.read_chunks(spark, path, "a").collect()] == ["some text"]
    # A page that became empty, beside one that stays.
    empty = spark.createDataFrame([("a", 1, "n", 1, ""), ("a", 3, "n", 1, "third")], pages.schema)
    empty.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    jobs.stream_ingest(stream, path, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["text"] for r in tables.read_chunks(spark, path).collect()) == ["other text", "third"]


def test_status_changes(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None)], "id long, at long, status string")
    assert sorted((r["id"], r["at"]) for r in jobs.status_changes(rows, "id", "status", ["at"]).collect()) == [(1, 1), (1, 3), (2, 1)]


def _ingest(spark, tmp_path, rows, mode="append"):
    schema = "brand string, doc_id long, name string, page int, text string"
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    return jobs.stream_ingest(stream, str(tmp_path / "store"), str(tmp_path / "check"))


def _state(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("b", 9)], "brand_slug string, doc_id long")
    chunks = tables.read_chunks(spark, path)
    return sorted((str(r["brand_slug"]), r["doc_id"], r["text"]) for r in chunks.collect()) if chunks else [], {r["doc_id"]: r["status"] for r in tables.document_status(spark, path, docs).collect()}


@pytest.mark.parametrize("when", ["before the commit", "after the commit"])
def test_stream_ingest_survives_a_crash(spark, tmp_path, monkeypatch, when):
    assert _state(spark, tmp_path) == ([], dict.fromkeys([1, 2, 3, 4, 9], "pending"))
    _ingest(spark, tmp_path, [("a", 1, "n", 1, "one"), ("b", 3, "n", 1, "three")]).awaitTermination(120)
    before = [("a", 1, "one"), ("b", 3, "three")], {1: "indexed", 2: "pending", 3: "indexed", 4: "pending", 9: "pending"}
    assert _state(spark, tmp_path) == before
    publish = store._publish

    def broken(*args):
        if when == "after the commit":
            publish(*args)
        raise OSError("lost")

    monkeypatch.setattr(store, "_publish", broken)
    with pytest.raises(StreamingQueryException):
        _ingest(spark, tmp_path, [("a", 1, "n", 1, "one anew"), ("a", 2, "n", 1, ""), (None, 4, "n", 1, "four")]).awaitTermination(120)
    after = [("None", 4, "four"), ("a", 1, "one anew"), ("b", 3, "three")], {1: "indexed", 2: "error", 3: "indexed", 4: "indexed", 9: "pending"}
    # Both tables are as before or as after, never one of each.
    assert _state(spark, tmp_path) == (before if when == "before the commit" else after)
    monkeypatch.setattr(store, "_publish", publish)
    number = store.manifest(spark, str(tmp_path / "store"))[0]
    _ingest(spark, tmp_path, []).awaitTermination(120)
    assert _state(spark, tmp_path) == after
    assert store.manifest(spark, str(tmp_path / "store"))[0] == number + (when == "before the commit")
