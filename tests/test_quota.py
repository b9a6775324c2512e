"""Daily quotas: the streaming fold against one event at a time."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from lodestack.operators import metrics


def by_hand(events, limits):
    """events: (id, user, time, step)."""
    out = {}
    for user in {e[1] for e in events}:
        start, windows, used, total, blocked = None, 0, 0, 0, 0
        for _, _, at, step in sorted((e for e in events if e[1] == user and e[2] is not None), key=lambda e: (e[2], e[0])):
            held = start is not None and at - start < timedelta(hours=24)
            if step < 0:
                used = max(0, used - 1) if held else used
                continue
            if not held:
                start, used, windows = at, 0, windows + 1
            fine = limits.get(user) is None or used < limits[user]
            used, total, blocked = used + fine, total + fine, blocked + (not fine)
        out[user] = windows, total, blocked
    return out


def test_fold_equals_event_by_event(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1)
    # User 0 has a third of all events; times repeat, some fall on the hour that ends a window.
    events = [(i, 0 if i % 3 == 0 else rng.choice([1, 2, 3, None]), t0 + timedelta(hours=rng.choice([i / 9, i // 24 * 12, rng.randrange(300)])), -1 if rng.random() < 0.2 else 1) for i in range(3000)]
    limits = {0: 3, 1: 0, 2: None, None: 2, 9: 5}
    rows = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, step int").repartition(5)
    lim = spark.createDataFrame(list(limits.items()), "user_id long, daily_limit int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # a user's events come in many batches
    try:
        got = {r["user_id"]: (r["windows"], r["used"], r["blocked"]) for r in metrics.quota_windows(rows, lim, step=F.col("step")).collect()}
        uses = metrics.quota_windows(rows.where("step > 0"), lim)
        only = {r["user_id"]: (r["windows"], r["used"], r["blocked"]) for r in uses.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == by_hand(events, limits)
    assert only == by_hand([e for e in events if e[3] > 0], limits)
    assert uses.columns == ["user_id", "windows", "used", "blocked"]
    assert metrics.quota_windows(rows.limit(0), lim).count() == 0


def test_a_long_stretch_is_one_step():
    fold = metrics.QuotaFold(86_400_000_000)
    fold.limit = 10
    at = np.arange(1_000_000, dtype=np.int64) * 864_000  # a day has 100,000 of them
    fold.add(at, np.ones(len(at), dtype=np.int32))
    assert (fold.windows, fold.total, fold.blocked) == (10, 100, 999_900)
