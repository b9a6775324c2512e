"""Usage and business figures; `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab

DAYS = {"week": 7, "month": 30, "quarter": 90, "year": 365}
BUCKETS = {"week": (7, 1), "month": (4, 7), "quarter": (6, 15), "year": (12, 30)}


def change(now: Column, before: Column) -> Column:
    """Percent change; from nothing it is 100, or 0 if there still is nothing."""
    return F.when(before != 0, (now - before) / before * 100).when(now > 0, 100.0).otherwise(0.0)


def period_flags(ts: Column, now: str, days: int) -> tuple[Column, Column]:
    end = F.to_timestamp(F.lit(now))
    start, before = end - F.make_interval(days=F.lit(days)), end - F.make_interval(days=F.lit(2 * days))
    return (ts >= start) & (ts <= end), (ts >= before) & (ts < start)


def period_metrics(events: DataFrame, now: str, periods=DAYS) -> DataFrame:
    """One row for each period: events and their value now and in the period before, in one pass over the events."""
    ts, aggs = F.col("ts"), []
    for name, days in periods.items():
        cur, prev = period_flags(ts, now, days)
        aggs += [F.count_if(cur).alias(f"{name}_n"), F.count_if(prev).alias(f"{name}_p"), F.sum(F.when(cur, F.col("value"))).alias(f"{name}_v"), F.sum(F.when(prev, F.col("value"))).alias(f"{name}_w")]
    rows = [F.struct(F.lit(n).alias("period"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_p").alias("n_before"), F.round(F.coalesce(f"{n}_v", F.lit(0.0)), 4).alias("value"), F.round(change(F.col(f"{n}_n"), F.col(f"{n}_p")), 6).alias("change")) for n in periods]
    return events.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def queries_per_session(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """User messages of each session, one at least."""
    return messages.groupBy(session).agg(F.greatest(F.lit(1), F.count_if(F.col("role") == "user")).alias("queries"))


def plan_table(spark: SparkSession, plans=vocab.PLANS) -> DataFrame:
    return spark.createDataFrame([(k, p, n) for k, (p, n) in plans.items()], "plan string, price double, daily_limit int")


def plan_distribution(users: DataFrame, plans: DataFrame, plan: str) -> DataFrame:
    """Users and rounded percent of every plan, zeros kept; halves round up."""
    n = users.groupBy(F.col(plan).alias("plan")).agg(F.count(F.lit(1)).alias("n"))
    total = users.agg(F.count(F.lit(1)).alias("total"))
    rows = F.broadcast(plans).join(n, "plan", "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(total))
    return rows.select("plan", "n", F.floor(F.coalesce(F.col("n") * 100 / F.nullif("total", F.lit(0)), F.lit(0.0)) + 0.5).cast("long").alias("percent"))


def top_agents(sessions: DataFrame, agents: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n agents with most queries: summed before names are joined, so the join sees one row each."""
    sums = sessions.groupBy(key).agg(F.sum("queries").alias("queries")).join(agents, key, "left")
    return sums.select(key, F.coalesce("name", F.lit("default")).alias("name"), "queries").orderBy(F.desc("queries"), key).limit(n)


def revenue_by_method(users: DataFrame, plans: DataFrame, plan: str, method: str, active: Column) -> DataFrame:
    rows = users.where(active).join(F.broadcast(plans), F.col(plan) == F.col("plan"))
    return rows.groupBy(F.coalesce(method, F.lit("card")).alias("method")).agg(F.round(F.sum("price"), 2).alias("revenue"), F.count(F.lit(1)).alias("users"))


def bucket_series(events: DataFrame, now: str, period: str) -> DataFrame:
    """Counts in trailing buckets, zeros kept. Both ends count, so an event on a border is in two buckets.

    An event's bucket follows from its distance to `now`, so nothing is compared with every bucket.
    """
    n, days = BUCKETS[period]
    spark = events.sparkSession
    width = days * 86_400_000_000
    back = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("ts").cast("timestamp"))
    at = F.floor(back / F.lit(width)).cast("int")
    both = F.when((back % width == 0) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    counts = events.where((back >= 0) & (back <= n * width)).select(F.explode(both).alias("back")).where(F.col("back") < n).groupBy("back").agg(F.count(F.lit(1)).alias("k"))
    every = spark.range(n).select((n - 1 - F.col("id")).cast("int").alias("back"), F.col("id").cast("int").alias("bucket"))
    return F.broadcast(every).join(counts, "back", "left").select("bucket", F.coalesce("k", F.lit(0)).alias("n"))


class QuotaFold:
    """One user's windows, uses that counted and uses blocked, as events come in time order.

    A window opens with a use and lasts `span` microseconds; a use at its end or later opens the next. Uses beyond the
    limit are blocked and do not count; no limit blocks none; a refund in an open window takes one back, not below zero.
    """

    def __init__(self, span: int):
        self.span, self.limit = span, None
        self.start, self.windows, self.used, self.total, self.blocked, self.events = None, 0, 0, 0, 0, 0

    def add(self, at: np.ndarray, step: np.ndarray) -> None:
        """The next events of the user: a stretch of uses, or refunds, within a window is one step."""
        self.events += len(at)
        turns = np.r_[np.flatnonzero(np.diff(step > 0)) + 1, len(at)]
        i = 0
        while i < len(at):
            until = int(turns[np.searchsorted(turns, i, "right")])
            held = self.start is not None and at[i] - self.start < self.span
            if step[i] > 0 and not held:
                self.start, self.used = int(at[i]), 0
                self.windows += 1
                held = True
            j = min(until, int(np.searchsorted(at, self.start + self.span))) if held else until
            if step[i] > 0:
                fine = j - i if self.limit is None else min(j - i, max(0, self.limit - self.used))
                self.used, self.total, self.blocked = self.used + fine, self.total + fine, self.blocked + j - i - fine
            elif held:
                self.used = max(0, self.used - (j - i))
            i = j


def quota_windows(events: DataFrame, limits: DataFrame, user: str = "user_id", step: Column | None = None, hours: int = 24) -> DataFrame:
    """Per user of events: windows opened, uses that counted and uses blocked. limits: user, daily_limit (null: none).

    Events are dealt by user, sorted where they arrive (Spark spills what does not fit) and folded batch by batch with
    a few numbers for the user at hand, so one with a third of all events costs time, not memory. Of several limits of a
    user the largest holds. Events without a time are left out.
    """
    span = hours * 3_600_000_000
    none = F.lit(None).cast("long")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(user, at.alias("at"), F.col("event_id").cast("long").alias("id"), (F.lit(1) if step is None else step).cast("int").alias("step"), none.alias("daily_limit")).where(F.col("at").isNotNull())
    # A user's limit is the first of the sorted rows.
    first = limits.select(user, none.alias("at"), none.alias("id"), F.lit(0).alias("step"), F.col("daily_limit").cast("long"))
    dealt = rows.unionByName(first).repartition(user).sortWithinPartitions(user, F.col("at").asc_nulls_first(), "id", "daily_limit")
    schema = T.StructType([events.schema[user], *(T.StructField(c, T.IntegerType()) for c in ("windows", "used", "blocked"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, name, kind, done = None, None, None, []

        def told():
            columns = zip(*done, strict=True) if done else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *[pa.int32()] * 3], strict=True)], names=[user, "windows", "used", "blocked"])

        for batch in batches:
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = coded.dictionary.to_pylist()
            at, step = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            caps = batch.column(4)
            ends = np.r_[np.flatnonzero(np.diff(code)) + 1, len(code)] if len(code) else []
            i = 0
            for j in ends:
                own = None if code[i] < 0 else names[code[i]]
                if fold is None or own != name:
                    if fold is not None and fold.events:
                        done.append((name, fold.windows, fold.total, fold.blocked))
                    fold, name = QuotaFold(span), own
                while i < j and step[i] == 0:
                    fold.limit, i = caps[int(i)].as_py(), i + 1
                if i < j:
                    fold.add(at[i:j], step[i:j])
                i = j
            if len(done) >= 10_000:
                yield told()
                done.clear()
        if fold is not None and fold.events:
            done.append((name, fold.windows, fold.total, fold.blocked))
        if done:
            yield told()

    return dealt.mapInArrow(run, schema)


def credit_usage(used: Column, limit: Column) -> Column:
    return F.struct(F.when(limit > 0, F.least(F.lit(100.0), used / limit * 100)).otherwise(0.0).alias("percent"), F.greatest(F.lit(0), limit - used).alias("remaining"))


def user_search(users: DataFrame, term: str, *columns: str) -> DataFrame:
    return users.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.lower())))


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (id, email, plan) with new's plans where id or, failing that, email is equal; what matches neither is added."""
    by_id = new.select("id", F.col("plan").alias("p1"))
    known = old.select("id").distinct()
    rest = new.join(known, "id", "left_anti")
    by_mail = rest.groupBy("email").agg(F.max("plan").alias("p2"))
    rows = old.join(by_id, "id", "left").join(by_mail, "email", "left").select("id", "email", F.coalesce("p1", "p2", "plan").alias("plan"))
    added = rest.join(old.select("email").distinct(), "email", "left_anti").select("id", "email", "plan")
    return rows.unionByName(added)
