"""Greedy chains against loops: ties, one key with a third of all events, pieces of any length, repeated rows, no rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators import chains

START = datetime.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def table(spark, seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, *range(2, 8)]), START + datetime.timedelta(minutes=r.choice([1, 30, 600]) * r.randrange(200)), i) for i in range(n)]
    rows += rows[:20] + [(None, START, 0)]
    return rows, spark.createDataFrame(rows, "k int, ts timestamp_ntz, i long").repartition(3)


@pytest.mark.parametrize("seed,piece", [(1, HOUR), (2, chains.DAY), (3, 30 * chains.DAY)])
def test_cooldown(spark, seed, piece):
    rows, df = table(spark, seed)
    want = []
    for k in range(1, 8):
        last = None
        for t, _ in sorted({(t, i) for key, t, i in rows if key == k}):
            if last is None or t - last >= datetime.timedelta(hours=5):
                last = t
                want.append((k, t))
    assert sorted(tuple(x) for x in chains.cooldown(df.where("k is not null"), "k", "ts", "i", 5 * HOUR, piece).collect()) == sorted(want)


@pytest.mark.parametrize("seed,n,hours", [(4, 5, 9), (5, 2, 3), (6, 3, 200)])
def test_n_in_a_window(spark, seed, n, hours):
    rows, df = table(spark, seed)
    want = []
    for k in range(1, 8):
        kept = []
        for t, _ in sorted({(t, i) for key, t, i in rows if key == k}):
            kept = [*kept, t][-n:]
            if len(kept) == n and t - kept[0] <= datetime.timedelta(hours=hours):
                want.append((k, kept[0], t))
                kept = []
    assert sorted(tuple(x) for x in chains.n_in_window(df.where("k is not null"), "k", "ts", "i", n, hours * HOUR).collect()) == sorted(want)


def test_nothing_fires_without_events(spark):
    _, df = table(spark, 0)
    assert chains.cooldown(df.limit(0), "k", "ts", "i", HOUR).count() == 0
    assert chains.n_in_window(df.where("i < 3"), "k", "ts", "i", 4, HOUR).count() == 0


def test_no_python_and_no_key_in_one_place(spark):
    """The plan sorts within (key, piece of time), and has no Python worker."""
    _, df = table(spark, 0)
    probes = df.select(F.col("k").alias("key"), chains.micros("ts").alias("t"), F.col("i").alias("s"))
    plan = chains.first_after(probes, probes.withColumn("item", F.col("s")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning(key" in plan and "_piece" in plan
