"""Rolling account features against plain loops."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dialoom.operators.rolling import rolling_features

START = dt.datetime(2024, 3, 1)
SCHEMA = "id int, who string, ts timestamp, v double, at int, n string"


def rows_of(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        who = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        ts = START + dt.timedelta(seconds=rng.randrange(90 * 86400), microseconds=rng.choice([0, 1, 999999]))
        if i % 17 == 0 and rows:        # exact copies, events of one time, and events a whole number of days apart
            ts = (rows[-1][2] or START) + dt.timedelta(days=rng.choice([0, 0, 1, 7, 30]))
        rows.append((i, who, ts if i % 41 else None, rng.choice([round(rng.uniform(-50, 900), 2), None]) if i % 9 == 0 else round(rng.uniform(-50, 900), 2)))
    rows[4] = (*rows[4][:3], float("nan"))
    rows[5] = (*rows[5][:3], 1e17)
    return rows


def brute(rows, days):
    out = {}
    for i, who, ts, v in rows:
        if ts is None:
            out[i] = None
            continue
        mine = [r for r in rows if r[1] == who and r[2] is not None]
        found = []
        for d in days:
            frame = [r[3] for r in mine if ts - dt.timedelta(days=d) <= r[2] <= ts]
            values = [x for x in frame if x is not None and abs(x) < 1e12]
            found += [len(frame), sum(values) / len(values) if values else None, statistics.pstdev(values) if values else None]
        past = [r[3] for r in mine if r[2] < ts]
        values = [x for x in past if x is not None and abs(x) < 1e12]
        mean = sum(values) / len(values) if values else None
        out[i] = [*found, len(past), mean, v - mean if mean is not None and v is not None else None, ts.hour, ts.isoweekday()]
    return out


@pytest.mark.parametrize("width", [None, 3_600_000_000, 86_400_000_000 * 50])
def test_features_by_brute_force(spark, width):
    rows = rows_of(900)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    days = (1, 7, 30)
    got = {r.id: r for r in rolling_features(df, "who", "ts", "v", days, width=width).collect()}
    assert len(got) == len(rows)
    for i, want in brute(rows, days).items():
        r = got[i]
        have = [r[f"{p}_{d}d"] for d in days for p in ("n", "mean", "std")] + [r.history_n, r.history_mean, r.deviation, r.hour, r.weekday]
        if want is None:
            assert have == [None] * len(have)
            continue
        for a, b in zip(have, want):
            assert (a is None) == (b is None) and (b is None or a == pytest.approx(b, abs=1e-5, nan_ok=True)), (i, have, want)


def test_a_hot_account_is_spread(spark):
    """No task of the window holds more than a few blocks of an account with all rows."""
    df = spark.range(20_000).select(F.lit("hot").alias("who"), (F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit(1.0).alias("v"))
    out = rolling_features(df, "who", "ts", "v", (1,), width=60_000_000 * 100)
    assert out.agg(F.min("n_1d"), F.max("n_1d"), F.max("std_1d")).first() == (1, 1441, 0.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("account") for line in plan.split("\n") if "Window" in line and "place" in line] and "block" in plan


def test_tasks_follow_the_events(spark, monkeypatch):
    """Every shuffle of points has as many tasks as the points need, so none grows with the table; null accounts and times stay."""
    from dialoom.operators import rolling

    monkeypatch.setattr(rolling, "TASK_ROWS", 100)
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("who"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit(1.0).alias("v"))
    out = rolling_features(df, "who", "ts", "v", (1,))
    # 980 points, each with itself and two probes
    assert out._jdf.queryExecution().optimizedPlan().toString().count(", 30") == 4
    assert out.count() == 1000 and out.filter("n_1d IS NULL").count() == 20 and out.filter("who IS NULL").agg(F.max("n_1d")).first()[0] > 300


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rolling_features(df, "who", "ts", "v").count() == 0
    df = spark.createDataFrame([(1, None, None, None, 1, "x")], SCHEMA)
    assert rolling_features(df, "who", "ts", "v").first().n_1d is None
