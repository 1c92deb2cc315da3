"""Throttle: distributed plan against a brute-force sequential fold."""

import datetime as dt
import random

from logweave.operators.throttle import throttle


def _fold(rows, minutes):
    kept, last = [], {}
    for key, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or t >= last[key] + dt.timedelta(minutes=minutes):
            kept.append(i)
            last[key] = t
    return sorted(kept)


def test_fixture_case(spark):
    base = dt.datetime(2024, 1, 1)
    mins = [0, 3, 5, 9, 11, 14, 16, 30]
    rows = [("k", base + dt.timedelta(minutes=m), f"e{m:02d}", 10) for m in mins]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id string, m int")
    got = sorted(r.id for r in throttle(df, "key", "ts", "id", "m").collect())
    assert got == ["e00", "e11", "e30"]


def test_random_against_fold(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = rnd.choice(["hot", "hot", "hot", "a", "b"])
        rows.append((key, base + dt.timedelta(seconds=rnd.randrange(0, 6 * 3600)), f"id{i:04d}", 7))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id string, m int")
    got = sorted(r.id for r in throttle(df, "key", "ts", "id", "m").collect())
    assert got == _fold([(k, t, i) for k, t, i, _ in rows], 7)
