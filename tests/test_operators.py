"""Distributed helpers against brute force on small random inputs."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators.detect import sliding_count
from logweave.operators.health import map_diff
from logweave.operators.stats import upper_median
from logweave.operators.windows import row_number_at_scale, top_n


def _rows(n=400, seed=3):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [(f"id{i:04d}", rnd.choice(["hot", "hot", "hot", "a", "b"]),
             base + dt.timedelta(seconds=rnd.randrange(0, 3 * 3600)), rnd.randrange(0, 50)) for i in range(n)]


def test_sliding_count_crosses_chunks(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id string, k string, ts timestamp_ntz, v int")
    # chunks of 10 minutes, window of 5 minutes: many rows need the halo
    got = {r.id: r.c for r in sliding_count(df, ["k"], "ts", 300, chunk_s=600, name="c").collect()}
    for i, k, t, _ in rows:
        want = sum(1 for _, k2, t2, _ in rows if k2 == k and t - dt.timedelta(seconds=300) < t2 <= t)
        assert got[i] == want


def test_row_number_at_scale_matches_window(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id string, k string, ts timestamp_ntz, v int")
    got = {r.id: r.rn for r in row_number_at_scale(df, ["k"], ["ts", "id"], "rn", partitions=7).collect()}
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want
    got_all = {r.id: r.rn for r in row_number_at_scale(df, [], ["v", "id"], "rn", partitions=5).collect()}
    want_all = {i: n + 1 for n, i in enumerate(x[0] for x in sorted(rows, key=lambda r: (r[3], r[0])))}
    assert got_all == want_all


def test_top_n_per_group(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id string, k string, ts timestamp_ntz, v int")
    got = sorted((r.k, r.id) for r in top_n(df, 4, [F.col("ts").desc(), F.col("id").asc()], ["k"], salt_by=["id"], salts=5).collect())
    want = []
    for k in {r[1] for r in rows}:
        want += [(k, r[0]) for r in sorted([r for r in rows if r[1] == k], key=lambda r: (-r[2].timestamp(), r[0]))[:4]]
    assert got == sorted(want)


def test_upper_median(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id string, k string, ts timestamp_ntz, v int")
    got = {r.k: r.median_value for r in upper_median(df, "k", "v").collect()}
    for k in got:
        vals = sorted(r[3] for r in rows if r[1] == k)
        assert got[k] == vals[len(vals) // 2]


def test_map_diff(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4})], "o map<string,int>, n map<string,int>")
    assert df.select(map_diff(F.col("o"), F.col("n")).alias("d")).first().d == ["b", "c"]
