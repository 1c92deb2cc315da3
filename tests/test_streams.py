"""Streams that lose nothing: merged windows, one parse stream with several
sinks, entries that overwrite, throttles with keyed state."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweave.operators import alerts as A
from logweave.operators.throttle import throttle
from logweave.plans.catalog import ALERT_RULES
from logweave.streaming import pipeline, side, throttled
from logweave.streaming.merge import MergeTable, sliding_counts
from logweave.streaming.stream import EVENTS_SCHEMA

BASE = dt.datetime(2024, 1, 1, 10)


def write(spark, folder, name, rows, schema=EVENTS_SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def event(i, minute, kind="login"):
    return (i, BASE + dt.timedelta(minutes=minute, seconds=i % 50), i % 9, kind, float(i), None)


# --- merged tables -------------------------------------------------------------

def test_sums_with_a_batch_run_twice_and_compaction(spark):
    t = MergeTable(spark, side.stream_root(spark, "sums"), "k string, n bigint", ["k"], sums=["n"])
    assert t.read().collect() == []
    put = lambda b, *rows: t.put(spark.createDataFrame(list(rows), "k string, n bigint"), b)
    put(0, ("a", 1), ("a", 2), ("b", 5))
    put(1, ("a", 10))
    put(1, ("a", 20))  # run again after a failure: replaces itself
    assert sorted(map(tuple, t.read().collect())) == [("a", 23), ("b", 5)]
    t.compact(every=2)
    assert t._parts() == [] and sorted(map(tuple, t.read().collect())) == [("a", 23), ("b", 5)]
    put(2, ("b", 1), ("c", None))
    t.compact(every=2)  # one batch only: nothing to do yet
    assert t._parts() == [2]
    put(3, ("c", 4))
    t.compact(every=2)
    assert sorted(map(tuple, t.read().collect())) == [("a", 23), ("b", 6), ("c", 4)]


def test_a_base_whose_write_did_not_end_is_not_read(spark):
    root = side.stream_root(spark, "broken")
    t = MergeTable(spark, root, "k string, n bigint", ["k"], sums=["n"])
    t.put(spark.createDataFrame([("a", 1)], "k string, n bigint"), 0)
    t._merged(t._stored(None)).write.parquet(f"{root}/base/upto=0")
    from logweave.plans.store import _fs
    fs, p = _fs(spark, f"{root}/base/upto=0/_SUCCESS")
    fs.delete(p, False)
    assert [tuple(r) for r in t.read().collect()] == [("a", 1)]


def test_last_row_overwrites_and_ttl_drops(spark):
    schema = "k string, at timestamp_ntz, v int"
    t = MergeTable(spark, side.stream_root(spark, "last"), schema, ["k"], order=["at", "v"], ts="at", ttl="INTERVAL 1 HOUR")
    rows = lambda *x: spark.createDataFrame([(k, BASE + dt.timedelta(minutes=m), v) for k, m, v in x], schema)
    t.put(rows(("a", 5, 1), ("a", 5, 2), ("b", 1, 1)), 0)
    t.put(rows(("a", 3, 9), ("c", 50, 1)), 1)  # an older row of a comes later: it doesn't overwrite
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("a", 2), ("b", 1), ("c", 1)]
    t.put(rows(("c", 62, 7)), 2)
    t.compact(every=1)
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("a", 2), ("c", 7)]


def test_sliding_counts_equal_counting_rows(spark):
    rnd = random.Random(3)
    times = [BASE + dt.timedelta(seconds=rnd.randrange(3600)) for _ in range(200)]
    per_minute = Counter(t.replace(second=0) for t in times)
    df = spark.createDataFrame([("x", m, n) for m, n in per_minute.items()], "k string, minute timestamp_ntz, n bigint")
    got = {r.window_start: r.n for r in sliding_counts(df, ["k"], "n").collect()}
    starts = {m - dt.timedelta(minutes=j) for m in per_minute for j in range(5)}
    assert got == {s: sum(s <= t < s + dt.timedelta(minutes=5) for t in times) for s in starts}


# --- one parse stream ----------------------------------------------------------

def counts(spark, root):
    return {n: pipeline.table(spark, root, n).count() for n in ("events", "analysis", "rejects", "rule_matches")}


def test_one_parse_stream_late_files_and_restart(spark):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "out")
    rules = A.rules_table(spark, ALERT_RULES)
    batches = {"a": [event(i, i % 30, "error") for i in range(40)],
               "b": [event(i, 120 + i % 20, "login") for i in range(40, 100)],
               "c": [event(i, 10 + i % 15, "error") for i in range(100, 130)]}  # comes two hours late
    write(spark, folder, "a", batches["a"])
    write(spark, folder, "b", batches["b"])
    run = lambda: pipeline.run_ingest(pipeline.arrivals(spark, folder, maxFilesPerTrigger=1), root, rules)
    run()
    first = counts(spark, root)
    assert first["events"] + first["rejects"] == 100 and first["analysis"] == first["events"]
    run()  # nothing new: nothing is parsed again
    assert counts(spark, root) == first
    write(spark, folder, "c", batches["c"])
    run()
    assert counts(spark, root)["events"] + counts(spark, root)["rejects"] == 130
    ids = [r.id for r in pipeline.table(spark, root, "events").select("id").collect()]
    assert len(ids) == len(set(ids))
    # windows and minutes hold every row, late ones and the last ones too
    ev = [(r.timestamp, r.category, r.message) for r in pipeline.table(spark, root, "events").collect()]
    errors = [t for t, c, _ in ev if c in pipeline.ERROR_CATEGORIES]
    got = {r.window_start: r.errors for r in pipeline.error_windows(spark, root).collect()}
    starts = {t.replace(second=0, microsecond=0) - dt.timedelta(minutes=k) for t in errors for k in range(5)}
    assert got == {s: sum(s <= t < s + dt.timedelta(minutes=5) for t in errors) for s in starts} and got
    logins = [t for t, _, m in ev if m.startswith("Failed password")]
    assert sum(r.attempts for r in pipeline.failed_login_windows(spark, root).collect()) == 5 * len(logins)
    rates = pipeline.component_minutes(spark, root).collect()
    assert sum(r.events for r in rates) == 130
    rows = [r for b in batches.values() for r in b]
    key = lambda r: (f"c{r[2] % 6}", r[1].replace(second=0))
    assert {(r.component, r.minute): r.events for r in rates} == Counter(map(key, rows))


def test_sinks_of_a_batch_that_runs_again(spark, monkeypatch):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "out")
    rules = A.rules_table(spark, ALERT_RULES)
    write(spark, folder, "a", [event(i, i % 30, "error") for i in range(40)])
    whole = MergeTable.put
    monkeypatch.setattr(MergeTable, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        pipeline.run_ingest(pipeline.arrivals(spark, folder), root, rules)
    monkeypatch.setattr(MergeTable, "put", whole)
    pipeline.run_ingest(pipeline.arrivals(spark, folder), root, rules)
    got = counts(spark, root)
    assert got["events"] + got["rejects"] == 40 and got["analysis"] == got["events"]


def test_entries_overwrite_over_batches(spark):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "out")
    for name, ids in (("a", range(0, 30)), ("b", range(60, 90)), ("c", range(30, 60))):
        write(spark, folder, name, [event(i, i) for i in ids])
    stream = side.arriving_events(spark, folder).select((F.col("event_id") % 7).cast("string").alias("entry"), "ts", "event_id")
    got = side.unique_entries(stream, root, key="entry", order=["ts", "event_id"], compact_every=2).collect()
    assert {r.entry: r.event_id for r in got} == {str(k): max(i for i in range(90) if i % 7 == k) for k in range(7)}


# --- throttles -----------------------------------------------------------------

SCHEMA = "id string, key string, kind string, at timestamp_ntz, gap int"


def alerts(n=300, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["hot", "hot", "hot", "a", "b"])
        gap = {"hot": 420, "a": 60, "b": 0}[key]
        rows.append((f"i{i:04d}", key, rnd.choice(["ok", "ok", "failure"]), BASE + dt.timedelta(seconds=rnd.randrange(6 * 3600)), gap))
    return rows


def plain(rows, bypass=()):
    sent, until = set(), {}
    for i, key, kind, at, gap in sorted(rows, key=lambda r: (r[3], r[0])):
        if not gap or kind in bypass:
            sent.add(i)
        elif key not in until or at >= until[key]:
            sent.add(i)
            until[key] = at + dt.timedelta(seconds=gap)
    return sent


@pytest.mark.parametrize("bypass", [(), ("failure",)])
def test_batch_throttle_in_seconds_with_bypass(spark, bypass):
    rows = alerts(500, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    out = throttle(df, "key", "at", "id", "gap", unit_seconds=1, bypass=F.col("kind").isin(*bypass) if bypass else None)
    assert {r.id for r in out.collect()} == plain(rows, bypass)


def test_stream_throttle_out_of_order_and_after_a_restart(spark):
    rnd = random.Random(6)
    rows = sorted(alerts(), key=lambda r: r[3] + dt.timedelta(seconds=rnd.randrange(3600)))  # up to an hour late
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "throttle")
    cut = [rows[k:k + 60] for k in range(0, len(rows), 60)]

    def run():
        stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))
        throttled.run(throttled.throttled(stream, key="key", ts="at", id_col="id", seconds="gap", delay="1 hour",
                                          bypass=F.col("kind") == "failure"), root)
    for k, part in enumerate(cut[:3]):
        write(spark, folder, f"p{k}", part, SCHEMA)
    run()
    half = throttled.decided_so_far(spark, root)
    seen = [r for part in cut[:3] for r in part]
    assert {r.id for r in half.where("sent").collect()} == plain(seen, ("failure",))
    assert half.count() == len(seen) and throttled.waiting(spark, root).where(F.size("times") > 0).count() > 0
    for k, part in enumerate(cut[3:], 3):
        write(spark, folder, f"p{k}", part, SCHEMA)
    run()  # started again on the same checkpoint
    got = throttled.decided_so_far(spark, root)
    assert got.count() == len(rows) and {r.id for r in got.where("sent").collect()} == plain(rows, ("failure",))


def test_state_of_an_open_key_is_dropped(spark):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "evict")
    at = lambda m: BASE + dt.timedelta(minutes=m)
    write(spark, folder, "a", [("x1", "x", "ok", at(0), 300), ("x2", "x", "ok", at(1), 300)], SCHEMA)
    write(spark, folder, "b", [("y1", "y", "ok", at(300), 300)], SCHEMA)
    write(spark, folder, "c", [("y2", "y", "ok", at(301), 300)], SCHEMA)
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))
    throttled.run(throttled.throttled(stream, key="key", ts="at", id_col="id", seconds="gap", delay="10 minutes"), root)
    assert throttled.waiting(spark, root).count() == 1  # y alone
    got = {r.id: r.sent for r in throttled.decided_so_far(spark, root).collect()}
    assert got == {"x1": True, "x2": False, "y1": True, "y2": False}
