"""Sliding counts, partition bounds, source map, format registry and row
validation on small fixtures."""

import datetime as dt
import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import sanitize as T
from logweave.operators import detect as D
from logweave.operators import events as E
from logweave.operators import registry as FR
from logweave.operators import status as ST
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def test_sliding_count_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None]), T0 + dt.timedelta(seconds=rnd.randrange(600)), rnd.random() < 0.3)
            for i in range(400)] + [(400, "b", None, True)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, flag boolean")
    got = {r.id: (r.n, r.m) for r in D.sliding_count(df, ["k"], "ts", 60, name="n", parts={"m": F.col("flag")}).collect()}
    for i, k, t, _ in rows:
        if t is None:
            assert got[i] == (None, None)
            continue
        inside = [r for r in rows if r[1] == k and r[2] is not None and t - dt.timedelta(seconds=60) < r[2] <= t]
        assert got[i] == (len(inside), sum(r[3] for r in inside))


@pytest.mark.parametrize("build", [
    lambda ev: E.last_hours(ev, 48),
    lambda ev: E.filter_events(ev.withColumn("severity_score", F.lit(5)), start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 4)),
    lambda ev: ev.where(F.col("event_date") == F.lit(dt.date(2024, 1, 15))),
])
def test_time_filters_prune_partitions(spark, build):
    from logweave.plans import store

    plan = build(store.events(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_sources_of_files(spark):
    files = ["/logs/a/x.log", "/logs/a/b/y.log", "/logs/a/b/y.txt", "/logs/ab/z.log", "plain", "/logs/a/q[1].log"]
    sources = [("one", "file", "/logs/a/x.log", None), ("tree", "directory", "/logs/a/", None), ("logs", "directory", "/logs", "*.log"),
               ("odd", "directory", "/logs", "[!x]?.l*"), ("bare", "file", "plain", None), ("plus", "directory", "/logs", "x+.log")]
    f = spark.createDataFrame([(p,) for p in files], "path string")
    s = spark.createDataFrame(sources, "source_name string, source_type string, path string, file_pattern string")
    got = {tuple(r) for r in ST.match_sources(f, s).collect()}
    want = {(p, n) for p in files for n, kind, at, glob in sources
            if (kind == "file" and p == at) or (kind == "directory" and p.startswith(at.rstrip("/") + "/")
                                                and (glob is None or fnmatch.fnmatchcase(p.rsplit("/", 1)[-1], glob)))}
    assert got == want


def test_formats_of_mixed_sources(spark):
    lines = [("ap", i, f"[15/Jan/2024:10:30:{i:02d} +0200] httpd[{i}]: served a page number {i}") for i in range(12)]
    lines += [("pipe", i, f"a{i}|b|c|last {i}") for i in range(12)]
    lines += [("free", i, f"nothing here {i}") for i in range(3)] + [("free", 3, "x" * 300 + ": " + "t " * 500)]
    df = spark.createDataFrame(lines, "source_name string, line_no int, line string")
    best = FR.best_formats(FR.compose_formats(df))
    learned = best.where("source_name = 'pipe'")
    rows = {(r.source_name, r.line_no): r for r in FR.parse_with_formats(df, learned, best).collect()}
    assert len(rows) == len(lines)
    ap = rows["ap", 7]
    assert (ap.format_name, ap.method, ap.event_ts) == ("detected_apache_common", "auto_detection", dt.datetime(2024, 1, 15, 8, 30, 7))
    assert ap.source == "httpd" and ap.message == "served a page number 7"
    assert (rows["pipe", 3].method, rows["pipe", 3].message) == ("learned_pattern", "last 3")
    assert rows["free", 1].format_name == "generic_fallback"


@pytest.mark.parametrize("kind,text,want", [
    ("syslog", "Jan  5 10:30:45", dt.datetime(2024, 1, 5, 10, 30, 45)),
    ("iso_datetime", "2023-02-03 04:05:06", dt.datetime(2023, 2, 3, 4, 5, 6)),
    ("iso_with_ms", "2023-02-03 04:05:06.789", dt.datetime(2023, 2, 3, 4, 5, 6, 789000)),
    ("us_datetime", "02/03/2023 04:05:06", dt.datetime(2023, 2, 3, 4, 5, 6)),
    ("epoch_seconds", "1705314645", dt.datetime(2024, 1, 15, 10, 30, 45)),
    ("epoch_milliseconds", "1705314645123", dt.datetime(2024, 1, 15, 10, 30, 45, 123000)),
    ("apache_common", "[15/Jan/2024:10:30:45 -0130]", dt.datetime(2024, 1, 15, 12, 0, 45)),
    ("us_datetime", "13/45/2023 04:05:06", dt.datetime(2024, 1, 31)),
    ("syslog", None, dt.datetime(2024, 1, 31)),
])
def test_time_of_kind(spark, kind, text, want):
    df = spark.createDataFrame([(kind, text)], "k string, t string")
    assert df.select(FR.time_of_kind(F.col("k"), F.col("t"))).first()[0] == want


def test_source_and_analysis_checks(spark):
    names = ["  a  b ", "x'; DROP table y--rest", "/* c */", None, "z" * 300]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(T.sanitize_source(F.col("s"))).collect()]
    assert got == ["a b", "x y", "sanitized_source", "unknown_source", "z" * 255]
    rows = [("a", "e", 5, "long enough text", ["do this now"]), (" ", None, 11, "short", []), ("a", "e", 1, " ", ["okay then", "no"])]
    df = spark.createDataFrame(rows, "id string, ev string, sev int, ex string, rec array<string>")
    errors = [r[0] for r in df.select(T.analysis_errors(*[F.col(c) for c in df.columns])).collect()]
    assert errors[0] == []
    assert errors[1] == ["Analysis ID must be a non-empty string", "Event ID must be a non-empty string",
                         "Invalid severity score: Severity score must be between 1 and 10",
                         "Explanation too short (minimum 10 characters)", "Invalid recommendations: At least one recommendation is required"]
    assert errors[2] == ["Explanation cannot be empty", "Invalid recommendations: Recommendation 2 is too short (minimum 5 characters)"]
