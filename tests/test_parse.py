"""Parser cascade, category and timestamps on the fixture lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.plans.ingest import parse_raw_lines
from logweave.rules import REF_TS

# line, pattern, source, message, category
CASES = [
    ("Mar 04 06:07:08 lab-7 kernel[0]: disk quota reached, volume 3", "system", "lab-7:kernel[0]", "disk quota reached, volume 3", "kernel"),
    ("Mar 04 06:07:19 lab-7 loginwindow[88]: screen unlocked by owner", "system", "lab-7:loginwindow[88]", "screen unlocked by owner", "system"),
    ("Mar 04 06:08:01 lab-7 sshd[901]: Failed password for guest from 10.9.8.7", "system", "lab-7:sshd[901]", "Failed password for guest from 10.9.8.7", "auth"),
    ("Mar 05 21:40:12 lab-7 sudo[77]: ana : TTY=pts3 ; USER=root", "system", "lab-7:sudo[77]", "ana : TTY=pts3 ; USER=root", "auth"),
    ("11:28:24.138308+0200 loginwindow[12] User session started", "console", "loginwindow[12]", "User session started", "auth"),
    ("11:28:24.138308+0200 sshd Failed password", "console", "sshd", "Failed password", "auth"),
    ("Mar 04 06:07:08 : no sender here", "generic", ":", "no sender here", "unknown"),
    ("Mar 04 06:09:00 lab-7 : sender alone", "generic", "lab-7", ": sender alone", "unknown"),
    (": only a text is left", "fallback_now", ":", "only a text is left", "unknown"),
    ("Mar 39 26:71:88 lab-7 probe[5]: not a day", "fallback_now", "Mar", "39 26:71:88 lab-7 probe[5]: not a day", "unknown"),
    ("2024-01-09T06:10:11Z proxy[42]: 10.1.2.3 GET /status", "fallback_now", "2024-01-09T06:10", "11Z proxy[42]: 10.1.2.3 GET /status", "network"),
    ("[2024-01-09 06:11:45] ERROR: Storage write failed", "fallback_ts", "]", "ERROR: Storage write failed", "auth"),
    ("01/09/2024 06:12:45 app: started", "fallback_ts", "app", "started", "application"),
    ("some words without any time", "fallback_now", "some", "words without any time", "unknown"),
    ("word", "fallback_now", "unknown", "word", "unknown"),
    ("Mar 04 06:07:08 host link state changed", "generic", "host", "link state changed", "unknown"),
]


def _parse(spark, lines):
    df = spark.createDataFrame([("rl", i, l) for i, l in enumerate(lines)], "raw_log_id string, line_no long, line string")
    return {r.line_no: r for r in parse_raw_lines(df).collect()}


def test_cascade_fixture_table(spark):
    got = _parse(spark, [c[0] for c in CASES])
    for i, (line, pattern, source, message, category) in enumerate(CASES):
        r = got[i]
        assert r.valid, line
        assert (r.pattern, r.source, r.message, r.category) == (pattern, source, message, category), line


def test_timestamps(spark):
    got = _parse(spark, [
        "Jan 15 10:30:45 h p[1]: m",          # syslog, reference year
        "Dec 31 23:00:00 h p[1]: m",          # > ref + 1 day -> previous year
        "11:28:24.138308+0200 proc msg",      # console: ref date - 2 h, > ref + 2 h -> day before
        "23:30:00.000000+0000 proc msg",      # > ref + 2 h -> previous day
        "2024-01-15 10:31:45 app: x",
        "01/15/2024 10:30:45 app: x",
        "Feb 30 10:00:00 h p: m",             # invalid day -> fallback, ts = ref
    ])
    assert got[0].timestamp == dt.datetime(2024, 1, 15, 10, 30, 45)
    assert got[1].timestamp == dt.datetime(2023, 12, 31, 23, 0, 0)
    assert got[2].timestamp == dt.datetime(2024, 1, 30, 9, 28, 24, 138308)
    assert got[3].timestamp == dt.datetime(2024, 1, 30, 23, 30, 0)
    assert got[4].timestamp == dt.datetime(2024, 1, 15, 10, 31, 45)
    assert got[5].timestamp == dt.datetime(2024, 1, 15, 10, 30, 45)
    assert got[6].timestamp == REF_TS and got[6].pattern == "fallback_now"


def test_future_syslog_is_failed_line(spark):
    # within (ref + 6 h, ref + 1 day]: stays in the reference year and fails the 6 h guard
    got = _parse(spark, ["Jan 31 12:00:00 h p[1]: m"])
    assert not got[0].valid


def test_message_control_chars_removed(spark):
    got = _parse(spark, ["Jan 15 10:30:45 h p[1]: a\x07b\x01c "])
    assert got[0].message == "abc"
