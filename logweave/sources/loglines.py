"""Log-line view over the driver's ``events`` table.

The driver tables hold no log text, so this module renders each event as one
log line in one of the formats the parser knows. It only produces input rows
``(event_id, user_id, event_type, value, ts, raw_log_id, line_no, line,
source_name, ingested_at)``; parsing, scoring and every query run on ``line``
through the library code and take nothing from how the line was made.

``line_no`` is the line's position inside its raw log: the event id, which
grows with the line order but is not dense. It needs no window (a row number
per raw log would put each raw log in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.tables import read_table

N_RAW_LOGS = 97


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def render_line(event_id: Column, ts: Column, user_id: Column, event_type: Column, value: Column) -> Column:
    """One log line per event (see FIXTURES.md section 2 for the table)."""
    syslog_ts = F.date_format(ts, "MMM dd HH:mm:ss")
    host = F.concat(F.lit("host"), _s(user_id % 7))
    pid = _s(user_id + 1000)
    ip = F.concat(F.lit("10.0."), _s(event_id % 256), F.lit("."), _s(user_id % 256))
    head = F.concat(syslog_ts, F.lit(" "), host, F.lit(" "))
    return (
        F.when((event_type == "signup") & (value >= 100),
               F.concat(head, F.lit("sshd["), pid, F.lit("]: Failed password for user"), _s(user_id),
                        F.lit(" from "), ip, F.lit(" port 22 ssh2")))
        .when(event_type == "signup",
              F.concat(head, F.lit("sshd["), pid, F.lit("]: Accepted publickey for user"), _s(user_id),
                       F.lit(" from "), ip))
        .when((event_type == "error") & (event_id % 2 == 0),
              F.concat(head, F.lit("kernel[0]: Memory pressure warning panic")))
        .when(event_type == "error",
              F.concat(head, F.lit("securityd["), pid, F.lit("]: Malware attack signature detected")))
        .when(event_type == "click",
              F.concat(F.date_format(ts, "HH:mm:ss.SSSSSS"), F.lit("+0200 loginwindow["), pid,
                       F.lit("] User session started")))
        .when((event_type == "view") & (event_id % 10 == 0),
              F.concat(head, F.lit("link state changed")))
        .when(event_type == "view",
              F.concat(head, F.lit("networkd["), pid, F.lit("]: Firewall blocked connection from "), ip))
        .otherwise(
            F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" app"), _s(user_id % 5),
                     F.lit(": ERROR database connection timeout exception")))
    )


def event_log_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The lines of all events; ``events`` are those rows spread over tasks."""
    ev = read_table(spark, sf_dir, "events") if events is None else events
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.concat(F.lit("rl_"), _s(F.col("event_id") % N_RAW_LOGS)).alias("raw_log_id"),
        F.col("event_id").alias("line_no"),
        render_line(F.col("event_id"), F.col("ts"), F.col("user_id"), F.col("event_type"), F.col("value")).alias("line"),
        F.concat(F.lit("src"), _s(F.col("user_id") % 5)).alias("source_name"),
        F.col("ts").alias("ingested_at"),
    )


N_FORMAT_SOURCES = 40


def render_format_line(event_id: Column, ts: Column, user_id: Column, event_type: Column) -> Column:
    """One log line per event in the format of its source (FIXTURES.md
    section 5): syslog, ISO, US, epoch seconds, epoch milliseconds, Apache,
    delimited and plain; every tenth ISO line is a long line without a time."""
    utc = ts.cast("timestamp")
    app = F.concat(F.lit("app"), _s(user_id % 5))
    proc = F.concat(app, F.lit("["), _s(user_id + 100), F.lit("]: "))
    msg = F.concat(event_type, F.lit(" by user"), _s(user_id))
    kind = user_id % 8
    tail = F.concat(F.lit(" host"), _s(user_id % 7), F.lit(" "), proc, msg)
    return (
        F.when(kind == 0, F.concat(F.date_format(ts, "MMM dd HH:mm:ss"), tail))
        .when((kind == 1) & (event_id % 10 == 0), F.concat(F.repeat(F.lit("x"), F.lit(300)), F.lit(": "), F.repeat(F.lit("tail "), F.lit(200)), msg))
        .when(kind == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), app, F.lit(": "), msg))
        .when(kind == 2, F.concat(F.date_format(ts, "MM/dd/yyyy HH:mm:ss"), tail))
        .when(kind == 3, F.concat(_s(F.unix_seconds(utc)), tail))
        .when(kind == 4, F.concat(_s(F.unix_millis(utc)), tail))
        .when(kind == 5, F.concat(F.lit("["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200] "), proc, msg))
        .when(kind == 6, F.concat(event_type, F.lit("|"), app, F.lit("|"), _s(user_id), F.lit("|"), msg))
        .otherwise(msg)
    )


def format_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id", "ts", F.concat(F.lit("fmt"), _s(F.col("user_id") % N_FORMAT_SOURCES)).alias("source_name"),
        F.col("event_id").alias("line_no"),
        render_format_line(F.col("event_id"), F.col("ts"), F.col("user_id"), F.col("event_type")).alias("line"))
