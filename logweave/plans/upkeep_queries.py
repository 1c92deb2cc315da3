"""Registered queries of pasted texts, file labels, custom recovery, run times,
cascades and expiry over all their tables, and single functions over rows
(S-02, S-05, X-03, A-32, U-03, U-07, U-08, F-05, F-12, F-29)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions import severity as sev
from logweave.functions.parse import any_time
from logweave.operators import detect, health
from logweave.plans import store
from logweave.plans.catalog import query
from logweave.plans.ingest import ingest_texts
from logweave.sources import files, relabel, sinks
from logweave.sources.loglines import event_log_lines
from logweave.sources.tables import read_table

# labels of sample files; the last one has no file
SAMPLE_LABELS = [("plain.log", "System Log", "documents as they are"), ("latin.txt", "Latin Log", "documents in Latin-1"),
                 ("absent.log", "Absent Log", "no file of this name")]
OWN_STRATEGIES = [("network_error", "escalate"), ("parsing_error", "skip")]


@query
def q_pasted_texts(spark, sf):
    """S-02: every conversation turn pasted under its role: raw logs, lines,
    lines that parse, and their characters."""
    turns = store.spread(read_table(spark, sf, "conversations")).select(F.col("text").alias("content"), F.col("role").alias("source"))
    return ingest_texts(turns).groupBy("source_label").agg(
        F.countDistinct("raw_log_id").alias("raw_logs"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query
def q_sample_logs(spark, sf):
    """S-05: sample files with the labels of a table."""
    have = files.list_files(spark, files.stage_odd_files(spark, sf))
    return files.labelled(have, spark.createDataFrame(SAMPLE_LABELS, "file_name string, source string, description string")).select(
        "file_name", "source", "description", "size_bytes", "found")


@query
def q_error_recovery_custom(spark, sf):
    """X-03: recovery actions with two classes' own strategies."""
    own = spark.createDataFrame(OWN_STRATEGIES, "error_class string, recovery_action string")
    return detect.classify_errors(relabel.error_records(spark, sf), overrides=own).select("id", "error_class", "recovery_action")


@query
def q_run_times(spark, sf):
    """A-32: per entry number, times of its runs, share of those that succeeded
    and share whose result was pushed on (not in need of sanitizing)."""
    r = relabel.processing_runs(spark, sf)
    n = F.count(F.lit(1))
    return r.groupBy("entry_id").agg(
        n.alias("runs"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"), F.round(F.count_if("success") / n, 6).alias("success_rate"),
        F.round(F.try_divide(F.count_if(F.col("success") & ~F.col("sanitized")), F.count_if("success")), 6).alias("push_rate"))


@query
def q_cascade_all(spark, sf):
    """U-07: raw log rl_5 deleted from all three written tables: rows left."""
    ev, an, raw = (sinks.fresh_path(spark, n) for n in ("events", "analysis", "raw_logs"))
    store.events(spark, sf).write.parquet(ev)
    store.analysis(spark, sf).write.parquet(an)
    lines = event_log_lines(spark, sf).groupBy("raw_log_id").agg(F.count(F.lit(1)).alias("lines"))
    lines.write.parquet(raw)
    logs = spark.createDataFrame([("rl_5",)], "raw_log_id string")
    gone = spark.read.parquet(ev).join(logs, "raw_log_id", "left_semi").select(F.col("id").alias("event_id"))
    out = None
    for name, rest in (("ai_analysis", sinks.rewrite_without(spark, an, gone, "event_id")),
                       ("events", sinks.rewrite_without(spark, ev, logs, "raw_log_id")),
                       ("raw_logs", sinks.rewrite_without(spark, raw, logs, "raw_log_id"))):
        one = rest.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table_name"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query
def q_entry_cleanup(spark, sf):
    """U-08: entries completed (or failed) more than a day before 2024-01-20
    deleted from a written table, and processing history older than 12 days;
    what is left of each."""
    t = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")
    entries, history = sinks.fresh_path(spark, "entries"), sinks.fresh_path(spark, "history")
    sinks.append_rows(relabel.queue_entries(spark, sf), entries, "created_at")
    sinks.append_rows(relabel.processing_runs(spark, sf), history, "ts")
    sinks.delete_where(spark, entries, F.col("completed_at") < t - F.make_dt_interval(F.lit(1)), "row_date")
    sinks.delete_where(spark, history, F.col("ts") < t - F.make_dt_interval(F.lit(12)), "row_date")
    left = spark.read.parquet(entries).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))
    runs = spark.read.parquet(history).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))
    return left.unionByName(runs.select(F.lit("history").alias("status"), "n", "oldest"))


@query
def q_line_times(spark, sf):
    """F-05: the time found in a line (console, system, ISO or US form)."""
    lines = event_log_lines(spark, sf, store.spread_events(spark, sf))
    return lines.select("event_id", any_time(F.col("line"), R.REF_TS).alias("found"))


@query
def q_severity_labels(spark, sf):
    """F-12: events per severity label."""
    label = sev.ui_severity_label(F.col("severity_score"))
    return store.scored_events(spark, sf).groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("severity_score").alias("low"), F.max("severity_score").alias("high"))


@query
def q_decoded_recommendations(spark, sf):
    """F-29: recommendations stored as JSON text (as plain text for every third
    event) decoded to a list."""
    stored = F.when(F.col("event_id") % 3 == 0, F.element_at("recommendations", 1)).otherwise(F.to_json("recommendations"))
    out = sev.decode_recommendations(stored)
    return store.scored_events(spark, sf).select("id", F.size(out).alias("n"), F.element_at(out, 1).alias("first"))


@query
def q_changed_keys(spark, sf):
    """U-03: keys whose value differs between two maps of every event."""
    e = read_table(spark, sf, "events")
    text = lambda c: c.cast("string")
    old = F.create_map(F.lit("type"), F.col("event_type"), F.lit("level"), text(F.col("event_id") % 3), F.lit("user"), text(F.col("user_id")))
    new = F.create_map(F.lit("type"), F.col("event_type"), F.lit("level"), text(F.col("event_id") % 2), F.lit("zone"), text(F.col("user_id")))
    return e.select("event_id", F.array_join(health.map_diff(old, new), ",").alias("changed"))
