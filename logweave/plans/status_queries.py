"""Registered queries of the status figures (``logweave.operators.status``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logweave.functions import sanitize as T
from logweave.operators import detect as D
from logweave.operators import events as E
from logweave.operators import status as ST
from logweave.operators.scoring import prompt_text, score_in_batches
from logweave.operators.windows import top_n
from logweave.plans import store
from logweave.plans.catalog import query
from logweave.sources import relabel, sinks
from logweave.sources.tables import read_table
from logweave.streaming import side

ERROR_CLASSES = [c for c, _ in D.ERROR_WORD_CLASSES] + [D.ERROR_DEFAULT_CLASS]


@query
def q_processing_state(spark, sf):
    """A-05: processed and pending events, hourly rate, mean time."""
    return ST.processing_state(relabel.processing_state(spark, sf), dt.datetime(2024, 1, 30, 12))


@query
def q_notification_rates(spark, sf):
    """A-06: sent, failed and pending notifications and their shares."""
    s = F.col("status")
    return ST.outcome_rates(relabel.notification_history(spark, sf), {k: s == k for k in ("sent", "failed", "pending")})


@query
def q_latest_metrics(spark, sf):
    """A-08/O-04: the 10 newest processing metrics."""
    m = relabel.processing_metrics(spark, sf)
    return top_n(m, 10, [F.col("timestamp").desc(), F.col("id").desc()]).select("id", "source_name", "metric_type", "metric_value", "timestamp")


@query
def q_run_outcomes(spark, sf):
    """A-14/A-32: success, failure, validation failure and sanitization rates."""
    r = relabel.processing_runs(spark, sf)
    return ST.outcome_rates(r, {"success": F.col("success"), "failure": ~F.col("success"),
                                "validation_failure": F.col("validation_failed"), "sanitization": F.col("sanitized")})


@query
def q_request_errors(spark, sf):
    """A-15: requests and the error rate over all endpoints."""
    return ST.outcome_rates(relabel.access_log(spark, sf), {"error": F.col("status") >= 500})


@query
def q_error_rates(spark, sf):
    """A-21: recovery and critical shares of the error records."""
    return ST.error_rates(D.classify_errors(relabel.error_records(spark, sf)))


@query
def q_spike_classes(spark, sf):
    """A-23: the dominant error class at every spike (more than 5 errors in 12 hours)."""
    e = D.classify_errors(relabel.error_records(spark, sf))
    return ST.spike_classes(e, ERROR_CLASSES, window_s=43200, max_errors=5)


@query
def q_general_recommendations(spark, sf):
    """A-27: the general lines of the report over all scored events."""
    return ST.general_recommendations(store.scored_events(spark, sf))


@query
def q_delivery_outcomes(spark, sf):
    """A-31: channels that took and that failed, per notification type and day."""
    n = relabel.notification_history(spark, sf).where(F.col("status") != "pending").withColumn(
        "event_id", F.concat_ws("|", "notification_type", F.date_format("sent_at", "yyyy-MM-dd")))
    out = ST.delivery_outcomes(n, ok=F.col("status") == "sent")
    return out.select("event_id", F.array_join("successful_channels", ",").alias("successful_channels"),
                      F.array_join("failed_channels", ",").alias("failed_channels"))


@query
def q_entry_status(spark, sf):
    """A-34: attempts, last result and errors of every entry."""
    return ST.entry_status(relabel.processing_runs(spark, sf), "entry_id", "ts", "id", "success", "n_errors")


@query
def q_diagnostic_history(spark, sf):
    """A-35: the last 10 diagnostic runs."""
    d = ST.diagnostic_history(relabel.diagnostic_runs(spark, sf), "ts", "run_id")
    return d.withColumn("failed_components", F.array_join("failed_components", ","))


@query
def q_component_metrics(spark, sf):
    """W-05: trailing rate, last-100 latency and error rate per component."""
    c = relabel.component_samples(spark, sf).withColumn("is_error", F.col("event_type") == "error")
    return ST.component_metrics(c)


@query
def q_violation_steps(spark, sf):
    """W-07: 10-minute request counts per client with the 5 and 20 steps."""
    return ST.violation_steps(relabel.access_log(spark, sf), "client").select("id", "requests_10m", "suspicious", "blocked")


@query
def q_host_trends(spark, sf):
    """W-13: CPU and memory trend over the last 10 samples per component."""
    return ST.host_trends(relabel.host_samples(spark, sf), "component", "ts", ["cpu_usage", "memory_usage"])


@query
def q_component_checks(spark, sf):
    """F-32: source, connection and processing checks per component over its
    samples, and the worst of them."""
    n = relabel.host_samples(spark, sf).groupBy("component").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("cpu_usage") > 30).alias("hot"),
        F.count_if(F.col("processing_rate").isNull()).alias("lost"), F.avg("processing_rate").alias("ms"))
    checks = n.select(
        "component", ST.sources_check(F.col("hot"), F.col("total")).alias("sources"),
        ST.connections_check(F.col("total"), F.col("hot"), F.col("total"), F.col("lost")).alias("connections"),
        ST.pipeline_check(100.0 * (F.col("total") - F.col("lost")) / F.col("total"), F.col("ms"), F.col("hot")).alias("pipeline"))
    return checks.withColumn("worst", ST.worst(F.col("sources"), F.col("connections"), F.col("pipeline")))


@query
def q_performance_advice(spark, sf):
    """F-31: how often each advice line is given over all host samples."""
    h = relabel.host_samples(spark, sf)
    lines = ST.performance_advice(
        F.col("cpu_usage"), F.col("memory_usage"), F.col("cache_hit_rate"), F.col("queue_size") > 1400,
        F.col("batch_enabled"), F.col("memory_usage"), F.col("batch_enabled"), F.col("cpu_usage") / 100)
    return h.select(F.explode(lines).alias("advice")).groupBy("advice").agg(F.count(F.lit(1)).alias("n"))


@query
def q_resource_issues(spark, sf):
    """F-35: resource issues of the host samples per component."""
    h = relabel.host_samples(spark, sf)
    found = ST.resource_issues(h, F.col("memory_usage") * 100, F.col("cpu_usage"), F.col("cache_hit_rate") * 100)
    return found.groupBy("component", "issue").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.first("recommendations"), "; ").alias("advice"))


@query
def q_source_errors(spark, sf):
    """F-37: faults and cleaned tags of every configured source."""
    s = relabel.log_sources(spark, sf)
    bad = ST.source_errors(*[F.col(c) for c in ("source_name", "path", "source_type", "file_pattern", "recursive", "tags")])
    return s.select("source_id", F.array_join(bad, "; ").alias("errors"), F.array_join(ST.clean_tags(F.col("tags")), ",").alias("tags"))


@query
def q_source_repeats(spark, sf):
    """A-20: source names and paths configured twice."""
    return ST.repeated_values(relabel.log_sources(spark, sf), {
        "source_name": "Duplicate log source names found", "path": "Duplicate log source paths found"})


@query
def q_source_rollup(spark, sf):
    """A-18/P-22: enabled sources by state."""
    return ST.source_rollup(relabel.log_sources(spark, sf).where("enabled"))


@query
def q_sources_by_name(spark, sf):
    """O-05: log sources by name."""
    return relabel.log_sources(spark, sf).select("source_name", "source_id", "path", "enabled", "status").orderBy("source_name", "source_id")


@query
def q_file_sources(spark, sf):
    """S-10/J-08: the sources of every log file."""
    return ST.match_sources(relabel.log_file_paths(spark, sf), relabel.log_sources(spark, sf))


@query
def q_source_sanitize(spark, sf):
    """F-16 on every conversation turn taken as a source identifier."""
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.sanitize_source(F.col("text")).alias("source"))


@query
def q_analysis_validation(spark, sf):
    """F-19 on conversation turns taken as analysis rows."""
    a = relabel.analysis_candidates(spark, sf)
    bad = T.analysis_errors(*[F.col(c) for c in ("id", "event_id", "severity_score", "explanation", "recommendations")])
    return a.select("conv_id", "turn", F.array_join(bad, "; ").alias("errors"))


@query
def q_orphan_notifications(spark, sf):
    """J-05: notifications whose event is not among the stored ones."""
    kept = store.events(spark, sf).where(F.col("category") != "kernel").select("event_id")
    return relabel.notification_history(spark, sf).join(kept, "event_id", "left_anti").select("id", "event_id", "channel")


@query
def q_nested_events(spark, sf):
    """P-08: events with their analysis as a nested struct (null where there
    is none)."""
    v = E.nested_view(E.with_analysis(store.events(spark, sf), store.analysis(spark, sf)))
    return v.select("id", F.col("ai_analysis").isNotNull().alias("analyzed"), F.col("ai_analysis.severity_score").alias("severity_score"),
                    F.size("ai_analysis.recommendations").alias("n_recommendations"))


@query
def q_raw_log_store(spark, sf):
    """S-03: every document stored as a raw log and read back: logs, distinct
    ids and characters per source."""
    path = sinks.fresh_path(spark, "raw_logs")
    at = (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("doc_id").cast("int") % 7)).cast("timestamp_ntz")
    docs = read_table(spark, sf, "documents").withColumn("created_at", at)
    sinks.store_raw_logs(docs, path, ["doc_id"], content="text")
    return spark.read.parquet(path).groupBy("source", "created_date").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length("content")).alias("chars"))


@query
def q_outcome_log(spark, sf):
    """S-11/S-12: notification outcomes and audit rows appended batch by batch
    (failed deliveries, then the others) and read back per day."""
    path = sinks.fresh_path(spark, "outcomes")
    n = relabel.notification_history(spark, sf)
    for batch in (n.where(F.col("status") == "failed"), n.where(F.col("status") != "failed")):
        sinks.append_rows(batch, path, "sent_at")
    a = sinks.fresh_path(spark, "audit")
    sinks.append_rows(relabel.audit_logs(spark, sf), a, "timestamp")
    out = spark.read.parquet(path).groupBy("row_date").agg(F.count(F.lit(1)).alias("outcomes"), F.count_if(F.col("status") == "failed").alias("failed"))
    audit = spark.read.parquet(a).groupBy("row_date").agg(F.count(F.lit(1)).alias("audit_rows"))
    return out.join(audit, "row_date")


@query
def q_security_export_files(spark, sf):
    """S-08/S-13: the security events of 30 days exported as JSON and as text
    and read back."""
    ev = E.security_events(E.last_hours(store.events(spark, sf), 24 * 30)).select("id", "process", "message")
    as_json, as_text = sinks.fresh_path(spark, "json"), sinks.fresh_path(spark, "text")
    sinks.export_json(ev, as_json)
    sinks.export_text(ev, as_text, F.concat_ws(" ", "id", "message"))
    back = spark.read.schema("id string, process string, message string").json(as_json)
    lines = spark.read.text(as_text).select(F.substring_index("value", " ", 1).alias("id"), F.length("value").alias("line_chars"))
    return back.join(lines, "id")


@query
def q_retention_apply(spark, sf):
    """U-06: metrics older than 20 days, notifications older than 25 and events
    older than 28 (with their analyses) deleted from written tables at
    2024-01-31; rows and days left in each."""
    ref = F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")
    times = store.events(spark, sf).select(F.col("id").alias("event_id"), "timestamp")
    an = store.analysis(spark, sf).join(times.hint("merge"), "event_id")  # neither side is small
    left = None
    for name, rows, ts, days in [("processing_metrics", relabel.processing_metrics(spark, sf), "timestamp", 20),
                                 ("notification_history", relabel.notification_history(spark, sf), "sent_at", 25),
                                 ("events", store.events(spark, sf).drop("event_date"), "timestamp", 28),
                                 ("ai_analysis", an, "timestamp", 28)]:
        path = sinks.fresh_path(spark, name)
        sinks.append_rows(rows, path, ts)
        sinks.delete_where(spark, path, F.col(ts) < ref - F.make_dt_interval(F.lit(days), F.lit(5)), "row_date")
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("row_date").alias("days_left"))
        one = one.select(F.lit(name).alias("table_name"), "kept", "days_left")
        left = one if left is None else left.unionByName(one)
    return left


@query
def q_cascade_apply(spark, sf):
    """U-07: raw log rl_5 deleted with its events and their analyses from
    written tables; rows left in each, per table and raw log."""
    ev, an = sinks.fresh_path(spark, "events"), sinks.fresh_path(spark, "analysis")
    store.events(spark, sf).write.parquet(ev)
    store.analysis(spark, sf).write.parquet(an)
    logs = spark.createDataFrame([("rl_5",)], "raw_log_id string")
    gone = spark.read.parquet(ev).join(logs, "raw_log_id", "left_semi").select(F.col("id").alias("event_id"))
    kept_an = sinks.rewrite_without(spark, an, gone, "event_id")
    kept_ev = sinks.rewrite_without(spark, ev, logs, "raw_log_id")
    of = F.substring_index("event_id", ":", 1)
    return (kept_ev.groupBy("raw_log_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("table_name"), "raw_log_id", "n")
            .unionByName(kept_an.groupBy(of.alias("raw_log_id")).agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("ai_analysis").alias("table_name"), "raw_log_id", "n")))


@query
def q_session_cleanup(spark, sf):
    """U-08: sessions expired at 2024-01-15 12:00 deleted from a written table;
    the sessions left per role."""
    path = sinks.fresh_path(spark, "sessions")
    sinks.append_rows(relabel.user_sessions(spark, sf), path, "created_at")
    sinks.delete_where(spark, path, F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp_ntz") > F.col("expires_at"), "row_date")
    return spark.read.parquet(path).groupBy("role").agg(F.count(F.lit(1)).alias("sessions"), F.min("created_at").alias("oldest"))


def _arriving(spark, sf):
    return side.arriving_events(spark, side.stage_event_files(spark, sf))


@query
def q_stream_side_outputs(spark, sf):
    """T-13: streamed error records in the table of their recovery action."""
    return side.route_errors(side.error_stream(_arriving(spark, sf)), side.stream_root(spark, "side")).select(
        "id", "error_class", "error_severity", "recovery_action")


@query
def q_stream_unique_entries(spark, sf):
    """T-14: streamed entries, one per id (client and hour): the newest event
    of each overwrites the others."""
    e = _arriving(spark, sf).select(F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH")).alias("entry_id"),
                                    F.col("ts").alias("at"), "event_id")
    return side.unique_entries(e, side.stream_root(spark, "entries"), key="entry_id", order=["at", "event_id"],
                               compact_every=2).select("entry_id", F.col("event_id").alias("last_event"))


@query
def q_stream_late_rows(spark, sf):
    """Late and timely rows of a stream whose files come out of order, per day."""
    out = side.split_late(_arriving(spark, sf), side.stream_root(spark, "late"))
    return out.groupBy(F.to_date("ts").alias("day"), "late").agg(F.count(F.lit(1)).alias("n"))


@query
def q_scorer_prompts(spark, sf):
    """F-10: the prompt of every event: its length and digest."""
    p = prompt_text(*[F.col(c) for c in ("timestamp", "source", "category", "message")])
    return store.events(spark, sf).select("id", F.length(p).alias("prompt_chars"), F.md5(p.cast("binary")).alias("prompt_md5"))


def _replies(rows):
    """Stand-in for an external scorer: wrapped, bare, broken and absent
    replies by the number at the end of an event's id, over the whole batch."""
    n = rows["id"].str.rsplit(":", n=1).str[-1].astype("int64")
    score = (n % 13).astype("string")
    bare = '{"severity_score": ' + score + ', "explanation": "scored outside by number", "recommendations": ["Look at it"]}'
    wrapped = '{"security_log_event": {"severity_score": ' + score + ', "explanation": "short"}}'
    return bare.where(n % 5 == 0, wrapped.where(n % 5 == 1, "no json at all")).where(n % 5 != 3, None).tolist()


@query
def q_scored_outside(spark, sf):
    """X-01/F-11: every event scored by an external scorer whose replies need
    repair or are missing, the rules where they are of no use."""
    ev = store.events(spark, sf).select("id", "timestamp", "source", "message", "category")
    out = score_in_batches(ev, _replies)
    return out.select("id", "analysis_method", "severity_score", "explanation", F.size("recommendations").alias("n_recommendations"))
