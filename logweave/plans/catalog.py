"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (through the stored ingest output of
``logweave.plans.store`` or the relabelled views) and runs library
operators over all of it. Parameters are fixed here so results are
repeatable; ``ref_ts`` is the reference "now".
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.operators import events as E
from logweave.operators import stats as S
from logweave.operators.windows import top_n
from logweave.plans import store
from logweave.sources import relabel
from logweave.sources.loglines import event_log_lines
from logweave.sources.tables import read_table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _ev(spark, sf):
    return store.events(spark, sf)


def _scored(spark, sf):
    return store.scored_events(spark, sf)


def _an(spark, sf):
    return store.analysis(spark, sf)


def _joined(spark, sf):
    return E.with_analysis(*store.by_id(spark, sf))


# ------------------------------------------------------------------ parsing
@query
def q_parse_syslog(spark: SparkSession, sf: str) -> DataFrame:
    """P-02/P-03/F-01: events of the system/auth syslog forms."""
    return _ev(spark, sf).where(F.col("pattern").isin("system", "auth")).select(
        "id", "timestamp", "host", "process", "pid", "source", "message", "category")


@query
def q_parse_console(spark, sf):
    """P-02/F-02: console-form events (date from the reference day, UTC)."""
    return _ev(spark, sf).where(F.col("pattern") == "console").select(
        "id", "timestamp", "process", "pid", "source", "message", "category")


@query
def q_parse_fallback(spark, sf):
    """P-04/F-03: events found by the fallback (timestamp searched anywhere)."""
    return _ev(spark, sf).where(F.col("pattern").startswith("fallback")).select(
        "id", "pattern", "timestamp", "source", "message", "category")


@query
def q_parse_stats(spark, sf):
    """P-06: per raw log, total / parsed / failed lines and per-category counts."""
    p = store.parsed_lines(spark, sf)
    cats = [F.count_if(F.col("valid") & (F.col("category") == c)).alias(f"n_{c}") for c in R.CATEGORIES]
    return p.groupBy("raw_log_id").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if("valid").alias("parsed_events"),
        F.count_if(~F.col("valid")).alias("failed_lines"), *cats)


@query
def q_parse_rejects(spark, sf):
    """P-05: lines no format turned into a valid event."""
    return store.parsed_lines(spark, sf).where(~F.col("valid")).select("raw_log_id", "line_no", "line")


@query
def q_categorize_events(spark, sf):
    """F-06: events per (format, category)."""
    return _ev(spark, sf).groupBy("pattern", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def q_severity_score(spark, sf):
    """F-07: keyword hits and rule severity per event."""
    return _scored(spark, sf).select("id", "category", "keyword_hits", "severity_score")


@query
def q_explanation(spark, sf):
    """F-08."""
    return _scored(spark, sf).select("id", "explanation")


@query
def q_recommendations(spark, sf):
    """F-09 (joined as text for comparison)."""
    return _scored(spark, sf).select("id", F.array_join("recommendations", " | ").alias("recommendations_text"),
                                     F.size("recommendations").alias("n_recommendations"))


# ------------------------------------------------------------ event queries
@query
def q_events_with_analysis(spark, sf):
    """J-01/P-08: every event with its optional analysis."""
    return _joined(spark, sf).select("id", "category", "severity_score",
                                     F.col("analyzed_at").isNotNull().alias("has_analysis"))


@query
def q_events_page(spark, sf):
    """P-12/O-01/O-02: auth events from sshd sources, by severity, page 2."""
    f = E.filter_events(_joined(spark, sf), category="auth", source="sshd")
    return E.page(f, 2, 50, sort_by="severity").select(
        "id", "timestamp", "source", "category", "severity_score", "total", "total_pages")


@query
def q_events_keyset(spark, sf):
    """O-02 by position: the third page of 50 of all events by time, found
    from the last row of the second one and the events per day."""
    view = E.with_analysis(_ev(spark, sf), _an(spark, sf))
    days = store.day_counts(spark, sf)
    last = None
    for _ in range(2):
        last = E.last_position(E.page_after(view, 50, last, days=days))
    return E.page_after(view, 50, last, days=days).select("id", "timestamp", "category", "severity_score")


@query
def q_events_keyset_severity(spark, sf):
    """O-02 by position: the second page of 50 auth events by severity."""
    f = E.filter_events(_joined(spark, sf), category="auth")
    last = E.last_position(E.page_after(f, 50, None, sort_by="severity"), "severity")
    return E.page_after(f, 50, last, sort_by="severity").select("id", "timestamp", "category", "severity_score")


@query
def q_events_search(spark, sf):
    """P-14: free-text 'failed', severity >= 5 (missing = 0), to 2024-01-20."""
    s = E.search_events(_joined(spark, sf), "failed", 5, dt.date(2024, 1, 20))
    return s.select("id", "message", "severity_score")


@query
def q_events_min_severity(spark, sf):
    """J-02: severity bound on the outer-joined side (becomes inner)."""
    return E.filter_events(_joined(spark, sf), min_severity=7).select("id", "category", "severity_score")


@query
def q_event_detail(spark, sf):
    """P-15: one event by id with its analysis."""
    d = E.event_detail(_ev(spark, sf), _an(spark, sf), "rl_5:5")
    return d.select("id", "message", "category", "severity_score", "explanation")


@query
def q_original_line(spark, sf):
    """J-03: each event with its raw line."""
    return E.original_line(_ev(spark, sf), event_log_lines(spark, sf)).select("id", "line")


@query
def q_recent_export(spark, sf):
    """P-09: events of the last 48 hours."""
    return E.last_hours(_ev(spark, sf), 48).select("id", "timestamp", "source")


@query
def q_security_export(spark, sf):
    """P-10: security predicate over the last 30 days."""
    return E.security_events(E.last_hours(_ev(spark, sf), 24 * 30)).select("id", "process", "message")


@query
def q_process_export(spark, sf):
    """P-11: events of one process."""
    return E.process_events(_ev(spark, sf), "sshd").select("id", "message")


@query
def q_threat_summary(spark, sf):
    """P-20/A-12: per category, potential threats and normal events."""
    ev = _ev(spark, sf).withColumn("_t", E.threat_flag(F.col("message")))
    return ev.groupBy("category").agg(F.count_if("_t").alias("potential_threat"), F.count_if(~F.col("_t")).alias("normal"))


@query
def q_recent_suspicious(spark, sf):
    """P-21/P-07: of the last 10 events per source, the suspicious ones
    (up to 5), message cut to 100 characters."""
    r = E.recent_suspicious(_ev(spark, sf), 10, 5, partition="source_name")
    return r.select("source_name", "id", "timestamp", E.truncate_text(F.col("message"), 100).alias("message_short"))


@query
def q_old_event_analyses(spark, sf):
    """J-04: analyses of events older than 20 days (semi join)."""
    return E.analyses_of_old_events(_ev(spark, sf), _an(spark, sf), 20).select("analysis_id", "event_id")


@query
def q_orphan_analysis(spark, sf):
    """J-05: analyses whose event is gone. Stand-in: the events of source
    ids that are multiples of 50 are taken out of the event side."""
    parent = _ev(spark, sf).where(F.col("event_id") % 50 != 0)
    return E.orphans(_an(spark, sf), parent).select("analysis_id", "event_id")


@query
def q_latest_per_category(spark, sf):
    """W-01: the 3 newest events of each category."""
    return top_n(_ev(spark, sf), 3, [F.col("timestamp").desc(), F.col("id").asc()], ["category"],
                 salt_by=["id"], rank_col="rank").select("category", "rank", "id", "timestamp")


# ------------------------------------------------------------ aggregations
@query
def q_ingestion_stats(spark, sf):
    """A-01 over the ingested lines."""
    return S.ingestion_stats(event_log_lines(spark, sf))


@query
def q_top_sources(spark, sf):
    """A-02: lines per source label, top 10."""
    return S.top_counts(event_log_lines(spark, sf), "source_name", 10, "n")


@query
def q_table_counts(spark, sf):
    """A-03/U-01: row counts of the tables."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
             "pages", "benchmark", "labels", "conversations"]
    return S.table_counts({n: read_table(spark, sf, n) for n in names})


@query
def q_coverage(spark, sf):
    """A-04."""
    return S.coverage(_ev(spark, sf), _an(spark, sf))


@query
def q_realtime_stats(spark, sf):
    """A-05: totals, last 24 h, per hour, mean processing time (the
    source event value stands for the processing time)."""
    ev = _ev(spark, sf).join(read_table(spark, sf, "events").select("event_id", F.col("value").alias("processing_time")), "event_id")
    return S.realtime_stats(ev)


@query
def q_daily_summary(spark, sf):
    """A-10 over the joined view."""
    return S.daily_summary(_joined(spark, sf))


@query
def q_severity_histogram(spark, sf):
    """A-11."""
    return S.severity_histogram(_an(spark, sf))


@query
def q_category_counts(spark, sf):
    """A-12."""
    return _ev(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def q_high_severity_count(spark, sf):
    """A-13 over all analysed events in range."""
    return _an(spark, sf).agg(F.count_if(F.col("severity_score") >= R.HIGH_SEVERITY).alias("high_severity"),
                              F.count(F.lit(1)).alias("analyzed"))


@query
def q_top20_report(spark, sf):
    """O-03: top 20 for the report: severity desc (missing = 0), time asc."""
    j = _joined(spark, sf).where(F.col("event_date") == F.lit(dt.date(2024, 1, 15)))
    order = [F.coalesce(F.col("severity_score"), F.lit(0)).desc(), F.col("timestamp").asc(), F.col("id").asc()]
    return top_n(j, 20, order).select("id", "timestamp", "severity_score", "category")


@query
def q_top_recommendations(spark, sf):
    """A-27: most frequent recommendations, top 10."""
    return S.exploded_counts(_an(spark, sf), "recommendations", 10)


@query
def q_notification_metrics(spark, sf):
    """A-06: by status, by channel, by type and total in one pass (30 days)."""
    nh = E.last_hours(relabel.notification_history(spark, sf), 24 * 30, ts="sent_at")
    return S.grouping_sets_counts(nh, ["status", "channel", "notification_type"])


@query
def q_channel_stats(spark, sf):
    """A-07."""
    nh = relabel.notification_history(spark, sf)
    return S.rate_by(nh, "channel", F.col("status") == "sent", F.col("status") == "failed")


@query
def q_metric_summary(spark, sf):
    """A-08: metrics by source and by type plus total, last 7 days."""
    pm = E.last_hours(relabel.processing_metrics(spark, sf), 24 * 7)
    return S.grouping_sets_counts(pm, ["source_name", "metric_type"])


@query
def q_audit_stats(spark, sf):
    """A-09: totals, failures and success rate, by type and by severity."""
    a = relabel.audit_logs(spark, sf)
    g = S.grouping_sets_counts(a, ["event_type", "severity"], measure=F.when(~F.col("success"), 1).otherwise(0))
    return g.withColumnRenamed("measure", "failed").withColumn(
        "success_rate", F.round((F.col("n") - F.col("failed")) / F.col("n"), 6))


@query
def q_audit_top_users(spark, sf):
    """A-09: the 10 most active users (named ones only)."""
    a = relabel.audit_logs(spark, sf).where(F.col("username").isNotNull())
    return S.top_counts(a, "username", 10, "n")


@query
def q_endpoint_metrics(spark, sf):
    """A-15: per endpoint requests, errors, total and mean time."""
    al = relabel.access_log(spark, sf)
    return al.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.round(F.sum("duration"), 6).alias("total_time"), F.round(F.avg("duration"), 6).alias("avg_time"))


@query
def q_session_roles(spark, sf):
    """A-16: sessions still active at 2024-01-15 12:00 by role."""
    s = relabel.user_sessions(spark, sf)
    t = dt.datetime(2024, 1, 15, 12, 0, 0)
    act = s.where((F.col("expires_at") >= F.lit(t).cast("timestamp_ntz")) & (F.col("created_at") <= F.lit(t).cast("timestamp_ntz")))
    return act.groupBy("role").agg(F.count(F.lit(1)).alias("active_sessions"))


@query
def q_processing_time_stats(spark, sf):
    """A-14: per metric type avg/min/max and upper median of the values."""
    return S.upper_median(relabel.processing_metrics(spark, sf), "metric_type", "metric_value")


@query
def q_category_severity(spark, sf):
    """Flagship (entry): events per (category, severity) after parse + score."""
    return _scored(spark, sf).groupBy("category", "severity_score").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ alerts (J-*)
from logweave.operators import alerts as A  # noqa: E402
from logweave.operators import detect as D  # noqa: E402

# configuration: alert rules and channels (small tables, broadcast by size)
ALERT_RULES = [
    ("high_severity", True, 7, 10, [], [], ["email", "slack"], 10),
    ("auth_watch", True, 5, 10, ["auth"], [], ["email"], 5),
    ("kernel_watch", True, 1, 10, ["kernel"], [], ["webhook", "pager"], 0),
    ("sshd_host0", True, 1, 10, [], ["host0:sshd[1000]", "host0:sshd[1007]"], ["webhook"], 15),
    ("disabled_all", False, 1, 10, [], [], ["email"], 0),
]
CHANNELS = [("email", True), ("webhook", True), ("slack", False)]


def _matches(spark, sf):
    return A.match_rules(_joined(spark, sf), A.rules_table(spark, ALERT_RULES))


@query
def q_rule_match(spark, sf):
    """J-07: (event, rule) pairs of enabled matching rules."""
    return _matches(spark, sf).select("id", "rule_name")


@query
def q_rule_match_semi(spark, sf):
    """J-11: events any enabled rule matches."""
    return A.events_with_any_rule(_joined(spark, sf), A.rules_table(spark, ALERT_RULES)).select("id", "category")


@query
def q_channel_fanout(spark, sf):
    """J-09: matches x existing enabled channels."""
    return A.channel_fanout(_matches(spark, sf), A.channels_table(spark, CHANNELS)).select("id", "rule_name", "channel")


@query
def q_alert_text(spark, sf):
    """F-13/F-14: subject and body of each kernel_watch alert."""
    m = _matches(spark, sf).where(F.col("rule_name") == "kernel_watch")
    return A.alert_text(m).select("id", "subject", "body")


# ------------------------------------------------------------ detections
def _failed_logins(spark, sf):
    ev = _ev(spark, sf)
    return ev.where(F.col("message").startswith("Failed password")).withColumn(
        "account", F.regexp_extract("message", r"for (\S+) from", 1))


@query
def q_failed_login_window(spark, sf):
    """W-06/T-09: failed logins of an account in the last 300 s."""
    return D.failed_login_bursts(_failed_logins(spark, sf), "account", max_attempts=1).select(
        "id", "account", "attempts_in_window", "rate_limited")


@query
def q_rapid_fire(spark, sf):
    """W-07: per client, requests in the last 5 minutes."""
    return D.rapid_fire(relabel.access_log(spark, sf), "client").select("id", "client", "requests_5m", "rapid_fire")


@query
def q_error_spike(spark, sf):
    """W-08/T-10: errors (kernel/security events) in the last 300 s."""
    err = _joined(spark, sf).where(F.col("category").isin("kernel", "security")).select("id", "timestamp", "severity_score")
    out = D.error_spikes(err, critical=F.col("severity_score") >= 9)
    return out.select("id", "errors_5m", "spike", "critical_5m", "critical_spike")


@query
def q_error_patterns(spark, sf):
    """A-22: recurring (category, message prefix) patterns."""
    return D.error_patterns(_ev(spark, sf))


@query
def q_dominant_error(spark, sf):
    """A-23: most frequent error class per day."""
    e = D.classify_errors(relabel.error_records(spark, sf)).withColumn("day", F.to_date("ts"))
    return D.dominant_by(e, ["day"], "error_class", "dominant_class")


@query
def q_error_classify(spark, sf):
    """F-24/F-25: class, severity and recovery action of each error record."""
    return D.classify_errors(relabel.error_records(spark, sf)).select(
        "id", "error_class", "error_severity", "recovery_action")


@query
def q_error_stats(spark, sf):
    """A-21: error records by severity and by class in one pass."""
    return S.grouping_sets_counts(D.classify_errors(relabel.error_records(spark, sf)), ["error_severity", "error_class"])


# ------------------------------------------------------------ text (F-15..F-20)
from logweave.functions import sanitize as T  # noqa: E402


@query
def q_sanitize_text(spark, sf):
    """F-15 on whole documents: sanitised length and digest per document."""
    d = store.spread(read_table(spark, sf, "documents")).select("doc_id", T.sanitize_log_text(F.col("text")).alias("_s"))
    return d.select("doc_id", F.length("_s").alias("sanitized_chars"), F.md5("_s").alias("sanitized_md5"))


@query
def q_validate_text(spark, sf):
    """F-18 on every conversation turn."""
    c = store.spread(read_table(spark, sf, "conversations")).select("conv_id", "turn", T.validate_log_text(F.col("text")).alias("_v"))
    return c.select("conv_id", "turn", F.col("_v.is_valid").alias("is_valid"), F.col("_v.reason").alias("reason"))


@query
def q_entry_verdict(spark, sf):
    """F-20 on raw web pages, counted per verdict."""
    p = store.spread(read_table(spark, sf, "pages")).select(T.entry_verdict(F.col("html")).alias("verdict"))
    return p.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ health, retention
from logweave.operators import health as H  # noqa: E402
from logweave.operators.reanalysis import reanalyse  # noqa: E402
from logweave.operators.windows import beyond_n  # noqa: E402


@query
def q_trend_slope(spark, sf):
    """W-02: latency trend of each component over its last 10 samples."""
    return H.trend_slope(relabel.component_samples(spark, sf), "component", "ts", "latency", 10)


@query
def q_trend_half(spark, sf):
    """W-03: newer-half vs older-half mean of the last 10 samples."""
    return H.trend_half(relabel.component_samples(spark, sf), "component", "ts", "latency", 10)


@query
def q_component_rate(spark, sf):
    """W-05/T-11: per component and minute, events, rate and mean latency."""
    return H.per_minute(relabel.component_samples(spark, sf), "component", "ts", "latency")


@query
def q_retention_counts(spark, sf):
    """U-06: kept / deleted rows at 2024-02-15 for metrics (30 d),
    notifications (90 d) and events (365 d)."""
    ref = dt.datetime(2024, 2, 15)
    parts = []
    for name, df, ts, days in [("processing_metrics", relabel.processing_metrics(spark, sf), "timestamp", 30),
                               ("notification_history", relabel.notification_history(spark, sf), "sent_at", 90),
                               ("events", _ev(spark, sf), "timestamp", 365)]:
        keep, drop = H.retention_split(df, ts, days, ref)
        parts.append(keep.agg(F.count(F.lit(1)).alias("kept")).crossJoin(drop.agg(F.count(F.lit(1)).alias("deleted")))
                     .select(F.lit(name).alias("table_name"), "kept", "deleted"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def q_upsert_latest(spark, sf):
    """J-12/U-05: re-analysis of the kernel events a day later, upserted by
    event id (newest analysis wins)."""
    an = _an(spark, sf)
    kernel_ids = _ev(spark, sf).where(F.col("category") == "kernel").select(F.col("id").alias("event_id"))
    redo = an.join(kernel_ids, "event_id", "left_semi").withColumn("analyzed_at", F.col("analyzed_at") + F.expr("INTERVAL 1 DAYS"))
    return H.upsert_latest(an, redo, "event_id", "analyzed_at").select("analysis_id", "event_id", "analyzed_at")


def _reanalyse(spark, sf):
    """Stand-in for a re-analysis: every third kernel event of twelve days
    was filed wrongly; scored again as security events a day later."""
    from logweave.sources import sinks

    events = _ev(spark, sf)
    table = _an(spark, sf).join(events.select(F.col("id").alias("event_id"), "event_date"), "event_id")
    path = sinks.fresh_path(spark, "analysis")
    table.repartition("event_date").write.partitionBy("event_date").parquet(path)
    odd = (F.col("category") == "kernel") & (F.col("event_id") % 3 == 0) & (F.dayofmonth("event_date") <= 12)
    ids = events.where(odd).select("id").unionByName(spark.createDataFrame([("rl_none:1",)], "id string"))
    found = reanalyse(spark, path, events.withColumn("category", F.lit("security")), ids, R.REF_TS + dt.timedelta(days=1))
    return path, found


@query
def q_reanalysis(spark, sf):
    """J-12/U-05: events analysed again, their scores replaced in (or added to)
    the stored table; the table after that."""
    path, _ = _reanalyse(spark, sf)
    return spark.read.parquet(path).select("event_id", "severity_score", "explanation", "analyzed_at")


@query
def q_reanalysis_found(spark, sf):
    """J-12: for each id asked for, whether there is an event of it."""
    return _reanalyse(spark, sf)[1]


@query
def q_report_keep30(spark, sf):
    """W-12: daily reports beyond the newest 30 (the delete list)."""
    reports = _ev(spark, sf).select(F.col("event_date").alias("report_date")).distinct().withColumn(
        "id", F.col("report_date").cast("string"))
    return beyond_n(reports, 30, [F.col("report_date").desc()]).select("report_date")


# ------------------------------------------------------------ streaming (T-*)
from logweave.streaming import pipeline as SP  # noqa: E402
from logweave.streaming import side  # noqa: E402
from logweave.streaming import stream as ST  # noqa: E402
from logweave.streaming import throttled as TS  # noqa: E402


def _streamed(spark, sf):
    """Root of the tables of the one parse stream."""
    return SP.ingested(spark, sf, A.rules_table(spark, ALERT_RULES))


@query
def q_stream_parse(spark, sf):
    """T-02..T-04: the ingest as one stream over files that come out of order,
    counted per (category, severity) from its events."""
    return (SP.table(spark, _streamed(spark, sf), "events").groupBy("category", "severity_score")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def q_stream_spike(spark, sf):
    """T-10: error counts of sliding windows, late rows and last windows too."""
    return SP.error_windows(spark, _streamed(spark, sf))


@query
def q_document_lines(spark, sf):
    """P-01 on whole documents taken as raw logs: numbered, stripped,
    non-empty lines; per document the kept lines and the last line number."""
    from logweave.functions.parse import split_lines

    lines = split_lines(store.spread(read_table(spark, sf, "documents")), content="text", id_col="doc_id")
    return lines.groupBy(F.col("raw_log_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line_no"), F.sum(F.length("line")).alias("chars"))


# ------------------------------------------------------------ throttle (T-05)
from logweave.operators.throttle import throttle  # noqa: E402


@query
def q_alert_throttle(spark, sf):
    """T-05: alerts actually sent: per (rule, source, category) at most one
    every ``throttle_minutes`` of the rule (0 never throttles)."""
    return throttle(_match_rows(spark, sf), "tkey", "timestamp", "match_id", "throttle_minutes").select("id", "rule_name")


# ------------------------------------------------------------ format detection (D-*)
from logweave.operators import formats as FD  # noqa: E402


@query
def q_detect_timestamp(spark, sf):
    """D-01: timestamp kind of each source from all its lines."""
    return FD.detect_timestamp(event_log_lines(spark, sf))


@query
def q_detect_delimiter(spark, sf):
    """D-03: primary delimiter of each source from all its lines."""
    return FD.detect_delimiter(event_log_lines(spark, sf))


# ------------------------------------------------------------ queue order (W-09/W-10)
from logweave.operators.windows import row_number_at_scale  # noqa: E402

# FIXED VALUES: configured priority (1..10) -> queue priority (1 = critical .. 5 = bulk)
PRIORITY_STEPS = [(8, 1), (6, 2), (4, 3), (2, 4)]
PRIORITY_BULK = 5
BATCH_SIZE = 100


def queue_priority(config_priority):
    """F-26."""
    expr = None
    for lo, p in PRIORITY_STEPS:
        expr = F.when(config_priority >= lo, F.lit(p)) if expr is None else expr.when(config_priority >= lo, F.lit(p))
    return expr.otherwise(F.lit(PRIORITY_BULK))


@query
def q_queue_batches(spark, sf):
    """F-26/F-27/W-09/W-10: entries in queue order (priority, then time,
    then id) over all sources, their rank and batch number of 100. Stand-in:
    the configured priority of a line's source is user_id % 10 + 1."""
    lines = event_log_lines(spark, sf)
    e = lines.select(
        "source_name", F.col("ts").alias("timestamp"), queue_priority(F.col("user_id") % 10 + 1).alias("priority"),
        F.concat_ws("_", "source_name", F.date_format("ts", "yyyyMMdd_HHmmss_SSSSSS"), F.col("line_no").cast("string")).alias("entry_id"))
    ranked = row_number_at_scale(e, [], ["priority", "timestamp", "entry_id"], "queue_rank")
    return ranked.select("entry_id", "source_name", "priority", "queue_rank",
                         F.floor((F.col("queue_rank") - 1) / BATCH_SIZE).cast("long").alias("batch_no"))


# ------------------------------------------------------------ log files (S-01, S-04..S-06)
from logweave.sources import files as FS  # noqa: E402


def _files(spark, sf, odd=False):
    return FS.LogFiles(spark, (FS.stage_odd_files if odd else FS.stage_document_files)(spark, sf))


def _parsed_file_lines(spark, sf):
    """Lines of the admitted staged files, parsed."""
    from logweave.plans.ingest import parse_raw_lines

    files = _files(spark, sf)
    lines = files.lines(FS.admission(files.facts()).where("is_valid"))
    return parse_raw_lines(store.spread(lines.withColumnRenamed("path", "raw_log_id")))


@query
def q_file_admission(spark, sf):
    """S-04: admission verdict of every staged log file, odd ones too."""
    return (FS.admission(_files(spark, sf).facts()).unionByName(FS.admission(_files(spark, sf, odd=True).facts()))
            .select("bucket", "size_bytes", "is_valid", "reason"))


@query
def q_file_inventory(spark, sf):
    """S-06: size, non-empty lines and a 3-line preview per log file."""
    files = _files(spark, sf)
    return FS.inventory(files.files, files.lines()).select("bucket", "size_bytes", "line_count", "preview")


@query
def q_file_lines(spark, sf):
    """S-01: every admitted odd file in its own decoding: lines, number of the
    last one, characters, and a digest of the lines."""
    files = _files(spark, sf, odd=True)
    facts = files.facts()
    lines = files.lines(FS.admission(facts).where("is_valid"))
    return lines.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line_no"), F.sum(F.length("line")).alias("chars"),
        F.sum(F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 8), 16, 10).cast("long")).alias("digest"))


@query
def q_file_ingest(spark, sf):
    """S-01 + P-01..P-05: files read by byte ranges (UTF-8, else Latin-1) as
    lines and parsed; lines per (file, format, valid)."""
    return _parsed_file_lines(spark, sf).groupBy("bucket", "pattern", "valid").agg(F.count(F.lit(1)).alias("n"))


@query
def q_danger_classes(spark, sf):
    """F-21/F-22 on every conversation turn: hit per suspicious class and
    the script flag, counted per role."""
    c = store.spread(read_table(spark, sf, "conversations")).select(
        "role", T.danger_classes(F.col("text")).alias("_d"), T.has_script(F.col("text")).alias("script"))
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"),
        *[F.count_if(F.col("_d")[k]).alias(k) for k in T.DANGER_CLASSES], F.count_if("script").alias("script"))


@query
def q_page_scripts(spark, sf):
    """F-21/F-22/F-23 on raw pages: script flag and classes per page; the
    page URL is tested as a user agent for bot words."""
    p = store.spread(read_table(spark, sf, "pages")).select(
        "page_id", T.has_script(F.col("html")).alias("script"), T.danger_classes(F.col("html")).alias("_d"),
        T.is_bot_agent(F.col("url")).alias("bot_like"))
    return p.select("page_id", "script", "bot_like", *[F.col("_d")[k].alias(k) for k in T.DANGER_CLASSES])


# ------------------------------------------------------------ fan-out, cascade, expiry
CLIENT_FILTERS = [
    ("c_all", [], None, None, [], []),
    ("c_auth_high", ["security_event"], 7, None, ["auth"], []),
    ("c_kernel_system", [], None, None, ["kernel", "system"], []),
    ("c_low", [], 1, 3, [], []),
    ("c_host0_sshd", [], None, None, [], ["host0:sshd[1000]"]),
]


@query
def q_client_fanout(spark, sf):
    """J-06: recipients of each event update (priority = severity, 5 when
    there is no analysis), counted per client."""
    upd = _joined(spark, sf).select("id", "category", "source", F.lit("security_event").alias("event_type"),
                                    F.coalesce("severity_score", F.lit(5)).alias("priority"))
    f = spark.createDataFrame(CLIENT_FILTERS, A.CLIENT_FILTER_SCHEMA)
    return A.client_fanout(upd, f).groupBy("client_id").agg(F.count(F.lit(1)).alias("deliveries"))


@query
def q_cascade_keep(spark, sf):
    """U-07: rows left after deleting raw log rl_5 with its events and their
    analyses (anti joins)."""
    ev, an = _ev(spark, sf), _an(spark, sf)
    gone = ev.where(F.col("raw_log_id") == "rl_5").select(F.col("id").alias("event_id"))
    ev_keep = ev.where(F.col("raw_log_id") != "rl_5")
    an_keep = an.join(gone, "event_id", "left_anti")
    return (ev_keep.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("events").alias("table_name"), "kept")
            .unionByName(an_keep.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("ai_analysis").alias("table_name"), "kept")))


@query
def q_session_expiry(spark, sf):
    """U-08: sessions expired / still valid at 2024-01-15 12:00 per role."""
    t = F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp_ntz")
    s = relabel.user_sessions(spark, sf)
    return s.groupBy("role").agg(F.count_if(t > F.col("expires_at")).alias("expired"),
                                 F.count_if(t <= F.col("expires_at")).alias("kept"))


@query
def q_health_grade(spark, sf):
    """F-31: health score and grade of every host sample."""
    h = relabel.host_samples(spark, sf)
    sc = H.health_score(F.col("cpu_usage"), F.col("memory_usage"), F.col("cache_hit_rate"), F.col("queue_size"),
                        F.col("processing_rate"), F.col("batch_enabled"))
    return h.select("id", "component", sc.alias("health_score"), H.grade(sc).alias("grade"))


@query
def q_host_averages(spark, sf):
    """W-13: last-10 averages and time span per component."""
    return H.host_averages(relabel.host_samples(spark, sf), "component", "ts", 10)


@query
def q_notification_history(spark, sf):
    """P-16: the 100 newest failed email notifications of rule types like 'rule1'."""
    nh = relabel.notification_history(spark, sf)
    return E.notification_history(nh, 100, rule="rule1", channel="email", status="failed").select(
        "id", "notification_type", "channel", "status", "sent_at")


@query
def q_metrics_for_source(spark, sf):
    """P-17: metrics of the last 72 hours for source src3."""
    return E.metrics_for_source(relabel.processing_metrics(spark, sf), "src3", 72).select("id", "metric_type", "metric_value")


@query
def q_audit_query(spark, sf):
    """P-18: failed error/click audit rows of high severity in a week, page 2."""
    a = relabel.audit_logs(spark, sf)
    return E.audit_query(a, limit=20, offset=20, event_types=["error", "click"], start=dt.datetime(2024, 1, 8),
                         end=dt.datetime(2024, 1, 15), severity="high").select("id", "event_type", "username", "timestamp")


@query
def q_char_sanitize(spark, sf):
    """F-17 on whole documents: bad characters replaced (runs capped), long
    lines cut; digest and whether anything changed."""
    d = store.spread(read_table(spark, sf, "documents")).select(
        "doc_id", "text", T.cut_long_lines(T.replace_bad_chars(F.col("text"))).alias("_s"))
    return d.select("doc_id", F.length("_s").alias("sanitized_chars"), F.md5("_s").alias("sanitized_md5"),
                    (F.col("_s") != F.col("text")).alias("modified"))


@query
def q_filename_sanitize(spark, sf):
    """F-16 on page URLs taken as upload names."""
    return read_table(spark, sf, "pages").select("page_id", T.sanitize_filename(F.col("url")).alias("safe_name"))


@query
def q_event_validation(spark, sf):
    """F-19: events per list of validation errors ('' = valid)."""
    ev = _ev(spark, sf)
    errs = T.event_errors(F.col("id"), F.col("raw_log_id"), F.col("timestamp"), F.col("source"), F.col("message"),
                          F.col("category"), R.REF_TS)
    return ev.select(F.array_join(errs, " | ").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


@query
def q_analysis_methods(spark, sf):
    """X-01/A-36: analyses per method with no external scorer configured
    (every event falls back to the rules)."""
    from logweave.operators.scoring import method_counts, score_events_with

    return method_counts(score_events_with(_ev(spark, sf)))


def _queue_snapshots(spark, sf):
    """Per component: latest reported queue size, processed and failed samples."""
    h = relabel.host_samples(spark, sf)
    return h.groupBy("component").agg(
        F.max_by("queue_size", F.when(F.col("queue_size").isNotNull(), F.struct("ts", "id"))).alias("queue_size"),
        F.count_if(F.col("processing_rate").isNotNull()).alias("processed"),
        F.count_if(F.col("processing_rate").isNull()).alias("errors"))


@query
def q_component_status(spark, sf):
    """F-32: queue health status of each component."""
    return H.queue_status(_queue_snapshots(spark, sf)).select(
        "component", "queue_size", "processed", "errors", "queue_utilization", "status")


@query
def q_overall_status(spark, sf):
    """F-33: worst component status."""
    return H.overall_status(H.queue_status(_queue_snapshots(spark, sf)))


@query
def q_stream_rule_match(spark, sf):
    """T-15: alert rule matches of the streamed events, counted per rule."""
    m = SP.table(spark, _streamed(spark, sf), "rule_matches")
    return m.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))


@query
def q_stream_sinks(spark, sf):
    """T-04: rows and distinct ids that the one parse stream left in its sinks."""
    root, out = _streamed(spark, sf), None
    for name, key in (("events", "id"), ("analysis", "event_id"), ("rule_matches", "id")):
        one = SP.table(spark, root, name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("ids"))
        one = one.select(F.lit(name).alias("table_name"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


def _match_rows(spark, sf):
    return _matches(spark, sf).select(
        "id", "rule_name", "timestamp", "throttle_minutes",
        F.concat_ws("|", "rule_name", "id").alias("match_id"),
        F.concat_ws(":", "rule_name", "source", "category").alias("tkey"))


def _throttled_stream(spark, sf, name, rows, key, id_col, seconds, bypass=None):
    """Sent ids of a stream over ``rows`` that arrive up to two hours late."""
    folder, files = TS.stage_disordered(rows, f"{store._root(spark, sf, name)}/{name}", "timestamp")
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
              .option("recursiveFileLookup", "true").parquet(folder))
    root = side.stream_root(spark, name)
    TS.run(TS.throttled(stream, key=key, ts="timestamp", id_col=id_col, seconds=seconds, delay="3 hours", bypass=bypass), root)
    return TS.decided_so_far(spark, root).where("sent").select("id")


@query
def q_stream_alert_throttle(spark, sf):
    """T-05 as a stream with keyed state: the alerts sent, equal to the batch
    throttle's though they arrive out of order."""
    rows = _match_rows(spark, sf).withColumn("seconds", F.col("throttle_minutes") * 60)
    sent = _throttled_stream(spark, sf, "alerts", rows, "tkey", "match_id", "seconds")
    return sent.select(F.substring_index("id", "|", -1).alias("id"), F.substring_index("id", "|", 1).alias("rule_name"))


# seconds between two broadcasts of one source and result type; by event type alone
RESULT_SECONDS = {"success": 900, "warning": 600, "failure": 600, "partial_success": 600}
TYPE_SECONDS = {"system": 1800, "auth": 900, "network": 600}


def _result_rows(spark, sf):
    """Stand-in for processing results: every stored event with the result type
    of its outcome, from the event's number."""
    n = F.col("event_id")
    rtype = A.result_type(n % 13 != 0, F.when(n % 7 == 0, 1).otherwise(0), F.when(n % 5 == 0, 1).otherwise(0))
    rows = store.events(spark, sf).select("id", "source_name", "category", "timestamp", rtype.alias("result_type"))
    seconds = F.create_map(*[F.lit(x) for kv in RESULT_SECONDS.items() for x in kv])
    return rows.withColumn("rkey", F.concat_ws("_", "source_name", "result_type")).withColumn(
        "seconds", F.coalesce(seconds[F.col("result_type")], F.lit(0)))


def _bypass():
    return F.col("result_type").isin("failure", "partial_success")


@query
def q_result_throttle(spark, sf):
    """T-06: results sent under a throttle per (source, result type); failures
    and partial successes pass and leave the times as they are."""
    return throttle(_result_rows(spark, sf), "rkey", "timestamp", "id", "seconds", unit_seconds=1,
                    bypass=_bypass()).select("id", "result_type")


@query
def q_type_throttle(spark, sf):
    """T-06: events sent under a throttle per category (no rule: always)."""
    seconds = F.create_map(*[F.lit(x) for kv in TYPE_SECONDS.items() for x in kv])
    rows = store.events(spark, sf).select("id", "category", "timestamp", seconds[F.col("category")].alias("seconds"))
    return throttle(rows, "category", "timestamp", "id", "seconds", unit_seconds=1).select("id", "category")


@query
def q_stream_result_throttle(spark, sf):
    """T-06 as a stream with keyed state and the failures' bypass."""
    return _throttled_stream(spark, sf, "results", _result_rows(spark, sf), "rkey", "id", "seconds", _bypass())


@query
def q_stream_tail(spark, sf):
    """T-01: tail the staged log files from their start; lines and
    characters per file."""
    root = FS.stage_document_files(spark, sf)
    t = ST.stream_tail(spark, f"{root}/**/*.txt")
    t = t.withColumn("bucket", F.regexp_extract("path", r"bucket=(\d+)", 1).cast("int"))
    return t.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("content")).alias("chars"))


@query
def q_recovery_recommendations(spark, sf):
    """A-24: recommendations from the 50 newest error records."""
    r = D.recovery_recommendations(D.classify_errors(relabel.error_records(spark, sf)))
    return r.select("n", F.array_join("recommendations", " | ").alias("recommendations"))


@query
def q_grade_changes(spark, sf):
    """W-04: distinct health grades over the last 5 samples per component."""
    h = relabel.host_samples(spark, sf)
    sc = H.health_score(F.col("cpu_usage"), F.col("memory_usage"), F.col("cache_hit_rate"), F.col("queue_size"),
                        F.col("processing_rate"), F.col("batch_enabled"))
    last5 = top_n(h.withColumn("grade", H.grade(sc)), 5, [F.col("ts").desc(), F.col("id").desc()], ["component"], salt_by=["id"])
    return last5.groupBy("component").agg(F.countDistinct("grade").alias("distinct_grades"))


@query
def q_format_confidence(spark, sf):
    """A-28: detected sources per confidence level."""
    return FD.detect_timestamp(event_log_lines(spark, sf)).groupBy("confidence").agg(F.count(F.lit(1)).alias("sources"))


@query
def q_validation_outcomes(spark, sf):
    """A-30: entry verdicts over every document text."""
    d = store.spread(read_table(spark, sf, "documents")).select(T.entry_verdict(F.col("text")).alias("verdict"))
    return d.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def q_client_queue(spark, sf):
    """W-11: per client, the newest 100 queued deliveries of the hour before
    2024-01-30 12:00 (older ones are dropped)."""
    upd = _joined(spark, sf).select("id", "timestamp", "category", "source", F.lit("security_event").alias("event_type"),
                                    F.coalesce("severity_score", F.lit(5)).alias("priority"))
    f = spark.createDataFrame(CLIENT_FILTERS, A.CLIENT_FILTER_SCHEMA)
    t = dt.datetime(2024, 1, 30, 12)
    fan = A.client_fanout(upd, f).where(
        (F.col("timestamp") > F.lit(t - dt.timedelta(hours=1)).cast("timestamp_ntz")) & (F.col("timestamp") <= F.lit(t).cast("timestamp_ntz")))
    kept = top_n(fan, 100, [F.col("timestamp").desc(), F.col("id").desc()], ["client_id"], salt_by=["id"])
    return kept.groupBy("client_id").agg(F.count(F.lit(1)).alias("queued"), F.min("timestamp").alias("oldest"))


@query
def q_notification_events(spark, sf):
    """J-10: notification history joined to its events (FK), per category
    and status."""
    nh = relabel.notification_history(spark, sf).select("event_id", "status")
    return nh.join(_ev(spark, sf).select("event_id", "category"), "event_id").groupBy("category", "status").agg(
        F.count(F.lit(1)).alias("n"))


@query
def q_result_types(spark, sf):
    """F-28/A-26: processing result of every ingested file line (parsed or
    not; a line needing sanitising is a warning), counted by result type and
    by broadcast priority in one pass."""
    p = _parsed_file_lines(spark, sf).withColumn("verdict", T.entry_verdict(F.col("line")))
    rt = A.result_type(F.col("valid"), F.lit(0), F.when(F.col("verdict") == "requires_sanitization", 1).otherwise(0))
    res = p.withColumn("result_type", rt).withColumn("priority", A.result_priority(F.col("result_type"), F.col("verdict")))
    return S.grouping_sets_counts(res, ["result_type", "priority"])


@query
def q_stream_component_rate(spark, sf):
    """T-11: streamed component rates per minute, late rows included."""
    return SP.component_minutes(spark, _streamed(spark, sf))


@query
def q_data_health(spark, sf):
    """F-34: health report of the stored data (notification success rate
    over 30 days, ingested bytes, inactive log files, events per hour)."""
    nh = E.last_hours(relabel.notification_history(spark, sf), 24 * 30, ts="sent_at")
    sr = nh.agg(F.round(F.count_if(F.col("status") == "sent") / F.count(F.lit(1)), 6).alias("success_rate"))
    size = event_log_lines(spark, sf).agg(F.sum(F.octet_length("line")).alias("size_bytes"))
    inactive = FS.admission(_files(spark, sf).facts()).agg(F.count_if(~F.col("is_valid")).alias("inactive"))
    rate = S.realtime_stats(_ev(spark, sf).withColumn("processing_time", F.lit(0.0))).select(
        F.col("events_per_hour"))
    h = H.data_health(sr, size, inactive, rate)
    return h.select("success_rate", "size_bytes", "inactive", "events_per_hour",
                    F.array_join("recommendations", " | ").alias("recommendations"), "overall_health")


@query
def q_stream_failed_logins(spark, sf):
    """T-09: streamed failed-login windows per account, late rows included."""
    return SP.failed_login_windows(spark, _streamed(spark, sf))


# ------------------------------------------------------------ format registry (D-02, D-04..D-07, O-07)
from logweave.operators import registry as FR  # noqa: E402
from logweave.sources.loglines import format_log_lines  # noqa: E402


@query
def q_format_fields(spark, sf):
    """D-02: fields of each source: matches, spread of their positions,
    whether they are present and consistent."""
    return FR.detect_fields(format_log_lines(spark, sf))


@query
def q_format_registry(spark, sf):
    """D-04: composed formats of each source with their regex and the group
    numbers of time, host, process, pid and message."""
    return FR.compose_formats(format_log_lines(spark, sf)).select(
        "source_name", "format_name", "regex_pattern", "g_timestamp", "g_host", "g_process", "g_pid", "g_message",
        "confidence", "frequency")


@query
def q_top_formats(spark, sf):
    """O-07: the 5 best formats over all sources."""
    return FR.top_formats(FR.compose_formats(format_log_lines(spark, sf))).select(
        "format_name", "regex_pattern", "frequency", "rank")


@query
def q_parse_detected(spark, sf):
    """D-05..D-07/F-04/F-30: every line parsed by the format its source is
    remembered by (learned from the lines of 2024-01-01 where there are ten of
    them), else by the one detected now, else by the cascade."""
    lines = format_log_lines(spark, sf)
    first_day = lines.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz"))
    learned = FR.best_formats(FR.compose_formats(first_day), min_lines=FR.MIN_LINES)
    detected = FR.best_formats(FR.compose_formats(lines))
    return FR.parse_with_formats(lines, learned, detected).select(
        "event_id", "format_name", "method", "event_ts", "source", "message")


from logweave.plans import status_queries, upkeep_queries  # noqa: E402, F401
