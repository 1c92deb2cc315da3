"""Relabelled views of the driver's ``events`` table (stand-in inputs).

The reference keeps notification, metric, audit, access, host-sample and
session rows in its own tables; the driver tables do not have them, so these
functions give ``events`` rows the column names and value sets those tables
have. They only rename and map values; every query runs its own logic on
them (see FIXTURES.md section 3 for the mapping).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.tables import read_table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _s(c):
    return c.cast("string")


def notification_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    return e.select(
        eid.alias("id"), eid.alias("event_id"),
        F.concat(F.lit("rule"), _s(F.col("user_id") % 4)).alias("notification_type"),
        F.when(eid % 3 == 0, "email").when(eid % 3 == 1, "webhook").otherwise("slack").alias("channel"),
        F.when(eid % 10 <= 6, "sent").when(eid % 10 <= 8, "failed").otherwise("pending").alias("status"),
        F.col("ts").alias("sent_at"),
    )


def processing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), _s(F.col("user_id") % 5)).alias("source_name"),
        F.col("event_type").alias("metric_type"), F.col("value").alias("metric_value"),
        F.col("ts").alias("timestamp"),
        # two of three metrics name a source in their metadata
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"source_name": "src'), _s(F.col("user_id") % 5), F.lit('"}')))
        .otherwise(F.col("props")).alias("metric_metadata"),
    )


AUDIT_SEVERITIES = ["low", "medium", "high", "critical"]


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    sev = F.element_at(F.array(*[F.lit(x) for x in AUDIT_SEVERITIES]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "event_type",
        F.when(F.col("user_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("user"), _s(F.col("user_id")))).alias("username"),
        sev.alias("severity"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("timestamp"),
        F.col("props").alias("event_metadata"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("client"), F.col("event_type").alias("endpoint"),
        F.col("value").alias("duration"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("ts").alias("ts"),
    )


def component_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("c"), _s(F.col("user_id") % 6)).alias("component"),
        F.col("value").alias("latency"), F.least(F.col("value") / 5, F.lit(100.0)).alias("percent"),
        F.col("event_type"), F.col("ts").alias("ts"),
    )


SESSION_ROLES = ["admin", "analyst", "viewer", "operator"]


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    role = F.element_at(F.array(*[F.lit(x) for x in SESSION_ROLES]), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("session_id"), F.concat(F.lit("user"), _s(F.col("user_id"))).alias("username"),
                    role.alias("role"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 HOURS")).alias("expires_at"))


ERROR_MESSAGES = [
    "database connection lost", "websocket client disconnected", "analysis engine timeout",
    "network unreachable", "config value missing", "none of the handlers answered",
    "critical database failure", "file permission denied",
]
ERROR_TYPES = ["DatabaseError", "ConnectionError", "TimeoutError", "OSError", "ValueError", "RuntimeError",
               "DatabaseError", "PermissionError"]


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_shape(_events(spark, sf_dir).where(F.col("event_type") == "error"))


def error_shape(e: DataFrame) -> DataFrame:
    """Error events (a table or a stream) as error records."""
    k = (F.col("event_id") % 8 + 1).cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id"),
        F.element_at(F.array(*[F.lit(x) for x in ERROR_TYPES]), k).alias("error_type"),
        F.element_at(F.array(*[F.lit(x) for x in ERROR_MESSAGES]), k).alias("message"),
        F.concat(F.lit("c"), _s(F.col("user_id") % 6)).alias("component"), F.col("ts").alias("ts"),
        (F.col("event_id") % 3 != 0).alias("recovery_successful"),
    )


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host/optimizer samples: cpu %, memory share, cache hit rate, queue size,
    processing rate and batch setting (NULL = the part is not reported)."""
    e = _events(spark, sf_dir)
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("c"), _s(F.col("user_id") % 6)).alias("component"), F.col("ts").alias("ts"),
        F.least(F.col("value") / 5, F.lit(100.0)).alias("cpu_usage"), F.least(F.col("value") / 400, F.lit(1.0)).alias("memory_usage"),
        ((F.col("event_id") % 100) / 100.0).alias("cache_hit_rate"),
        F.when(et == "view", F.col("user_id") * 10).alias("queue_size"),
        F.when(et != "error", F.col("value") * 3).alias("processing_rate"),
        F.when(et == "signup", F.lit(None).cast("boolean")).otherwise(et.isin("click", "purchase")).alias("batch_enabled"),
    )


def processing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with processing flags; the processing time is text and empty for some."""
    eid = F.col("event_id")
    return _events(spark, sf_dir).select(
        eid.alias("id"), (eid % 5 != 0).alias("realtime_processed"), (F.col("event_type") != "error").alias("notification_sent"),
        F.col("ts").alias("parsed_at"), F.when(eid % 7 == 0, "").otherwise(_s(F.col("value"))).alias("processing_time"))


def processing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One processing attempt per event; the user stands for the entry."""
    eid, bad = F.col("event_id"), F.col("event_type") == "error"
    return _events(spark, sf_dir).select(
        eid.alias("id"), F.concat(F.lit("entry_"), _s(F.col("user_id"))).alias("entry_id"), F.col("ts"), (~bad).alias("success"),
        F.when(bad, eid % 3 + 1).otherwise(0).alias("n_errors"), (bad & (eid % 2 == 0)).alias("validation_failed"),
        (eid % 6 == 0).alias("sanitized"), F.col("value").alias("seconds"))


def diagnostic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diagnostic run per event with the status of three components."""
    eid = F.col("event_id")
    part = lambda name, fail, warn: F.struct(F.lit(name).alias("name"), F.when(eid % fail == 0, "fail").when(
        eid % warn == 0, "warning").otherwise("pass").alias("status"))
    return _events(spark, sf_dir).select(
        eid.alias("run_id"), F.col("ts"), F.array(part("queue", 5, 3), part("parser", 7, 2), part("store", 11, 4)).alias("components"),
        F.array_repeat(F.col("event_type"), (eid % 4).cast("int")).alias("recommendations"))


def log_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configured log source per user."""
    u = F.col("user_id")
    users = _events(spark, sf_dir).select("user_id").distinct()
    folder = F.concat(F.lit("/logs/b"), _s(u % 8))
    return users.select(
        u.alias("source_id"), F.concat(F.when(u % 13 == 0, "source: ").otherwise("source "), _s(u % 120)).alias("source_name"),
        F.when(u % 3 == 0, "file").otherwise("directory").alias("source_type"),
        F.when(u % 3 == 0, F.concat(folder, F.lit("/x"), _s(u % 5), F.lit("/d"), _s(u), F.lit(".log"))).otherwise(folder).alias("path"),
        F.when(u % 15 == 0, "../*").when(u % 3 == 1, F.concat(F.lit("d*"), _s(u % 10), F.lit(".[lt]??"))).otherwise(
            F.lit(None).cast("string")).alias("file_pattern"),
        (u % 2 == 0).alias("recursive"), F.split(F.concat(F.lit(" Prod,web,,prod ,t"), F.when(u % 17 == 0, "#").otherwise("-"), _s(u % 4)), ",").alias("tags"),
        (u % 6 != 0).alias("enabled"), F.when(u % 4 == 0, "error").when(u % 4 == 1, "paused").otherwise("active").alias("status"))


def log_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file path per document."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(F.concat(
        F.lit("/logs/b"), _s(d % 8), F.lit("/x"), _s(d % 5), F.lit("/d"), _s(d), F.when(d % 4 == 0, ".txt").otherwise(".log")).alias("path"))


def analysis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as analysis rows that came from outside."""
    c, t = F.col("conv_id"), F.col("turn")
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(t % 5 == 4, " ").otherwise(F.concat_ws("_", _s(c), _s(t))).alias("id"),
        _s(c).alias("event_id"), ((c + t) % 13).alias("severity_score"), F.col("text").alias("explanation"),
        F.split("text", "\\. ").alias("recommendations"))


def queue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue entry per event: status, and the time it was completed (up to
    two hours after it came; none where it isn't)."""
    eid = F.col("event_id")
    status = F.when(eid % 9 == 0, "failed").when(eid % 4 == 0, "pending").otherwise("completed")
    done = F.col("ts") + F.make_dt_interval(mins=(eid % 120).cast("int"))
    return _events(spark, sf_dir).select(eid.alias("entry_id"), status.alias("status"), F.col("ts").alias("created_at"),
                                         F.when(status != "pending", done).alias("completed_at"))
