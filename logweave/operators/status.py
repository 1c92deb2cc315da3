"""Status figures over run, delivery, component and source tables: outcome
rates (A-05, A-06, A-14, A-15, A-21, A-32), per-entry and per-event outcomes
(A-31, A-34, A-35), trailing component metrics (W-05, W-07, W-13), health
checks and advice (F-31, F-32, F-35), source checks (A-18, A-20, F-37) and the
map from files to sources (S-10, J-08).

Every figure is a partial + final aggregate over one scan; histories that need
an order use the distributed ranking of ``windows``; configuration tables join
on equi-keys and are broadcast only behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.parse import lit_ts, strip
from logweave.operators.detect import sliding_count
from logweave.operators.health import STATUS_RANK, last_samples, trend_slope
from logweave.session import broadcast_if_small


def share(part: Column, whole: Column) -> Column:
    """part / whole rounded to 6 places, 0 where whole is 0."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def outcome_rates(runs: DataFrame, flags: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """A-06/A-14/A-15/A-21/A-32: rows per key (or overall), and for every flag
    its count ``n_<name>`` and its share ``<name>_rate``."""
    g = runs.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"n_{n}") for n, c in flags.items()])
    return g.select(*(keys or []), "total", *[f"n_{n}" for n in flags],
                    *[share(F.col(f"n_{n}"), F.col("total")).alias(f"{n}_rate") for n in flags])


def error_rates(errors: DataFrame, recovered: str = "recovery_successful", severity: str = "error_severity") -> DataFrame:
    """A-21: errors, recoveries tried (a flag is set) and done, and the
    recovery and critical shares."""
    g = errors.agg(F.count(F.lit(1)).alias("total"), F.count(recovered).alias("attempts"),
                   F.count_if(F.col(recovered)).alias("recovered"), F.count_if(F.col(severity) == "critical").alias("critical"))
    return g.select("total", "attempts", "recovered", "critical", share(F.col("recovered"), F.col("attempts")).alias("recovery_success_rate"),
                    share(F.col("critical"), F.col("total")).alias("critical_error_rate"))


def processing_state(events: DataFrame, ref_ts=R.REF_TS, parsed_at: str = "parsed_at", value: str = "processing_time") -> DataFrame:
    """A-05 over the processing flags: all events, processed ones, processed
    ones whose notification is still to come, processed per hour over the last
    24 hours and the mean of the processing times that read as numbers."""
    done = F.col("realtime_processed")
    recent = F.col(parsed_at) > lit_ts(ref_ts) - F.expr("INTERVAL 24 HOURS")
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(done).alias("realtime_processed"),
        F.count_if(done & ~F.col("notification_sent")).alias("pending_notifications"),
        F.round(F.count_if(done & recent) / F.lit(24.0), 6).alias("processing_rate"),
        F.round(F.coalesce(F.avg(F.when(done, F.col(value).try_cast("double"))), F.lit(0.0)), 6).alias("avg_processing_time"))


# ---------------------------------------------------------------- outcomes
def delivery_outcomes(deliveries: DataFrame, event: str = "event_id", channel: str = "channel", ok: Column | None = None) -> DataFrame:
    """A-31: per event the channels that took its notification and those that
    failed (distinct, sorted; channels are a closed list, so both are short)."""
    ok = F.col("success") if ok is None else ok
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(channel))))
    return deliveries.groupBy(event).agg(pick(ok).alias("successful_channels"), pick(~ok).alias("failed_channels"))


def entry_status(attempts: DataFrame, entry: str, ts: str, tie: str, success: str, errors: str) -> DataFrame:
    """A-34: per entry the attempts, the result of the last one and the number
    of errors over all."""
    return attempts.groupBy(entry).agg(
        F.count(F.lit(1)).alias("processing_attempts"), F.max_by(success, F.struct(ts, tie)).alias("last_result"),
        F.coalesce(F.sum(F.col(errors).cast("long")), F.lit(0)).alias("total_errors"))


def diagnostic_history(runs: DataFrame, ts: str, tie: str, n: int = 10) -> DataFrame:
    """A-35: the last ``n`` runs with the number of components, the names of
    those that failed, the number of recommendations and the overall status."""
    from logweave.operators.windows import top_n

    status = F.transform("components", lambda c: c["status"])
    overall = (F.when(F.size("components") == 0, "unknown").when(F.array_contains(status, "fail"), "critical")
               .when(F.array_contains(status, "warning"), "warning")
               .when(F.forall(status, lambda x: x == "pass"), "healthy").otherwise("unknown"))
    failed = F.array_sort(F.transform(F.filter("components", lambda c: c["status"] == "fail"), lambda c: c["name"]))
    return top_n(runs, n, [F.col(ts).desc(), F.col(tie).desc()]).select(
        tie, ts, overall.alias("overall_status"), F.size("components").alias("component_count"),
        F.size("recommendations").alias("recommendations_count"), failed.alias("failed_components"))


# ---------------------------------------------------------------- components
def component_metrics(samples: DataFrame, key: str = "component", ts: str = "ts", value: str = "latency", last: int = 100) -> DataFrame:
    """W-05 at the time of the newest sample: per component the rate over the
    last 60 seconds, the mean of its last 100 latencies and its errors per
    minute since the first sample of all."""
    span = samples.agg(F.max(ts).alias("_now"), F.min(ts).alias("_start"))
    at = samples.crossJoin(F.broadcast(span))  # one row
    g = at.groupBy(key).agg(
        F.round(F.count_if(F.col(ts) > F.col("_now") - F.expr("INTERVAL 60 SECONDS")) / 60.0, 6).alias("processing_rate"),
        F.count_if("is_error").alias("_errors"), F.max("_now").alias("_now"), F.max("_start").alias("_start"))
    minutes = F.timestamp_diff("SECOND", F.col("_start"), F.col("_now")) / 60.0
    mean = last_samples(samples.where(F.col(value).isNotNull()), key, ts, last).groupBy(key).agg(F.round(F.avg(value), 6).alias("average_latency"))
    return g.join(mean, key, "left").select(
        key, "processing_rate", F.coalesce("average_latency", F.lit(0.0)).alias("average_latency"),
        F.round(F.col("_errors") / F.greatest(F.lit(1.0), minutes), 6).alias("error_rate"))


def violation_steps(requests: DataFrame, client: str, ts: str = "ts") -> DataFrame:
    """W-07: requests of a client in the last 10 minutes; more than 5 make it
    suspicious, more than 20 block it."""
    c = sliding_count(requests, [client], ts, R.VIOLATION_WINDOW_S, name="requests_10m")
    return c.withColumn("suspicious", F.col("requests_10m") > R.VIOLATIONS_SUSPICIOUS).withColumn(
        "blocked", F.col("requests_10m") > R.VIOLATIONS_BLOCKED)


def spike_classes(errors: DataFrame, classes: list[str], *, cls: str = "error_class", ts: str = "ts", tie: str = "id",
                  window_s: int = R.ERROR_SPIKE_WINDOW_S, max_errors: int = R.ERROR_SPIKE_MAX) -> DataFrame:
    """A-23: for every error at which more than ``max_errors`` lie in the last
    ``window_s`` seconds, the class most of them have (ties to the first in
    ``classes``) and its count."""
    one = errors.withColumn("_k", F.lit(0))
    out = sliding_count(one, ["_k"], ts, window_s, name="errors_in_window",
                        parts={f"_c{i}": F.col(cls) == c for i, c in enumerate(classes)})
    best = F.greatest(*[F.col(f"_c{i}") for i in range(len(classes))])
    name = F.lit(None).cast("string")
    for i in reversed(range(len(classes))):
        name = F.when(F.col(f"_c{i}") == best, F.lit(classes[i])).otherwise(name)
    return out.where(F.col("errors_in_window") > max_errors).select(
        tie, "errors_in_window", name.alias("dominant_class"), best.alias("dominant_count"))


def host_trends(samples: DataFrame, key: str, ts: str, values: list[str], n: int = 10) -> DataFrame:
    """W-13: the trend of each value over the last ``n`` samples of a key."""
    out = None
    for v in values:
        t = trend_slope(samples, key, ts, v, n).select(key, F.col("trend").alias(f"{v}_trend"))
        out = t if out is None else out.join(t, key)
    return out


# FIXED VALUES: limits of the health checks
SUCCESS_CRITICAL_PCT, SUCCESS_WARNING_PCT = 80, 95
LATENCY_WARNING_MS, PENDING_WARNING = 5000, 100
MESSAGE_FAILURE_SHARE, CONNECTION_FAILURE_SHARE = 0.1, 0.2


def sources_check(failed: Column, monitored: Column) -> Column:
    """F-32, file monitoring: all sources up healthy, some down warning, else critical."""
    return F.when(failed == 0, "healthy").when(failed < monitored, "warning").otherwise("critical")


def connections_check(sent: Column, undelivered: Column, connections: Column, refused: Column) -> Column:
    """F-32, client connections: message failures over 10 % or connection
    failures over 20 % are a warning."""
    return (F.when(undelivered > sent * MESSAGE_FAILURE_SHARE, "warning")
            .when(refused > connections * CONNECTION_FAILURE_SHARE, "warning").otherwise("healthy"))


def pipeline_check(success_pct: Column, latency_ms: Column, pending: Column) -> Column:
    """F-32, processing: success under 80 % critical, under 95 %, mean latency
    over 5 s or more than 100 pending a warning."""
    return (F.when(success_pct < SUCCESS_CRITICAL_PCT, "critical").when(success_pct < SUCCESS_WARNING_PCT, "warning")
            .when(latency_ms > LATENCY_WARNING_MS, "warning").when(pending > PENDING_WARNING, "warning").otherwise("healthy"))


def worst(*checks: Column) -> Column:
    """The worst of several check results."""
    rank = F.greatest(*[sum((F.when(c == s, r).otherwise(0) for s, r in STATUS_RANK.items()), F.lit(0)) for c in checks])
    out = F.lit(None).cast("string")
    for s, r in STATUS_RANK.items():
        out = F.when(rank == r, F.lit(s)).otherwise(out)
    return out


# FIXED VALUES: advice of the performance report, in order
CPU_WARNING_PCT, MEMORY_WARNING, CACHE_LOW, UTILIZATION_HIGH = 80.0, 0.8, 0.7, 0.9
ADVICE_CPU = "High CPU usage detected. Consider reducing batch sizes or increasing processing intervals."
ADVICE_MEMORY = "High memory usage detected. Enable memory optimization and consider reducing cache sizes."
ADVICE_CACHE = "Low cache hit rate. Consider increasing cache TTL or cache size."
ADVICE_BACKPRESSURE = "Queue backpressure is active. Consider increasing queue size or processing capacity."
ADVICE_BATCHING = "Adaptive batching is disabled. Enable it for better performance optimization."
ADVICE_HANDLES = "High file handle utilization. Consider increasing max_open_handles limit."
ADVICE_BATCH_OPS = "Batch operations are disabled. Enable them for better database performance."
ADVICE_POOL = "High connection pool utilization. Consider increasing max_connections."
ADVICE_NONE = "System is performing well. No immediate optimizations needed."


def performance_advice(cpu: Column, memory: Column, cache: Column, backpressure: Column, adaptive: Column, handles: Column,
                       batch: Column, pool: Column) -> Column:
    """F-31: advice lines of a sample in order; a part that is not reported
    (null) gives none."""
    lines = F.array_compact(F.array(
        F.when(cpu > CPU_WARNING_PCT, F.lit(ADVICE_CPU)), F.when(memory > MEMORY_WARNING, F.lit(ADVICE_MEMORY)),
        F.when(cache < CACHE_LOW, F.lit(ADVICE_CACHE)), F.when(backpressure, F.lit(ADVICE_BACKPRESSURE)),
        F.when(~adaptive, F.lit(ADVICE_BATCHING)), F.when(handles > UTILIZATION_HIGH, F.lit(ADVICE_HANDLES)),
        F.when(~batch, F.lit(ADVICE_BATCH_OPS)), F.when(pool > UTILIZATION_HIGH, F.lit(ADVICE_POOL))))
    return F.when(F.size(lines) == 0, F.array(F.lit(ADVICE_NONE))).otherwise(lines)


# FIXED VALUES: resource issues: name, limit in percent, recommendations
RESOURCE_ISSUES = [
    ("high_memory_usage", 90.0, ["Reduce queue size limits", "Increase processing batch size",
                                 "Check for memory leaks in processing pipeline", "Consider adding more memory to the system"]),
    ("high_cpu_usage", 85.0, ["Optimize processing algorithms", "Reduce processing frequency",
                              "Check for infinite loops or blocking operations", "Consider scaling to multiple processes"]),
    ("disk_space_low", 90.0, ["Clean up old log files", "Implement log rotation", "Archive processed logs", "Add more disk space"]),
]


def resource_issues(samples: DataFrame, memory: Column, cpu: Column, disk: Column) -> DataFrame:
    """F-35: a row per sample and issue (memory > 90 %, CPU > 85 %, disk > 90 %)
    with its recommendations."""
    found = F.array(*[F.struct(F.when(v > limit, F.lit(name)).alias("issue"), F.array(*map(F.lit, recs)).alias("recommendations"))
                      for (name, limit, recs), v in zip(RESOURCE_ISSUES, (memory, cpu, disk), strict=True)])
    return samples.select(*samples.columns, F.inline(found)).where(F.col("issue").isNotNull())


# FIXED VALUES: general lines of the report
MANY_EVENTS = 50
MANY_EVENTS_LINE = "High volume of security events detected. Consider reviewing log sources and filtering rules."


def general_recommendations(scored: DataFrame) -> DataFrame:
    """A-27: the general lines of a report: high-severity events, many events."""
    g = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity_score") >= R.HIGH_SEVERITY).alias("high"))
    return g.select(F.explode(F.array_compact(F.array(
        F.when(F.col("high") > 0, F.concat(F.lit("Immediate attention required: "), F.col("high").cast("string"),
                                           F.lit(" high-severity events detected."))),
        F.when(F.col("n") > MANY_EVENTS, F.lit(MANY_EVENTS_LINE))))).alias("recommendation"))


# ---------------------------------------------------------------- sources
NAME_PATTERN = r"^[a-zA-Z0-9\s_\-]+$"
TAG_PATTERN = r"^[a-z0-9_\-]+$"


def source_errors(name: Column, path: Column, kind: Column, pattern: Column, recursive: Column, tags: Column) -> Column:
    """F-37: what is wrong with a source row, in check order (empty: nothing).
    Blank tags are no fault; they are left out by ``clean_tags``."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    glob = strip(pattern)
    given = F.coalesce(glob, F.lit("")) != ""
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip(t)))
    return F.array_compact(F.array(
        F.when(blank(name), F.lit("Source name cannot be empty"))
        .when(~strip(name).rlike(NAME_PATTERN), F.lit("Source name can only contain letters, numbers, spaces, hyphens, and underscores")),
        F.when(blank(path), F.lit("Path cannot be empty")),
        F.when(F.length(glob) > 255, F.lit("File pattern too long"))
        .when(F.contains(glob, F.lit("..")) | F.contains(glob, F.lit("/")), F.lit("File pattern cannot contain '..' or '/'")),
        F.when(F.exists(lowered, lambda t: (t != "") & ~t.rlike(TAG_PATTERN)),
               F.lit("Tags can only contain letters, numbers, hyphens, and underscores")),
        F.when((kind == "file") & given, F.lit("File pattern can only be specified for directory sources")),
        F.when((kind == "file") & recursive, F.lit("Recursive monitoring can only be enabled for directory sources"))))


def clean_tags(tags: Column) -> Column:
    """F-37: tags stripped and lowered, blank and repeated ones left out."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(strip(t))), lambda t: t != ""))


def repeated_values(config: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A-20: values that a column holds twice or more, with the issue's text."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(text).alias("issue"))
                     for c, text in columns.items()])
    return (config.select(F.inline(rows)).groupBy("field", "value", "issue").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def source_rollup(sources: DataFrame, status: str = "status") -> DataFrame:
    """A-18: all, active, failed and other sources."""
    s = F.col(status)
    return sources.agg(F.count(F.lit(1)).alias("total_sources"), F.count_if(s == "active").alias("active_sources"),
                       F.count_if(s == "error").alias("error_sources"),
                       F.count_if(~F.coalesce(s.isin("active", "error"), F.lit(False))).alias("inactive_sources"))


def glob_to_regex(pattern: Column) -> Column:
    """A file-name pattern (``*``, ``?``, ``[...]``, ``[!...]``) as a regex."""
    escaped = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    some = F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), F.replace(some, F.lit("[!"), F.lit("[^")), F.lit("$"))


def match_sources(files: DataFrame, sources: DataFrame, path: str = "path") -> DataFrame:
    """S-10/J-08: (file, source) pairs: a file source matches its own path, a
    directory source the files anywhere below it whose name fits its pattern
    (none: any name). Files meet sources by equal paths: their own, and each
    folder above them, so nothing is compared pairwise. Sources that agree in
    name, kind, place and pattern give the same pairs and stand once, so a
    folder's files meet each of its different sources once."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    places = F.when(F.size(parts) > 1, F.array_append(folders, F.col(path))).otherwise(F.array(F.col(path)))
    s = sources.select("source_name", "source_type", F.regexp_replace("path", "/+$", "").alias("_at"), "file_pattern")
    dirs = s.where(F.col("source_type") == "directory").select(
        "source_name", "_at", F.when(F.col("file_pattern") != "", glob_to_regex(F.col("file_pattern"))).alias("_rx")).distinct()
    own = s.where(F.col("source_type") == "file").select("source_name", F.col("_at").alias(path)).distinct()
    spots = files.select(path, F.element_at(parts, -1).alias("_name"), F.explode(places).alias("_at"))
    in_dir = spots.join(broadcast_if_small(dirs), "_at").where(F.col("_rx").isNull() | F.expr("_name rlike _rx"))
    is_file = files.select(path).join(broadcast_if_small(own), path)
    return in_dir.select(path, "source_name").unionByName(is_file.select(path, "source_name")).distinct()
