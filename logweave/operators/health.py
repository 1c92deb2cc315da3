"""Health and trends over sample histories (W-02, W-03, W-05, W-13) and
retention / upsert / diff operators (U-03, U-05, U-06, W-12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.parse import lit_ts
from logweave.operators.windows import top_n

TREND_SLOPE = 0.1
TREND_HALF = 0.05


def last_samples(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The ``n`` newest samples per key with ``x`` = 0..n-1 oldest first."""
    t = top_n(df, n, [F.col(ts).desc(), F.col("id").desc()], [key], salt_by=["id"], rank_col="_r")
    cnt = t.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return t.join(cnt, key).withColumn("x", (F.col("_n") - F.col("_r")).cast("double")).drop("_r")


def trend_slope(df: DataFrame, key: str, ts: str, value: str, n: int = 10) -> DataFrame:
    """W-02: least-squares slope of the last ``n`` samples; > 0.1 up,
    < -0.1 down, else (or fewer than 2 samples) stable."""
    s = last_samples(df, key, ts, n)
    g = s.groupBy(key).agg(F.regr_slope(F.col(value), F.col("x")).alias("slope"), F.count(F.lit(1)).alias("samples"))
    trend = (F.when((F.col("samples") < 2) | F.col("slope").isNull(), "stable")
             .when(F.col("slope") > TREND_SLOPE, "increasing").when(F.col("slope") < -TREND_SLOPE, "decreasing")
             .otherwise("stable"))
    return g.select(key, "samples", F.round("slope", 6).alias("slope"), trend.alias("trend"))


def trend_half(df: DataFrame, key: str, ts: str, value: str, n: int = 10) -> DataFrame:
    """W-03: mean of the newer half against the older half of the last ``n``
    samples; > +5 % increasing, < -5 % decreasing."""
    s = last_samples(df, key, ts, n)
    half = F.floor(F.col("_n") / 2)
    g = s.groupBy(key).agg(F.avg(F.when(F.col("x") < half, F.col(value))).alias("first_avg"),
                           F.avg(F.when(F.col("x") >= half, F.col(value))).alias("second_avg"),
                           F.count(F.lit(1)).alias("samples"))
    change = (F.col("second_avg") - F.col("first_avg")) / F.col("first_avg")
    trend = (F.when((F.col("samples") < 2) | (F.col("first_avg") == 0), "stable")
             .when(change > TREND_HALF, "increasing").when(change < -TREND_HALF, "decreasing").otherwise("stable"))
    return g.select(key, "samples", F.round("first_avg", 6).alias("first_avg"), F.round("second_avg", 6).alias("second_avg"),
                    trend.alias("trend"))


def per_minute(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """W-05/T-11: per component and minute, events, rate per second and mean
    latency (tumbling 1-minute windows)."""
    g = df.groupBy(key, F.window(F.col(ts).cast("timestamp"), "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg(value), 6).alias("avg_latency"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("minute"), "events",
                    F.round(F.col("events") / 60.0, 6).alias("rate_per_s"), "avg_latency")


# ---------------------------------------------------------------- retention
def retention_split(df: DataFrame, ts: str, days: int, ref_ts=R.REF_TS) -> tuple[DataFrame, DataFrame]:
    """U-06/U-08: (kept, deleted) by age; rows without a time are kept."""
    cutoff = lit_ts(ref_ts) - F.make_dt_interval(F.lit(days))
    old = F.col(ts) < cutoff
    return df.where(~F.coalesce(old, F.lit(False))), df.where(F.coalesce(old, F.lit(False)))


def upsert_latest(current: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """U-05: union + keep the newest row per key (no MERGE on parquet). The
    key is near-unique, so the window sees a handful of rows per key."""
    from pyspark.sql import Window

    u = current.unionByName(updates)
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def map_diff(old: Column, new: Column) -> Column:
    """U-03: sorted keys whose values differ between two maps (a key present
    on one side only counts as changed)."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))


# FIXED VALUES: health score weights and grade steps
HEALTH_WEIGHTS = {"cpu": 0.2, "memory": 0.2, "cache": 0.15, "queue": 0.15, "rate": 0.15, "config": 0.15}
MISSING_PART_SCORE = 0.8
MAX_QUEUE = 10000
RATE_NORM = 1000.0
CONFIG_SCORE_ON, CONFIG_SCORE_OFF = 1.0, 0.7
GRADES = [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")]


def health_score(cpu: Column, memory: Column, cache: Column, queue: Column, rate: Column, batch: Column) -> Column:
    """F-31: weighted score in [0, 1]; a part that is not reported counts 0.8."""
    w = HEALTH_WEIGHTS
    parts = [
        F.greatest(F.lit(0.0), 1.0 - cpu / 100.0) * w["cpu"],
        F.greatest(F.lit(0.0), 1.0 - memory) * w["memory"],
        cache * w["cache"],
        F.coalesce(F.greatest(F.lit(0.0), 1.0 - queue / float(MAX_QUEUE)), F.lit(MISSING_PART_SCORE)) * w["queue"],
        F.coalesce(F.least(F.lit(1.0), rate / RATE_NORM), F.lit(MISSING_PART_SCORE)) * w["rate"],
        F.coalesce(F.when(batch, F.lit(CONFIG_SCORE_ON)).when(~batch, F.lit(CONFIG_SCORE_OFF)), F.lit(MISSING_PART_SCORE)) * w["config"],
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def grade(score: Column) -> Column:
    expr = None
    for lo, g in GRADES:
        expr = F.when(score >= lo, F.lit(g)) if expr is None else expr.when(score >= lo, F.lit(g))
    return expr.otherwise(F.lit("F"))


def host_averages(samples: DataFrame, key: str, ts: str, n: int = 10) -> DataFrame:
    """W-13: averages over the last ``n`` samples per key and their time span
    in minutes."""
    s = last_samples(samples, key, ts, n)
    g = s.groupBy(key).agg(F.avg("cpu_usage").alias("avg_cpu"), F.avg("memory_usage").alias("avg_memory"),
                           F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), F.count(F.lit(1)).alias("samples"))
    span = (F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 60_000_000.0
    return g.select(key, "samples", F.round("avg_cpu", 6).alias("avg_cpu"), F.round("avg_memory", 6).alias("avg_memory"),
                    F.round(span, 6).alias("span_minutes"))


# FIXED VALUES: queue health check
QUEUE_MAX = 1000
QUEUE_CRITICAL_PCT, QUEUE_WARNING_PCT = 90, 70
ERROR_SHARE_WARNING = 0.1
STATUS_RANK = {"healthy": 0, "unknown": 1, "warning": 2, "critical": 3}


def queue_status(snap: DataFrame) -> DataFrame:
    """F-32 (queue check) per component snapshot with ``queue_size``,
    ``processed`` and ``errors``: utilization > 90 % critical, > 70 %
    warning, errors > 10 % of processed warning, else healthy."""
    util = F.col("queue_size") / F.lit(float(QUEUE_MAX)) * 100.0
    status = (F.when(util > QUEUE_CRITICAL_PCT, "critical").when(util > QUEUE_WARNING_PCT, "warning")
              .when(F.col("errors") > F.col("processed") * ERROR_SHARE_WARNING, "warning").otherwise("healthy"))
    return snap.withColumn("queue_utilization", util).withColumn("status", status)


def overall_status(statuses: DataFrame, status: str = "status") -> DataFrame:
    """F-33: critical if any is critical, else warning if any is warning,
    else healthy when all are healthy, else unknown (no rows: unknown)."""
    s = F.col(status)
    return statuses.agg(
        F.when(F.count(F.lit(1)) == 0, "unknown").when(F.bool_or(s == "critical"), "critical")
        .when(F.bool_or(s == "warning"), "warning").when(F.bool_and(s == "healthy"), "healthy")
        .otherwise("unknown").alias("overall_status"),
        F.count(F.lit(1)).alias("components"))


# FIXED VALUES: data health report
NOTIFY_SUCCESS_MIN = 0.9
DATA_SIZE_MB_MAX = 1000
EVENTS_PER_HOUR_MAX = 1000


def data_health(success_rate: DataFrame, size_bytes: DataFrame, inactive_sources: DataFrame, events_per_hour: DataFrame,
                errors: int = 0) -> DataFrame:
    """F-34: one row from four one-row inputs (columns ``success_rate``,
    ``size_bytes``, ``inactive``, ``events_per_hour``): recommendations and
    the overall rating (excellent / good / fair / poor)."""
    row = success_rate.crossJoin(size_bytes).crossJoin(inactive_sources).crossJoin(events_per_hour)
    size_mb = F.col("size_bytes") / (1024.0 * 1024.0)
    recs = F.array_compact(F.array(
        F.when(F.coalesce(F.col("success_rate"), F.lit(1.0)) < NOTIFY_SUCCESS_MIN,
               F.lit("Notification success rate is below 90%. Check notification configuration.")),
        F.when(size_mb > DATA_SIZE_MB_MAX, F.concat(F.lit("Database size is "), F.format_number(size_mb, 1),
                                                     F.lit("MB. Consider running cleanup operations."))),
        F.when(F.col("inactive") > 0, F.concat(F.lit("Found "), F.col("inactive").cast("string"),
                                               F.lit(" inactive log sources. Review configuration."))),
        F.when(F.col("events_per_hour") > EVENTS_PER_HOUR_MAX, F.lit("High processing rate detected. Monitor system resources.")),
    ))
    n = F.size(recs)
    overall = (F.when((F.lit(errors) == 0) & (n == 0), "excellent").when((F.lit(errors) == 0) & (n <= 2), "good")
               .when(F.lit(errors) <= 1, "fair").otherwise("poor"))
    return row.select("success_rate", "size_bytes", "inactive", "events_per_hour", recs.alias("recommendations"),
                      overall.alias("overall_health"))
