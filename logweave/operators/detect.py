"""Detections over histories: sliding-window counts (W-05..W-08, T-09,
T-10), error patterns and classes (A-21..A-24, F-24/F-25).

Sliding windows are differences of running counts: the rows at or before t
less those at or before t - window. Events and the two questions of every row
are range-partitioned by key and time and counted inside each partition, and
the partitions' totals give the offsets, so a key (or one hour) that holds a
third of the data is spread over as many tasks as its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.session import cut_lineage

def sliding_count(df: DataFrame, keys: list[str], ts: str, window_s: int, chunk_s: int | None = None,
                  name: str = "window_count", parts: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name`` = rows of the same key with time in (t - window_s, t]
    (ties on t all count), exact; ``parts`` adds the counts of those among
    them for which a condition holds. Rows without a time count nothing and
    get null. ``chunk_s`` is accepted for earlier callers and changes nothing:
    the ranges follow the data."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [name, *(parts or {})]
    flags = [F.lit(1), *[F.when(c, 1).otherwise(0) for c in (parts or {}).values()]]
    key = [f"_k{i}" for i in range(len(keys))]
    base = cut_lineage(df.select(
        F.struct(*df.columns).alias("_row"), *[F.col(k).alias(a) for k, a in zip(keys, key, strict=True)],
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.array(*flags).alias("_w"), F.monotonically_increasing_id().alias("_rid")))

    zero = F.array_repeat(F.lit(0), len(flags))

    def point(at: Column, kind: int, late: bool, w: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(late).alias("_late"), w.alias("_pw"))

    # at one time the rows themselves come first, then what is asked about it;
    # points carry the row's number alone, the rows join once at the end
    points = base.select(*key, "_rid", F.inline(F.array(
        point(F.col("_us"), 0, False, F.col("_w")), point(F.col("_us"), 1, True, zero),
        point(F.col("_us") - int(window_s * 1_000_000), 1, False, zero))))
    ranged = cut_lineage(points.repartitionByRange(n, *key, "_at", "_kind", "_rid").withColumn("_pid", F.spark_partition_id()))
    here = Window.partitionBy("_pid", *key).orderBy("_at", "_kind", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid", *key).agg(*[F.sum(F.col("_pw")[i]).alias(f"_t{i}") for i in range(len(flags))])
    offsets = totals.select(F.col("_pid").alias("_opid"), *[F.col(k).alias("_o" + k) for k in key],
                            *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(flags))])
    counted = ranged.select("*", *[F.sum(F.col("_pw")[i]).over(here).alias(f"_c{i}") for i in range(len(flags))]).where("_kind = 1")
    on = [F.col("_pid") == F.col("_opid"), *[F.col(k).eqNullSafe(F.col("_o" + k)) for k in key]]
    asked = counted.join(offsets, on)
    value = [F.col(f"_c{i}") + F.col(f"_o{i}") for i in range(len(flags))]
    g = asked.groupBy("_rid").agg(*[
        F.when(F.count("_at") > 0, F.max(F.when(F.col("_late"), v)) - F.max(F.when(~F.col("_late"), v))).alias(a)
        for a, v in zip(names, value, strict=True)])
    return base.select("_rid", "_row").join(g, "_rid").select(*[F.col("_row").getField(c).alias(c) for c in df.columns], *names)


def failed_login_bursts(failed: DataFrame, identity: str, ts: str = "timestamp", window_s: int = R.FAILED_LOGIN_WINDOW_S,
                        max_attempts: int = 5) -> DataFrame:
    """W-06: failed attempts of an identity within the last ``window_s``;
    rows where the count exceeds ``max_attempts`` are flagged."""
    c = sliding_count(failed, [identity], ts, window_s, name="attempts_in_window")
    return c.withColumn("rate_limited", F.col("attempts_in_window") > max_attempts)


def rapid_fire(requests: DataFrame, client: str, ts: str = "ts") -> DataFrame:
    """W-07: requests of a client in the last 5 minutes, > 50 is rapid fire."""
    c = sliding_count(requests, [client], ts, R.RAPID_FIRE_WINDOW_S, name="requests_5m")
    return c.withColumn("rapid_fire", F.col("requests_5m") > R.RAPID_FIRE_MAX)


def error_spikes(errors: DataFrame, ts: str = "timestamp", critical: Column | None = None) -> DataFrame:
    """W-08: errors in the last 300 s at each error (> 20 is a spike); with a
    ``critical`` flag also the critical ones (> 3 is a critical spike). All
    errors form one key, which the ranges of time spread."""
    df = errors.withColumn("_k", F.lit(0))
    out = sliding_count(df, ["_k"], ts, R.ERROR_SPIKE_WINDOW_S, name="errors_5m")
    out = out.withColumn("spike", F.col("errors_5m") > R.ERROR_SPIKE_MAX)
    if critical is not None:
        crit = sliding_count(df.where(critical), ["_k"], ts, R.ERROR_SPIKE_WINDOW_S, name="critical_5m")
        out = out.join(crit.select("id", "critical_5m"), "id", "left").fillna(0, ["critical_5m"]).withColumn(
            "critical_spike", F.col("critical_5m") > R.CRITICAL_SPIKE_MAX)
    return out.drop("_k")


def error_patterns(errors: DataFrame, category: str = "category", message: str = "message") -> DataFrame:
    """A-22: pattern key = category + first 50 characters of the message;
    keep keys seen >= 3 times, flag those seen >= 5 times."""
    key = F.concat(F.col(category), F.lit(":"), F.left(F.col(message), F.lit(R.ERROR_PATTERN_PREFIX)))
    g = errors.groupBy(key.alias("pattern")).agg(F.count(F.lit(1)).alias("occurrences"))
    return g.where(F.col("occurrences") >= R.ERROR_PATTERN_KEEP).withColumn(
        "frequent", F.col("occurrences") >= R.ERROR_PATTERN_FLAG)


def dominant_by(df: DataFrame, keys: list[str], value: str, name: str = "dominant") -> DataFrame:
    """A-23: most frequent ``value`` per key (ties to the smaller value)."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct((F.lit(0) - F.col("_n")).alias("neg"), F.col(value))).alias(name),
                                F.max("_n").alias(f"{name}_count"))


# FIXED VALUES: error classes. Exception types first, then message words,
# checked in this order; anything else is a system error.
ERROR_TYPE_CLASSES = [("ValidationError", "validation_error"), ("ProcessingError", "parsing_error"),
                      ("BroadcastError", "websocket_error")]
ERROR_WORD_CLASSES = [
    ("database_error", ["database", "sql"]),
    ("websocket_error", ["websocket", "connection"]),
    ("analysis_error", ["analysis", "ai"]),
    ("network_error", ["network", "timeout"]),
    ("configuration_error", ["config", "setting"]),
]
ERROR_DEFAULT_CLASS = "system_error"
# severity checks, in order: (classes, words, severity)
ERROR_SEVERITY_RULES = [
    (["system_error"], ["critical", "fatal"], "critical"),
    (["database_error", "configuration_error"], ["security", "breach"], "high"),
    (["parsing_error", "analysis_error"], ["warning"], "medium"),
    (["websocket_error", "network_error"], [], "low"),
]
ERROR_SEVERITY_DEFAULT = "medium"
RECOVERY_ACTIONS = {
    "parsing_error": "fallback", "validation_error": "quarantine", "database_error": "retry",
    "websocket_error": "retry", "analysis_error": "skip", "system_error": "escalate",
}
RECOVERY_DEFAULT = "retry"


def classify_errors(errors: DataFrame, error_type: str = "error_type", message: str = "message",
                    overrides: DataFrame | None = None) -> DataFrame:
    """F-24/F-25: error class from the exception type, then from words of the
    lower-cased message; severity from class and words; recovery action of
    the class (default retry). X-03: ``overrides`` (error_class,
    recovery_action) go before the action of their class; the last row of a
    class in the order of the action's name counts."""
    low = F.lower(F.col(message))
    cls = None
    for t, name in ERROR_TYPE_CLASSES:
        cond = F.col(error_type) == t
        cls = F.when(cond, F.lit(name)) if cls is None else cls.when(cond, F.lit(name))
    for name, words in ERROR_WORD_CLASSES:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        cls = cls.when(cond, F.lit(name))
    out = errors.withColumn("error_class", cls.otherwise(F.lit(ERROR_DEFAULT_CLASS)))
    sev = None
    for classes, words, level in ERROR_SEVERITY_RULES:
        by_class = F.col("error_class").isin(classes)
        sev = F.when(by_class, F.lit(level)) if sev is None else sev.when(by_class, F.lit(level))
        if words:
            by_word = F.lit(False)
            for w in words:
                by_word = by_word | low.contains(w)
            sev = sev.when(by_word, F.lit(level))
    sev = sev.otherwise(F.lit(ERROR_SEVERITY_DEFAULT))
    act = F.coalesce(F.create_map(*[x for k, v in RECOVERY_ACTIONS.items() for x in (F.lit(k), F.lit(v))])[F.col("error_class")],
                     F.lit(RECOVERY_DEFAULT))
    out = out.withColumn("error_severity", sev).withColumn("recovery_action", act)
    if overrides is None:
        return out
    own = overrides.groupBy("error_class").agg(F.max("recovery_action").alias("_own"))  # a class or fewer each
    return out.join(F.broadcast(own), "error_class", "left").withColumn(
        "recovery_action", F.coalesce("_own", "recovery_action")).drop("_own").select(*out.columns)


# FIXED VALUES: recovery recommendations over the recent errors
RECENT_ERRORS = 50
CLASS_SHARE = 0.3
FAILED_RECOVERY_SHARE = 0.4
CLASS_RECOMMENDATIONS = {
    "database_error": "High database error rate - check database connectivity and performance",
    "parsing_error": "High parsing error rate - review log formats and parsing rules",
    "websocket_error": "High WebSocket error rate - check network stability and client connections",
    "analysis_error": "High analysis error rate - check AI service availability and performance",
}
FAILED_RECOVERY_RECOMMENDATION = "High recovery failure rate - review recovery strategies and system stability"
CRITICAL_RECOMMENDATION = "Critical errors detected - immediate investigation and resolution required"
NO_ERRORS_RECOMMENDATION = "No recent errors - system appears stable"
NORMAL_RECOMMENDATION = "System error patterns appear normal"


def recovery_recommendations(classified: DataFrame, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """A-24 over the 50 newest errors: a line per dominant class (> 30 %,
    in order of first appearance), one for > 40 % failed recoveries, one
    for any critical error; defaults when there is nothing to say."""
    from logweave.operators.windows import top_n

    recent = top_n(classified, RECENT_ERRORS, [F.col(ts).desc(), F.col(id_col).desc()])
    total = recent.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("recovery_successful")).alias("failed"),
                       F.count_if(F.col("error_severity") == "critical").alias("critical"))
    per_class = recent.groupBy("error_class").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(ts, id_col)).alias("first"))
    rec_map = F.create_map(*[x for k, v in CLASS_RECOMMENDATIONS.items() for x in (F.lit(k), F.lit(v))])
    cls = (per_class.crossJoin(F.broadcast(total)).where((F.col("c") > F.col("n") * CLASS_SHARE))
           .select(rec_map[F.col("error_class")].alias("rec"), "first").where(F.col("rec").isNotNull())
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "rec"))), lambda s: s["rec"]).alias("cls_recs")))
    extra = F.array_compact(F.array(
        F.when(F.col("failed") > F.col("n") * FAILED_RECOVERY_SHARE, F.lit(FAILED_RECOVERY_RECOMMENDATION)),
        F.when(F.col("critical") > 0, F.lit(CRITICAL_RECOMMENDATION))))
    recs = F.concat(F.coalesce(F.col("cls_recs"), F.array().cast("array<string>")), extra)
    final = (F.when(F.col("n") == 0, F.array(F.lit(NO_ERRORS_RECOMMENDATION)))
             .when(F.size(recs) == 0, F.array(F.lit(NORMAL_RECOMMENDATION))).otherwise(recs))
    return total.crossJoin(cls).select("n", final.alias("recommendations"))
