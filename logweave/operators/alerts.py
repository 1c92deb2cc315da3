"""Alert rules against events (J-07, J-09, J-11, F-13, F-14).

Rules are configuration (a handful to a few thousand rows). Their category
lists are exploded (empty = every category) so events join them on the
category as an equi-key; severity range and source list are residual
conditions. The rule side is broadcast behind a size check
(``broadcast_if_small``); past the bound the planner picks a shuffle
equi-join, never a nested loop. A missing analysis counts as severity 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.severity import alert_severity_label
from logweave.session import broadcast_if_small

RULE_SCHEMA = ("rule_name string, enabled boolean, min_severity int, max_severity int, categories array<string>, "
               "sources array<string>, channels array<string>, throttle_minutes int")
CHANNEL_SCHEMA = "channel string, enabled boolean"


def rules_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE_SCHEMA)


def channels_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CHANNEL_SCHEMA)


def by_category(table: DataFrame, categories: str = "categories") -> DataFrame:
    """One row per (entry, category): an empty list stands for every
    category. Categories are a closed set, so the theta condition "list is
    empty or contains the category" becomes an equi-join key and no
    nested-loop (cartesian) join is ever needed, whatever the table size."""
    every = F.array(*[F.lit(c) for c in R.CATEGORIES])
    return table.withColumn("_cat", F.explode(F.when(F.size(categories) == 0, every)
                                             .otherwise(F.array_distinct(categories))))


def _match_condition(ev_sev, category, source):
    return (
        (F.col("e.category") == F.col("r._cat"))
        & (F.col("r.min_severity") <= ev_sev) & (ev_sev <= F.col("r.max_severity"))
        & ((F.size("r.sources") == 0) | F.array_contains("r.sources", source))
    )


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """J-07: one row per (event, matching enabled rule): equi-join on the
    category, residual severity/source test."""
    ev = events.withColumn("_sev", F.coalesce(F.col("severity_score"), F.lit(R.DEFAULT_RULE_SEVERITY))).alias("e")
    r = broadcast_if_small(by_category(rules.where("enabled"))).alias("r")
    cond = _match_condition(F.col("e._sev"), F.col("e.category"), F.col("e.source"))
    return ev.join(r, cond, "inner").select("e.*", "r.rule_name", "r.channels", "r.throttle_minutes").drop("_sev")


def events_with_any_rule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """J-11: events that at least one enabled rule matches (semi join)."""
    ev = events.withColumn("_sev", F.coalesce(F.col("severity_score"), F.lit(R.DEFAULT_RULE_SEVERITY))).alias("e")
    r = broadcast_if_small(by_category(rules.where("enabled"))).alias("r")
    cond = _match_condition(F.col("e._sev"), F.col("e.category"), F.col("e.source"))
    return ev.join(r, cond, "left_semi").drop("_sev")


def channel_fanout(matches: DataFrame, channels: DataFrame) -> DataFrame:
    """J-09: one row per (match, channel) for channels that exist and are
    enabled."""
    ex = matches.withColumn("channel", F.explode("channels")).drop("channels")
    return ex.join(broadcast_if_small(channels.where("enabled").select("channel")), "channel", "inner")


def alert_text(df: DataFrame, prefix: str = "Security Alert") -> DataFrame:
    """F-13/F-14: alert subject and body per matched event. ``prefix`` is the
    product label of the subject (neutral by default). Without an analysis
    the severity label is taken at 5 and the analysis block is left out."""
    sev = F.coalesce(F.col("severity_score"), F.lit(R.DEFAULT_RULE_SEVERITY))
    label = alert_severity_label(sev)
    subject = F.concat(F.lit(prefix + ": "), label, F.lit(" - "), F.upper("category"))
    recs = F.array_join(F.transform("recommendations", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")
    analysis = F.when(F.col("severity_score").isNotNull(), F.concat_ws(
        "\n", F.lit(""), F.lit("AI Analysis:"),
        F.concat(F.lit("Severity Score: "), F.col("severity_score").cast("string"), F.lit("/10 ("), label, F.lit(")")),
        F.concat(F.lit("Explanation: "), F.col("explanation")), F.lit(""), F.lit("Recommendations:"), recs))
    body = F.concat_ws(
        "\n", F.lit("Security Event Detected"), F.lit(""),
        F.concat(F.lit("Timestamp: "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")),
        F.concat(F.lit("Source: "), F.col("source")), F.concat(F.lit("Category: "), F.upper("category")),
        F.concat(F.lit("Message: "), F.col("message")), analysis, F.lit(""),
        F.concat(F.lit("Event ID: "), F.col("id")), F.lit("Generated by real-time monitoring"))
    return df.withColumn("subject", subject).withColumn("body", body)


# key of updates whose category is null or outside the closed set
OTHER = "(other)"

CLIENT_FILTER_SCHEMA = ("client_id string, event_types array<string>, min_priority int, max_priority int, "
                        "categories array<string>, sources array<string>")


def client_fanout(updates: DataFrame, filters: DataFrame) -> DataFrame:
    """J-06/P-19: (update, client) pairs whose subscription filter matches;
    empty lists and unset bounds accept everything. Filters are broadcast
    behind the size check. Filters without categories take every update, one
    without a category or with an unknown one too: they meet updates on a key
    that is the category or, for those, ``OTHER``."""
    known = F.col("category").isin(R.CATEGORIES)
    keyed = updates.withColumn("_any", F.when(known, F.col("category")).otherwise(F.lit(OTHER)))
    listed = filters.where(F.size("categories") > 0).withColumn("_cat", F.explode(F.array_distinct("categories")))
    every = F.array(*[F.lit(c) for c in [*R.CATEGORIES, OTHER]])
    open_ = filters.where(F.size("categories") == 0).withColumn("_cat", F.explode(every))
    by_list = _fanout(keyed, listed, F.col("u.category"))
    return by_list.unionByName(_fanout(keyed, open_, F.col("u._any"))).drop("_any")


def _fanout(updates: DataFrame, filters: DataFrame, key: F.Column) -> DataFrame:
    f = broadcast_if_small(filters).alias("f")
    u = updates.alias("u")
    cond = (
        (key == F.col("f._cat"))
        & ((F.size("f.event_types") == 0) | F.array_contains("f.event_types", F.col("u.event_type")))
        & (F.coalesce(F.col("f.min_priority"), F.lit(0)).eqNullSafe(0) | (F.col("u.priority") >= F.col("f.min_priority")))
        & (F.coalesce(F.col("f.max_priority"), F.lit(0)).eqNullSafe(0) | (F.col("u.priority") <= F.col("f.max_priority")))
        & ((F.size("f.sources") == 0) | F.array_contains("f.sources", F.col("u.source")))
    )
    return u.join(f, cond, "inner").select("u.*", "f.client_id")


def result_type(success: F.Column, n_errors: F.Column, n_warnings: F.Column) -> F.Column:
    """F-28: failure / partial_success / warning / success."""
    return (F.when(~success, "failure").when(n_errors > 0, "partial_success")
            .when(n_warnings > 0, "warning").otherwise("success"))


def result_priority(rtype: F.Column, validation: F.Column) -> F.Column:
    """F-28: broadcast priority from the result type and validation verdict."""
    return (F.when(rtype == "failure", "high").when(rtype.isin("partial_success", "warning"), "medium")
            .when(validation == "suspicious", "medium").otherwise("low"))
