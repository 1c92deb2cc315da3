"""Aggregations (A-01..A-37) as DataFrame jobs.

All of them are partial + final hash aggregates (map-side combine), so a hot
key costs one partial row per task, not a shuffle of its rows. Where the
reference scans one table several times for several single-key counts, one
``GROUPING SETS`` pass replaces them (``grouping_sets_counts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.parse import lit_ts
from logweave.operators.windows import top_n


def ingestion_stats(raw: DataFrame, content: str = "line", source: str = "source_name") -> DataFrame:
    """A-01: entries, characters, distinct sources."""
    return raw.agg(F.count(F.lit(1)).alias("total_entries"), F.sum(F.length(content)).alias("total_chars"),
                   F.countDistinct(source).alias("unique_sources"))


def top_counts(df: DataFrame, key: str, n: int = 10, name: str = "n") -> DataFrame:
    """A-02 / A-12: counts per key, the ``n`` largest (ties by key)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return top_n(counts, n, [F.col(name).desc(), F.col(key).asc()])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A-03 / U-01: row counts of several tables as one union."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(events: DataFrame, analysis: DataFrame) -> DataFrame:
    """A-04: analysed / total x 100 (0 when there are no events). Both sides
    grow with the events, so neither is broadcast (ids of a table that is small
    on disk would be)."""
    analysed = analysis.select(F.col("event_id").alias("id"), F.lit(1).alias("_a"))
    j = events.select("id").join(analysed.hint("merge"), "id", "left")
    return j.agg(F.count(F.lit(1)).alias("total_events"), F.count("_a").alias("analyzed_events")).select(
        "total_events", "analyzed_events",
        F.when(F.col("total_events") > 0, F.round(F.col("analyzed_events") * 100.0 / F.col("total_events"), 6))
        .otherwise(F.lit(0.0)).alias("coverage_pct"))


def realtime_stats(events: DataFrame, ref_ts=R.REF_TS, value: str = "processing_time") -> DataFrame:
    """A-05 in one pass: totals, last 24 h, events per hour, mean time."""
    ref = lit_ts(ref_ts)
    last24 = (F.col("timestamp") >= ref - F.expr("INTERVAL 24 HOURS")) & (F.col("timestamp") <= ref)
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(last24).alias("events_last_24h"),
        F.round(F.count_if(last24) / F.lit(24.0), 6).alias("events_per_hour"),
        F.round(F.avg(F.col(value)), 6).alias("avg_processing_time"))


def grouping_sets_counts(df: DataFrame, dims: list[str], measure: Column | None = None) -> DataFrame:
    """One pass over ``df`` for a count per value of each dimension plus the
    grand total: rows ``(dimension, value, n)``; ``dimension='total'`` for ()."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if measure is not None:
        aggs.append(F.sum(measure).alias("measure"))
    g = df.groupingSets([[d] for d in dims] + [[]], *dims).agg(*aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = F.lit("total")
    val = F.lit(None).cast("string")
    for d in reversed(dims):
        dim = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dim)
        val = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(val)
    return g.select(dim.alias("dimension"), val.alias("value"), *[a for a in ["n", "measure"] if a in g.columns])


def rate_by(df: DataFrame, key: str, ok: Column, bad: Column) -> DataFrame:
    """A-07: per key ok/bad counts and ok / max(ok + bad, 1)."""
    g = df.groupBy(key).agg(F.count_if(ok).alias("sent"), F.count_if(bad).alias("failed"))
    return g.withColumn("success_rate", F.round(F.col("sent") / F.greatest(F.col("sent") + F.col("failed"), F.lit(1)), 6))


def daily_summary(scored: DataFrame) -> DataFrame:
    """A-10 per day: total, analysed, mean severity, high (>= 7), most
    common category (ties to the smaller name)."""
    per_cat = scored.groupBy("event_date", "category").agg(F.count(F.lit(1)).alias("_n"))
    top_cat = per_cat.groupBy("event_date").agg(
        F.min_by("category", F.struct((F.lit(0) - F.col("_n")).alias("neg"), F.col("category"))).alias("top_category"))
    day = scored.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("total_events"), F.count("severity_score").alias("analyzed_events"),
        F.round(F.avg("severity_score"), 6).alias("avg_severity"),
        F.count_if(F.col("severity_score") >= R.HIGH_SEVERITY).alias("high_severity_events"))
    return day.join(top_cat, "event_date")


def severity_histogram(scored: DataFrame) -> DataFrame:
    """A-11: counts for severity 1..10, zero buckets kept."""
    spark = scored.sparkSession
    buckets = spark.range(1, 11).select(F.col("id").cast("int").alias("severity_score"))
    counts = scored.groupBy("severity_score").agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(F.broadcast(counts), "severity_score", "left").select(
        "severity_score", F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def upper_median(df: DataFrame, key: str | None, value: str, tie: str = "id") -> DataFrame:
    """A-14: avg/min/max and the median as the reference takes it, element
    ``n div 2`` (0-based) of the sorted values, i.e. the upper median.

    Exact and distributed: every value gets its rank inside its key from
    ``row_number_at_scale`` (range partitions + offsets, so a key holding a
    third of the rows is ranked by many tasks) and the row at rank
    ``n div 2 + 1`` is kept. No group is ever collected or sorted in one task.
    """
    from logweave.operators.windows import row_number_at_scale

    keys = [key] if key else []
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("avg_value"),
                                  F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    ranked = row_number_at_scale(df.where(F.col(value).isNotNull()).select(*keys, value, tie), keys, [value, tie], "_r")
    n_of = stats.select(*keys, "n")
    ranked = ranked.join(n_of, keys, "inner") if keys else ranked.crossJoin(F.broadcast(n_of))
    med = ranked.where(F.col("_r") == F.floor(F.col("n") / 2) + 1).select(*keys, F.col(value).alias("median_value"))
    return stats.join(med, keys, "left") if keys else stats.crossJoin(med)


def exploded_counts(df: DataFrame, array_col: str, n: int = 10, name: str = "recommendation") -> DataFrame:
    """A-27: distinct elements of an array column by frequency, top ``n``."""
    ex = df.select(F.explode(array_col).alias(name))
    return top_counts(ex, name, n, "n")
