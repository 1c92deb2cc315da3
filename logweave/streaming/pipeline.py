"""One parse stream with several sinks (T-03, T-04, T-09 to T-11, T-15).

Each micro-batch of arriving files is validated, parsed, categorised and scored
once and written once; the sinks are made from that written batch: events,
their analyses, rejected lines, alert rule matches, and counts per minute of
failed logins, errors and component samples. Every sink writes a batch in
overwrite mode, so a batch that runs again after a failure replaces itself, and
a stream started again on the same root goes on where it stopped: each line is
parsed once.

Windows are read from the counts per minute (``merge.sliding_counts``). No
watermark closes them: late rows correct their windows, and the last windows
are there as soon as their rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.sanitize import entry_verdict
from logweave.operators.alerts import match_rules
from logweave.plans import store
from logweave.plans.ingest import analysis_rows, parse_raw_lines, score_events
from logweave.sources.tables import read_table
from logweave.streaming.merge import MergeTable, sliding_counts
from logweave.streaming.stream import EVENTS_SCHEMA, stream_lines

ERROR_CATEGORIES = ("kernel", "security")
MAX_BYTES = 256 << 20
# batches that a dataset's arrivals are replayed in, about
REPLAY_BATCHES = 8

MINUTE_TABLES = {
    "login_minutes": ("account string, minute timestamp_ntz, attempts bigint", ["account", "minute"], ["attempts"]),
    "error_minutes": ("minute timestamp_ntz, errors bigint", ["minute"], ["errors"]),
    "component_minutes": ("component string, minute timestamp_ntz, events bigint, latency double",
                          ["component", "minute"], ["events", "latency"]),
}


def staged_arrivals(spark: SparkSession, sf_dir: str) -> str:
    """Stand-in for a folder of arriving files: events of days 1-10, those from
    day 21 on, and last those of days 11-20, which come late. Written once for
    a dataset."""
    root = store._root(spark, sf_dir, "arrivals") + "/arrivals"
    if not store._exists(spark, f"{root}/_DONE"):
        day = F.dayofmonth("ts")
        events = read_table(spark, sf_dir, "events")
        for i, part in enumerate((day <= 10, day > 20, (day > 10) & (day <= 20))):
            events.where(part).write.mode("overwrite").parquet(f"{root}/part{i}")
        store._touch(spark, f"{root}/_DONE")
    return root


def arrivals(spark: SparkSession, folder: str, **trigger) -> DataFrame:
    """Files of ``folder`` as a stream; a batch takes ``maxBytesPerTrigger``
    (or another limit of the file source) at most."""
    limit = trigger or {"maxBytesPerTrigger": MAX_BYTES}
    return (spark.readStream.schema(EVENTS_SCHEMA).options(**limit).option("recursiveFileLookup", "true").parquet(folder))


def files_a_batch(spark: SparkSession, folder: str) -> int:
    """Files that a batch of a replay takes: every batch costs as many writes,
    so there are no more batches where there are more files."""
    files = spark.read.schema(EVENTS_SCHEMA).option("recursiveFileLookup", "true").parquet(folder).inputFiles()
    return max(2, -(-len(files) // REPLAY_BATCHES))


def minute_table(spark: SparkSession, root: str, name: str) -> MergeTable:
    schema, keys, sums = MINUTE_TABLES[name]
    return MergeTable(spark, f"{root}/{name}", schema, keys, sums=sums)


def _minute(c: str):
    return F.date_trunc("minute", F.col(c)).cast("timestamp_ntz").alias("minute")


def run_ingest(events: DataFrame, root: str, rules: DataFrame, ref_ts=R.REF_TS) -> None:
    """Run the stream over all that is there into the tables below ``root``."""
    spark = events.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        lines = stream_lines(batch).withColumn("verdict", entry_verdict(F.col("line")))
        samples = batch.select(F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string")).alias("component"),
                               F.col("value").alias("latency"), _minute("ts"))
        scored = score_events(parse_raw_lines(lines, ref_ts), ref_ts).drop("ts")
        with store.wide_projection(batch.sparkSession):  # a batch has a session of its own
            scored.write.mode("overwrite").parquet(f"{root}/parsed/batch={batch_id}")
        done = spark.read.parquet(f"{root}/parsed/batch={batch_id}")

        def sink(name: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        valid = done.where("valid")
        sink("analysis", analysis_rows(valid))
        sink("rejects", done.where(~F.col("valid")).select("raw_log_id", "line_no", "line", "verdict"))
        found = valid.select("id", "timestamp", "source", "category", "severity_score")
        sink("rule_matches", match_rules(found, rules).select("id", "rule_name", "source", "category", "timestamp"))
        failed = valid.where(F.col("message").startswith("Failed password")).select(
            F.regexp_extract("message", r"for (\S+) from", 1).alias("account"), _minute("timestamp"))
        errors = valid.where(F.col("category").isin(*ERROR_CATEGORIES)).select(_minute("timestamp"))
        one = F.lit(1).cast("long")
        for name, rows in (("login_minutes", failed.withColumn("attempts", one)),
                           ("error_minutes", errors.withColumn("errors", one)),
                           ("component_minutes", samples.withColumn("events", one))):
            table = minute_table(spark, root, name)
            table.put(rows, batch_id)
            table.compact()

    (events.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{root}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A sink's rows over all batches; ``events`` are the valid parsed lines."""
    if name in MINUTE_TABLES:
        return minute_table(spark, root, name).read()
    if name == "events":
        return spark.read.parquet(f"{root}/parsed").where("valid").drop("batch", "valid")
    return spark.read.parquet(f"{root}/{name}").drop("batch")


def ingested(spark: SparkSession, sf_dir: str, rules: DataFrame, ref_ts=R.REF_TS) -> str:
    """Root of the stream's tables of a dataset; runs over files that came
    since the last time only."""
    root = store._root(spark, sf_dir, f"{ref_ts}|stream") + "/stream"
    folder = staged_arrivals(spark, sf_dir)
    run_ingest(arrivals(spark, folder, maxFilesPerTrigger=files_a_batch(spark, folder)), root, rules, ref_ts)
    return root


def failed_login_windows(spark: SparkSession, root: str) -> DataFrame:
    """T-09: failed logins per account in windows of 5 minutes, one a minute."""
    return sliding_counts(table(spark, root, "login_minutes"), ["account"], "attempts")


def error_windows(spark: SparkSession, root: str) -> DataFrame:
    """T-10: errors in windows of 5 minutes, one a minute; ``spike`` above 20."""
    w = sliding_counts(table(spark, root, "error_minutes"), [], "errors")
    return w.select("window_start", (F.col("window_start") + F.make_dt_interval(mins=F.lit(5))).alias("window_end"),
                    "errors", (F.col("errors") > R.ERROR_SPIKE_MAX).alias("spike"))


def component_minutes(spark: SparkSession, root: str) -> DataFrame:
    """T-11: samples and mean latency per component and minute."""
    return table(spark, root, "component_minutes").select(
        "component", "minute", "events", F.round(F.col("latency") / F.col("events"), 6).alias("avg_latency"))
