"""Structured Streaming versions of the ingest and detections (T-01..T-16).

The same column functions as the batch path run on a streaming DataFrame:
lines are rendered per micro-batch and written to a sink whose checkpoint sits
in the shared ``spark.checkpoint.dir`` folder, so a restarted query resumes
where it stopped. ``pipeline`` parses them once for all sinks; ``throttled``
keeps keyed state; ``merge`` holds tables that batches merge into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import ensure_checkpoint_dir
from logweave.sources.loglines import N_RAW_LOGS, render_line

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-streams/{name}-{uuid.uuid4().hex[:10]}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """T-02/T-03: new ``events`` files of the folder as a file stream
    (glob filter picks the table's files, trigger size bounds each batch)."""
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", "events*.parquet").parquet(sf_dir.rstrip("/")))


def stream_lines(events: DataFrame) -> DataFrame:
    """Rendered lines of a micro-batch, spread round-robin over the cores (a
    file arrives as few splits; the parse is the CPU-heavy step)."""
    events = events.repartition(events.sparkSession.sparkContext.defaultParallelism)
    return events.select(
        "event_id", "user_id", "ts",
        F.concat(F.lit("rl_"), (F.col("event_id") % N_RAW_LOGS).cast("string")).alias("raw_log_id"),
        F.col("event_id").alias("line_no"),
        render_line(F.col("event_id"), F.col("ts"), F.col("user_id"), F.col("event_type"), F.col("value")).alias("line"),
    )


def run_available(df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a streaming query over everything available now into a parquet
    sink; return the sink path."""
    spark = df.sparkSession
    root = _run_dir(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True).start(f"{root}/out"))
    q.awaitTermination()
    return f"{root}/out"


def stream_tail(spark: SparkSession, glob_path: str, starting: str = "earliest") -> DataFrame:
    """T-01: lines appended to the matching files, through the ``logtail``
    source, until nothing new is available; returns the sink read back."""
    from logweave.sources import tail

    tail.register(spark)
    src = (spark.readStream.format("logtail").option("path", glob_path).option("startingPosition", starting).load())
    return spark.read.parquet(run_available(src, "tail"))
