"""E1 — raw log text to stored, scored events, as one lazy plan.

``parse_and_score`` is narrow (no shuffle): every step is a projection or a
filter over the lines, so it runs in one stage per input split. ``events`` and
``analysis`` are two projections of the same scored plan; writers persist both
(``logweave.sources.sinks``) and readers join them back on ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions import severity as sev
from logweave.functions.parse import lit_ts, parse_lines, split_lines

EVENT_COLUMNS = [
    "id", "raw_log_id", "line_no", "timestamp", "source", "message", "category",
    "pattern", "host", "process", "pid", "event_date",
]


def parse_raw_lines(lines: DataFrame, ref_ts=R.REF_TS) -> DataFrame:
    """Lines ``(raw_log_id, line_no, line, ...)`` -> all parse results
    (``valid`` tells events from failed lines)."""
    parsed = parse_lines(lines, "line", ref_ts)
    return (
        parsed.withColumn("id", F.concat_ws(":", F.col("raw_log_id"), F.col("line_no").cast("string")))
        .withColumnRenamed("event_ts", "timestamp")
        .withColumn("event_date", F.to_date("timestamp"))
    )


def ingest_texts(texts: DataFrame, content: str = "content", source: str = "source", ref_ts=R.REF_TS) -> DataFrame:
    """S-02: pasted texts with a source label -> their lines parsed, with
    ``raw_log_id`` (a hash of label and text: a text pasted again is the same
    raw log) and ``source_label``. Blank texts have no lines."""
    raw = texts.select(F.sha2(F.concat_ws("|", source, content), 256).alias("raw_id"), F.col(content).alias("_content"),
                       F.col(source).alias("source_label")).dropDuplicates(["raw_id"])
    return parse_raw_lines(split_lines(raw, content="_content", id_col="raw_id", keep=["source_label"]), ref_ts)


def events_from_lines(lines: DataFrame, ref_ts=R.REF_TS) -> DataFrame:
    """P-05: keep valid events only."""
    return parse_raw_lines(lines, ref_ts).where("valid").drop("valid")


def score_events(events: DataFrame, ref_ts=R.REF_TS) -> DataFrame:
    """F-07..F-09 on parsed events; adds the analysis columns."""
    return sev.score(events).withColumn("analyzed_at", lit_ts(ref_ts))


def analysis_rows(scored: DataFrame) -> DataFrame:
    """The ``ai_analysis`` projection of scored events."""
    return scored.select(
        F.concat(F.lit("an_"), F.col("id")).alias("analysis_id"), F.col("id").alias("event_id"),
        "severity_score", "explanation", "recommendations", "analyzed_at",
    )
