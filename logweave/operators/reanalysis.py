"""Re-analysis of a list of events with an upsert into the stored table (J-12,
U-05).

The table of analyses is partitioned by day. The events asked for are found by
a semi join and scored again; only the days that hold one of them are read and
rewritten (their other rows as they are), by a dynamic partition overwrite that
Spark stages and swaps in at commit. Days without such an event keep their
files. Nothing but the list of touched days reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.ingest import analysis_rows, score_events
from logweave.session import cut_lineage

SALTS = 16


def rules_analysis(events: DataFrame, at) -> DataFrame:
    return analysis_rows(score_events(events, at))


def reanalyse(spark: SparkSession, path: str, events: DataFrame, ids: DataFrame, at, *, id_col: str = "id",
              day: str = "event_date", score: Callable[[DataFrame, object], DataFrame] = rules_analysis) -> DataFrame:
    """Score the events of ``ids`` again at ``at`` and put the results into the
    table at ``path``: in place of the analysis of the same event, or beside
    the others where it had none. Returns (id, found) of every id asked for.

    ``score(events, at)`` gives the analyses of events (the rules' by default).
    """
    asked = ids.select(F.col(id_col).alias("id")).distinct()
    hit = cut_lineage(events.join(asked, "id", "left_semi"))
    fresh = score(hit, at).join(hit.select(F.col("id").alias("event_id"), day), "event_id")
    touched = [r[day] for r in hit.select(day).distinct().collect()]  # one entry per partition
    if touched:
        table = spark.read.parquet(path)
        rest = table.where(F.col(day).isin(touched)).join(hit.select(F.col("id").alias("event_id")), "event_id", "left_anti")
        rows = rest.unionByName(fresh.select(*table.columns))
        # a busy day is written by several tasks
        salt = F.pmod(F.xxhash64("event_id"), F.lit(SALTS))
        (rows.repartition(F.col(day), salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(day).parquet(path))
    return asked.join(hit.select("id", F.lit(True).alias("found")).distinct(), "id", "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("found"))

