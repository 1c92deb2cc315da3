"""Sinks and deletes: raw logs with id and time (S-03), appended notification
outcomes and audit rows (S-11, S-12), exports as JSON or text (S-08, S-13),
and deletes by age, by raw log and by expiry that rewrite the stored tables
(U-06, U-07, U-08).

A table is a parquet folder, partitioned by a date where rows are deleted by
age. A delete rewrites only the partitions that lose rows: those left with some
are overwritten dynamically (Spark stages the new files and swaps them in at
commit), those left with none are dropped. Nothing but the list of touched
dates reaches the driver, one entry per partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import ensure_checkpoint_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-sinks/{uuid.uuid4().hex}/{name}"


def store_raw_logs(logs: DataFrame, path: str, key: list[str], content: str = "content", source: str = "source",
                   at: str = "created_at") -> None:
    """S-03: append raw logs with an id (hash of key, source, time and
    content) and the day they came in."""
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in key], source, F.col(at).cast("string"), content)
    rows = logs.select(F.sha2(named, 256).alias("id"), F.col(content).alias("content"), F.col(source).alias("source"),
                       F.col(at).alias("created_at"), F.to_date(at).alias("created_date"))
    rows.write.mode("append").partitionBy("created_date").parquet(path)


def by_day(rows: DataFrame, day: str) -> DataFrame:
    """``rows`` brought together by day for a write: small days share a task,
    a large one is split by size (a rebalancing exchange)."""
    return rows.hint("rebalance", F.col(day))


def append_rows(rows: DataFrame, path: str, day_of: str | None = None, day: str = "row_date") -> None:
    """S-11/S-12: append rows, partitioned by the day of ``day_of`` where given.
    Rows are brought together by day first, so a batch adds few files a day; a
    day that holds most of the rows is split over tasks."""
    if day_of is None:
        rows.write.mode("append").parquet(path)
    else:
        dated = rows.withColumn(day, F.to_date(day_of))
        by_day(dated, day).write.mode("append").partitionBy(day).parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    """S-08: one JSON object per line."""
    rows.write.mode("errorifexists").json(path)


def export_text(rows: DataFrame, path: str, line: Column) -> None:
    """S-13: one text line per row."""
    rows.select(line.alias("value")).write.mode("errorifexists").text(path)


def _drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_where(spark: SparkSession, path: str, gone: Column, day: str) -> dict[str, int]:
    """Delete the rows of a table partitioned by ``day`` for which ``gone`` is
    true (null keeps the row); returns how many were kept and deleted."""
    table = spark.read.parquet(path)
    lost = F.coalesce(gone, F.lit(False))
    per_day = table.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("d")).collect()
    part = [r[day] for r in per_day if 0 < r["d"] < r["n"]]
    if part:
        (by_day(table.where(F.col(day).isin(part) & ~lost), day).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))
    for r in per_day:
        if r["d"] == r["n"]:
            _drop_folder(spark, f"{path}/{day}={r[day] if r[day] is not None else '__HIVE_DEFAULT_PARTITION__'}")
    deleted = sum(r["d"] for r in per_day)
    if deleted and deleted == sum(r["n"] for r in per_day):  # an empty table keeps its columns
        spark.createDataFrame([], table.schema).write.mode("append").parquet(path)
    return {"kept": sum(r["n"] for r in per_day) - deleted, "deleted": deleted}


def rewrite_without(spark: SparkSession, path: str, keys: DataFrame, on: str) -> DataFrame:
    """U-07: the table without the rows whose ``on`` is in ``keys``, written
    anew beside the old one and read back."""
    kept = fresh_path(spark, "kept")
    spark.read.parquet(path).join(keys, on, "left_anti").write.parquet(kept)
    return spark.read.parquet(kept)
