"""Stored tables of the E1 ingest job.

Parsing and scoring is the heavy, narrow part of the work; the reference runs
it once at ingest and answers every query from the stored ``events`` and
``ai_analysis`` tables. ``materialize`` does the same: it writes the parsed and
scored events of a dataset as parquet (partitioned by ``event_date``) into the
shared folder named by ``spark.checkpoint.dir`` and later reads come from
there. The write goes to a fresh folder and is published by a marker file, so
a lost executor or a concurrent writer never leaves a half table behind.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.session import ensure_checkpoint_dir
from logweave.sources.tables import read_table

_VERSION_MODULES = ("logweave.rules", "logweave.functions.parse", "logweave.functions.categorize",
                    "logweave.functions.severity", "logweave.sources.loglines", "logweave.sources.files",
                    "logweave.plans.ingest", "logweave.plans.store", "logweave.operators.alerts",
                    "logweave.streaming.stream", "logweave.streaming.merge", "logweave.streaming.pipeline",
                    "logweave.streaming.throttled")


def _code_version() -> str:
    import importlib

    h = hashlib.sha1()
    for m in _VERSION_MODULES:
        h.update(inspect.getsource(importlib.import_module(m)).encode())
    return h.hexdigest()[:12]


def _root(spark: SparkSession, sf_dir: str, ref_ts) -> str:
    base = ensure_checkpoint_dir(spark)
    key = hashlib.sha1(f"{sf_dir}|{_inputs(spark, sf_dir)}|{ref_ts}|{_code_version()}".encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/logweave-store/{key}"


def _inputs(spark: SparkSession, sf_dir: str) -> str:
    """Path, length and modification time of every file of the tables that
    are stored or staged, so that changed data gets a store of its own."""
    found = []
    for table in ("events", "documents"):
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{table}.parquet")
        if fs.exists(p):
            found += [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(p)]
    return "|".join(sorted(found))


def _fs(spark: SparkSession, path: str):
    """Hadoop FileSystem of ``path`` (local, HDFS or object store alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    fs, p = _fs(spark, src)
    return bool(fs.rename(p, _fs(spark, dst)[1]))


def _touch(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def _published(spark: SparkSession, root: str) -> bool:
    return _exists(spark, f"{root}/_PUBLISHED")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin spread of an input that arrives in fewer splits than the
    session has cores (small files); large inputs keep their own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# events rendered and parsed by one task
ROWS_PER_TASK = 50_000


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` rows in tasks of about ``ROWS_PER_TASK``, cut by time. The
    splits of a file say nothing of its row groups (a large one is read by one
    task however many splits there are), so the rows are counted (from the
    footers). A task's rows fall on few days, so a table partitioned by day gets
    few files a task."""
    ev = read_table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, -(-ev.count() // ROWS_PER_TASK))
    return ev.repartitionByRange(tasks, "ts", "event_id")


@contextmanager
def wide_projection(spark: SparkSession):
    """The parse + category + scoring projection is wider than one JVM method
    can hold (64 KB), so whole-stage fusion would only fail to compile and fall
    back; within this, per-expression code generation (which splits methods) is
    used instead."""
    prev = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", prev)


def materialize(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS, force: bool = False) -> dict[str, str]:
    """Write (once, or again with ``force``) the parsed and scored lines of
    ``sf_dir``; return the table path ``{"scored": ...}``."""
    from logweave.plans.ingest import parse_raw_lines, score_events
    from logweave.sources.loglines import event_log_lines

    root = _root(spark, sf_dir, ref_ts)
    paths = {"scored": f"{root}/scored"}
    if force or not _published(spark, root):
        lines = event_log_lines(spark, sf_dir, spread_events(spark, sf_dir))
        # every line is kept with its ``valid`` flag (parse stats, rejects);
        # the analysis columns only mean something on valid rows
        scored = score_events(parse_raw_lines(lines, ref_ts), ref_ts)
        tmp = f"{root}/scored.tmp-{os.getpid()}-{uuid.uuid4().hex[:8]}"
        with wide_projection(spark):
            scored.write.mode("overwrite").partitionBy("event_date").parquet(tmp)
        if force or not _published(spark, root):
            if _exists(spark, paths["scored"]):
                _rename(spark, paths["scored"], f"{tmp}.old")
            _rename(spark, tmp, paths["scored"])
            _touch(spark, f"{root}/_PUBLISHED")
    return paths


def parsed_lines(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS) -> DataFrame:
    """Every parsed line (valid or not) with its analysis columns."""
    return spark.read.parquet(materialize(spark, sf_dir, ref_ts)["scored"])


def scored_events(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS) -> DataFrame:
    """Parsed + scored events (one row per valid line) from the store."""
    return parsed_lines(spark, sf_dir, ref_ts).where("valid").drop("valid")


def events(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS) -> DataFrame:
    """The ``events`` table (no analysis columns)."""
    return scored_events(spark, sf_dir, ref_ts).select(
        "id", "raw_log_id", "line_no", "timestamp", "source", "message", "category", "pattern",
        "host", "process", "pid", "event_date", "event_id", "user_id", "source_name", "ingested_at")


def analysis(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS) -> DataFrame:
    """The ``ai_analysis`` table. Stand-in rule: analyses exist for events
    whose source event id is not a multiple of 4, so a quarter of the events
    have none and outer joins and coverage have something to show."""
    from logweave.plans.ingest import analysis_rows

    scored = scored_events(spark, sf_dir, ref_ts)
    return analysis_rows(scored.where(F.col("event_id") % 4 != 0))


# rows of the parsed table that one bucket holds (bytes say little of them: the
# stored lines compress to a fraction of what a task sorts)
ROWS_PER_BUCKET = 250_000
MIN_BUCKETS = 8


def bucketed(spark: SparkSession, rows, schema: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table bucketed and sorted by ``key`` at ``path``: written from
    ``rows()`` once, after that only known to the session's catalog again.
    Tables with as many buckets join on their keys, and a lookup by key reads
    one bucket."""
    name = "lw_" + hashlib.sha1(path.encode()).hexdigest()[:20]
    if not _exists(spark, f"{path}/_SUCCESS"):
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (rows().repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
         .option("path", path).saveAsTable(name))
    elif not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def by_id(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS) -> tuple[DataFrame, DataFrame]:
    """S-07/J-01: (events, analyses) stored as two tables bucketed and sorted
    by the event's id, so that they are joined and looked up without a shuffle."""
    scored = materialize(spark, sf_dir, ref_ts)["scored"]
    buckets = max(MIN_BUCKETS, -(-spark.read.parquet(scored).count() // ROWS_PER_BUCKET))
    out = []
    for name, table, key in (("events", events, "id"), ("analysis", analysis, "event_id")):
        rows = table(spark, sf_dir, ref_ts)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        out.append(bucketed(spark, lambda rows=rows: rows, schema, f"{_root(spark, sf_dir, ref_ts)}/{name}_{buckets}", key, buckets))
    return out[0], out[1]


def day_counts(spark: SparkSession, sf_dir: str, ref_ts=R.REF_TS) -> dict:
    """Events per day, one entry per partition of the stored table (kept beside
    it, so that paging need not count again)."""
    path = f"{_root(spark, sf_dir, ref_ts)}/day_counts"
    if not _exists(spark, f"{path}/_SUCCESS"):
        events(spark, sf_dir, ref_ts).groupBy("event_date").count().coalesce(1).write.mode("overwrite").parquet(path)
    return {r["event_date"]: r["count"] for r in spark.read.parquet(path).collect()}
