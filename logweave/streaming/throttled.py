"""Throttles with keyed state (T-05, T-06 on streams).

A key's state is the time up to which it is shut and the alerts that wait: rows
come out of order, so an alert is decided only when the watermark (the newest
time so far less the delay) has passed it, in order of time and id, and the
result is that of the batch throttle. Every batch decides what the watermark has
passed, of keys without a new row too, and drops the state of a key that is open
again and has nothing waiting (its next alert is sent whatever the state), so
state is bounded by the watermark's delay and the longest interval. Alerts
without an interval or a time, and those that ``bypass`` (failures), are sent at
once and don't touch the state.

The state is a table, not a value in memory: a batch leaves its decisions, the
alerts that wait and the shut keys in a folder of its own, and the next batch
reads the last two. The alerts to decide are dealt by key and sorted by time (by
Spark, which spills), and one pass over them carries nothing but the times up to
which keys are shut, so a task's memory doesn't grow with the alerts of a key.
A batch that runs again replaces what it wrote.

What the watermark hasn't passed when a run ends stays in that table, where a
run that is started again finds it; ``decided_so_far`` decides it as if nothing
earlier came. Rows later than the watermark are not decided by the stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans import store

OUT = "id string, at bigint, sent boolean"
STATE = "until bigint, times array<bigint>, ids array<string>, gaps array<bigint>"
# rows that a batch writes: "decided" (id, at, sent), "waiting" (key, id, at, gap),
# "open" (key, until: keys that are still shut) and one "newest" (at)
ROWS = "key string, id string, at bigint, gap bigint, sent boolean, until bigint, kind string"
_ARROW = pa.schema([("key", pa.string()), ("id", pa.string()), ("at", pa.int64()), ("gap", pa.int64()),
                    ("sent", pa.bool_()), ("until", pa.int64()), ("kind", pa.string())])

# alerts that one task decides (a key is never split), and keys it holds before
# it drops those that are open again
ROWS_PER_TASK = 250_000
KEYS_HELD = 10_000


class Throttled(NamedTuple):
    """Alerts of a stream (key, id, at, gap, free) and the watermark's delay."""
    alerts: DataFrame
    delay: str


def fold(until: int | None, times: np.ndarray, gaps: np.ndarray) -> tuple[int | None, np.ndarray]:
    """Decide a key's alerts, in order of time: sent where the key is open."""
    sent, i, n = np.zeros(len(times), dtype=bool), 0, len(times)
    while i < n:
        if until is not None:
            i += int(times[i:].searchsorted(until))
            if i == n:
                break
        sent[i], until = True, int(times[i]) + int(gaps[i])
        i += 1
    return until, sent


def _batch(n: int, kind: str, **columns) -> pa.RecordBatch:
    columns["kind"] = pa.array([kind] * n, pa.string())
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def _decide(mark: int | None):
    """Decisions of alerts sorted by time, id and interval, after rows without
    time that hold the keys' ``until``; then the keys shut past ``mark``."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shut: dict[str | None, int] = {}
        many = KEYS_HELD
        for batch in batches:
            state = batch.filter(pc.and_(pc.is_null(batch.column("at")), pc.is_valid(batch.column("until"))))
            shut.update(zip(state.column("key").to_pylist(), state.column("until").to_pylist(), strict=True))
            batch = batch.filter(pc.is_valid(batch.column("at")))
            if not batch.num_rows:
                continue
            keys = batch.column("key").dictionary_encode(null_encoding="encode")
            codes, times, gaps = (c.to_numpy() for c in (keys.indices, batch.column("at"), batch.column("gap")))
            order, sent = np.argsort(codes, kind="stable"), np.zeros(batch.num_rows, dtype=bool)
            ends = np.bincount(codes, minlength=len(keys.dictionary)).cumsum().tolist()
            for k, start, end in zip(keys.dictionary.to_pylist(), [0, *ends], ends, strict=False):
                rows = order[start:end]
                shut[k], sent[rows] = fold(shut.get(k), times[rows], gaps[rows])
            yield _batch(batch.num_rows, "decided", id=batch.column("id"), at=batch.column("at"), sent=pa.array(sent))
            if len(shut) > many:  # what comes now is not earlier: keys open by now are as new ones
                shut = {k: until for k, until in shut.items() if until > times[-1]}
                many = max(KEYS_HELD, 2 * len(shut))
        last = [(k, until) for k, until in shut.items() if mark is not None and until > mark]
        for start in range(0, len(last), KEYS_HELD):
            k, until = zip(*last[start:start + KEYS_HELD], strict=True)
            yield _batch(len(k), "open", key=pa.array(k, pa.string()), until=pa.array(until, pa.int64()))

    return over


def _decided(alerts: DataFrame, mark: int | None, rows: int) -> DataFrame:
    """``ROWS`` of the waiting alerts and shut keys ``alerts``."""
    tasks = max(alerts.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return (alerts.select("key", "id", "at", "gap", "until").repartition(tasks, "key")
            .sortWithinPartitions("at", "id", "gap").mapInArrow(_decide(mark), ROWS))


def throttled(alerts: DataFrame, *, key: str, ts: str, id_col: str, seconds: str, delay: str,
              bypass: Column | None = None) -> Throttled:
    """The alerts of a stream, for ``run``; ``seconds`` is the interval of each
    alert's key (0 or null: none)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    free = (F.coalesce(F.col(seconds), F.lit(0)) <= 0) | at.isNull()
    if bypass is not None:
        free = free | F.coalesce(bypass, F.lit(False))
    return Throttled(alerts.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("string").alias("id"),
                                   at.alias("at"),
                                   (F.coalesce(F.col(seconds), F.lit(0)).cast("long") * 1_000_000).alias("gap"),
                                   free.alias("free")), delay)


def run(alerts: Throttled, root: str) -> None:
    """Run over all that is there; decisions (id, at in microseconds, sent) go
    to ``root/decisions`` and state to ``root/batches``."""
    spark = alerts.alerts.sparkSession
    fs, p = store._fs(spark, f"{root}/decisions")
    fs.mkdirs(p)
    delay = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"CAST('{alerts.delay}' AS INTERVAL)"))).first()[0]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        before = _rows(spark, root, [batch_id - 1] if batch_id else [])
        last = before.where("kind = 'newest'").agg(F.max("at")).first()[0]
        gated = batch.where("NOT free")
        n, newest = gated.agg(F.count(F.lit(1)), F.max("at")).first()
        newest = max((t for t in (last, newest) if t is not None), default=None)
        # a watermark is a whole millisecond
        late, mark = ((t // 1000 - delay) * 1000 if t is not None else None for t in (last, newest))
        known = before.where("kind = 'waiting'")
        # late if the watermark of the batches before has come to it
        wait = gated.where(F.col("at") > late) if late is not None else gated
        wait = wait.select("key", "id", "at", "gap").unionByName(known.select("key", "id", "at", "gap"))
        ready = wait.where(F.col("at") < mark).withColumn("until", F.lit(None).cast("long"))
        shut = before.where("kind = 'open'").select("key", "id", "at", "gap", "until")
        out = _decided(ready.unionByName(shut), mark, n + known.count())
        for kind, rows in (("decided", batch.where("free").select("id", "at", F.lit(True).alias("sent"))),
                           ("waiting", wait.where(F.col("at") >= mark)),
                           ("newest", spark.range(1).select(F.lit(newest).cast("long").alias("at")))):
            out = out.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        path, done = f"{root}/batches/batch={batch_id}", f"{root}/decisions/batch={batch_id}"
        out.write.mode("overwrite").partitionBy("kind").parquet(path)
        # the batch before is read again if this one is
        for old in (done, *(f"{root}/batches/batch={batch_id - 2}/kind={kind}" for kind in ("waiting", "open"))):
            fs, p = store._fs(spark, old)
            fs.delete(p, True)
        if store._exists(spark, f"{path}/kind=decided"):
            store._rename(spark, f"{path}/kind=decided", done)
        store._touch(spark, f"{path}/_DONE")

    (alerts.alerts.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{root}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def _rows(spark: SparkSession, root: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], ROWS)
    return (spark.read.schema(f"{ROWS}, batch bigint").option("basePath", f"{root}/batches")
            .parquet(*[f"{root}/batches/batch={k}" for k in batches]).drop("batch"))


def _batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that ended, in order."""
    fs, p = store._fs(spark, f"{root}/batches")
    ids = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)) if fs.exists(p) else []
    return [k for k in ids if store._exists(spark, f"{root}/batches/batch={k}/_DONE")]


def waiting(spark: SparkSession, root: str) -> DataFrame:
    """(until, times, ids, gaps) of each key's state after the last batch."""
    state = _rows(spark, root, _batches(spark, root)[-1:]).where("kind IN ('waiting', 'open')")
    alert = F.when(F.col("kind") == "waiting", F.struct("at", "id", "gap"))
    state = state.groupBy("key").agg(F.max("until").alias("until"), F.array_sort(F.collect_list(alert)).alias("alerts"))
    return state.select("until", F.col("alerts.at").alias("times"), F.col("alerts.id").alias("ids"), F.col("alerts.gap").alias("gaps"))


def decided_so_far(spark: SparkSession, root: str) -> DataFrame:
    """The stream's decisions and those of the alerts that still wait (one
    pass over a key's alerts)."""
    done = spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(f"{root}/decisions")
    state = waiting(spark, root).where(F.size("times") > 0)
    none = F.lit(None).cast("long")
    held = F.struct(F.lit(None).cast("string").alias("id"), none.alias("at"), none.alias("gap"), "until")
    alerts = F.transform(F.arrays_zip("times", "ids", "gaps"), lambda a: F.struct(
        a["ids"].alias("id"), a["times"].alias("at"), a["gaps"].alias("gap"), none.alias("until")))
    # a state is numbered before its alerts are rows
    rows = state.withColumn("key", F.monotonically_increasing_id().cast("string")).select("key", F.explode(F.concat(F.array(held), alerts)).alias("_a"))
    rest = _decided(rows.select("key", "_a.*"), None, state.agg(F.sum(F.size("times"))).first()[0] or 0)
    return done.unionByName(rest.select("id", "at", "sent"))


# rows of a staged file
ROWS_PER_FILE = 500_000


def stage_disordered(rows: DataFrame, root: str, ts: str, *, parts: int = 4, seconds: int = 7200) -> tuple[str, int]:
    """Stand-in for alerts that arrive up to ``seconds`` late: folder and files
    a part of arrivals, by a row's time and a delay from its hash. The rows are
    made once; the parts are written one after the other (a file stream goes by
    the files' times) and have as many files each, so that a batch of so many
    files is one part."""
    spark = rows.sparkSession
    if not store._exists(spark, f"{root}/_DONE"):
        made, names = f"{root}-made-{uuid.uuid4().hex[:8]}", rows.columns
        arrival = F.unix_seconds(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*names), F.lit(seconds))
        rows.withColumn("_arrival", arrival).write.parquet(made)
        there = spark.read.parquet(made)
        low, high = there.agg(F.min("_arrival"), F.max("_arrival")).first()
        there = there.withColumn("_part", F.floor((F.col("_arrival") - (low or 0)) * parts / ((high or 0) - (low or 0) + 1)))
        counts = {r["_part"]: r["count"] for r in there.groupBy("_part").count().collect() if r["_part"] is not None}
        files = max(1, -(-max(counts.values(), default=0) // ROWS_PER_FILE))
        for k in range(parts):
            path = f"{root}/part{k}"
            there.where(F.col("_part") == k).select(*names).repartition(files).write.mode("overwrite").parquet(path)
            for _ in range(files - _data_files(spark, path)):  # a task without rows has left none
                spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
        fs, p = store._fs(spark, made)
        fs.delete(p, True)
        store._touch(spark, f"{root}/_DONE")
    return root, _data_files(spark, f"{root}/part0")


def _data_files(spark: SparkSession, path: str) -> int:
    fs, p = store._fs(spark, path)
    return sum(1 for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
