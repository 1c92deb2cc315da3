"""Alert throttle (T-05, T-06): at most one alert per key every M minutes.

Sequential rule: per key, in time order, the first event is kept; every
later event is kept when it comes at least M after the last kept one. The
kept events are therefore the chain ``first, nxt(first), nxt(nxt(first))..``
where ``nxt(e)`` is the first event of the key at or after ``t(e) + M``.

Exact plan, with no group ever handled by one task:

1. ``nxt`` by a bucketed as-of step. Time is cut in buckets of width M; the
   answer for an event of bucket b lies in bucket b+1 (first event at or
   after t+M there: a window over the queries and events of that one bucket)
   or is the first event of the next non-empty bucket (a window over the
   per-bucket summaries, one row per non-empty bucket).
2. An event M or more after the one before it is kept whatever came before,
   so a key falls into segments that start at such events (found by the same
   buckets: the event before lies in the own bucket or is the last one of the
   bucket before). Chains start at all of them and stop at the next one.
3. The chains by pointer doubling: P holds their prefixes and J the 2^i-th
   successor of every event; each round adds J(P) to P and squares J. After
   ceil(log2(longest chain within a segment)) rounds P is complete. Each round
   is two joins over the events, checkpointed into the shared folder.

Rows that ``bypass`` the throttle (failures) are sent and leave the keys' times
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import cut_lineage

MAX_ROUNDS = 64


def next_allowed(events: DataFrame, key: str, ts: str, id_col: str, minutes: str, unit_seconds: int = 60) -> DataFrame:
    """``(id, key, nxt, start)``: for each event the id of the first event of
    its key at or after ``ts + minutes`` (ordered by time, then id), or NULL,
    and whether the event before it is at least that far away."""
    m_us = F.col(minutes).cast("long") * (unit_seconds * 1_000_000)
    ev = events.select(F.col(key).alias("_k"), F.col(id_col).alias("_id"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), m_us.alias("_m"))
    ev = ev.withColumn("_b", F.floor(F.col("_t") / F.col("_m")).cast("long"))
    queries = ev.select("_k", (F.col("_b") + 1).alias("_b"), (F.col("_t") + F.col("_m")).alias("_t"),
                        F.lit(0).alias("_kind"), F.col("_id").alias("_qid"), F.lit(None).cast("string").alias("_cid"))
    cands = ev.select("_k", "_b", "_t", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_qid"),
                      F.col("_id").alias("_cid"))
    # walked from the latest row back, the last candidate so far is the first one
    # at or after a query; the frame only grows, so a bucket costs one pass
    w = (Window.partitionBy("_k", "_b").orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_cid"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_next = (queries.unionByName(cands).withColumn("_hit", F.last("_cid", ignorenulls=True).over(w))
               .where(F.col("_kind") == 0).select(F.col("_qid").alias("_id"), "_hit"))
    # per non-empty bucket: its first event and the first event of the next non-empty bucket
    summ = ev.groupBy("_k", "_b").agg(F.min_by("_id", F.struct("_t", "_id")).alias("_first"), F.max("_t").alias("_last"))
    wb = Window.partitionBy("_k").orderBy("_b")
    summ = summ.withColumn("_next_first", F.lead("_first").over(wb)).withColumn("_last_before", F.lag("_last").over(wb))
    s_next = summ.select("_k", (F.col("_b") - 1).alias("_b"), F.col("_next_first").alias("_after_b1"),
                         F.lit(True).alias("_b1_exists"))
    s_same = summ.select("_k", "_b", F.col("_next_first").alias("_after_b"), "_last_before")
    before = F.lag("_t").over(Window.partitionBy("_k", "_b").orderBy("_t", "_id"))
    out = (ev.withColumn("_before", before).join(in_next, "_id", "left").join(s_next, ["_k", "_b"], "left").join(s_same, ["_k", "_b"], "left"))
    fallback = F.when(F.col("_b1_exists"), F.col("_after_b1")).otherwise(F.col("_after_b"))
    before = F.coalesce("_before", "_last_before")
    return out.select(F.col("_id").alias("id"), F.col("_k").alias("key"), F.coalesce("_hit", fallback).alias("nxt"),
                      (before.isNull() | (F.col("_t") - before >= F.col("_m"))).alias("start"))


def chains(linked: DataFrame) -> DataFrame:
    """Ids of the starts of ``linked`` (id, nxt, start) and of all that is
    reachable from them along ``nxt`` (pointer doubling)."""
    linked = cut_lineage(linked.select("id", "nxt", "start"))
    starts = linked.where("start").select("id")
    # a chain that comes to a start ends there: that one has a chain of its own
    jump = cut_lineage(linked.select("id", F.col("nxt").alias("j")).where(F.col("j").isNotNull())
                       .join(starts.withColumnRenamed("id", "j"), "j", "left_anti").select("id", "j"))
    path, size = starts, -1
    for _ in range(MAX_ROUNDS):
        reach = path.join(jump, "id").select(F.col("j").alias("id"))
        path = cut_lineage(path.unionByName(reach).distinct())
        size, before = path.count(), size
        if size == before:
            return path
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, F.col("a.j") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.j").alias("j")))
    raise RuntimeError("throttle chain did not converge")


def throttle(events: DataFrame, key: str, ts: str, id_col: str, minutes: str, *, unit_seconds: int = 60,
             bypass: Column | None = None) -> DataFrame:
    """Rows of ``events`` that are sent under the throttle (``minutes`` per
    row, or other units of ``unit_seconds``; 0 or NULL never throttles)."""
    free = F.coalesce(F.col(minutes), F.lit(0)) <= 0
    if bypass is not None:
        free = free | F.coalesce(bypass, F.lit(False))
    gated = events.where(~free)
    kept_ids = chains(next_allowed(gated, key, ts, id_col, minutes, unit_seconds))
    kept = gated.join(kept_ids.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return kept.unionByName(events.where(free))
