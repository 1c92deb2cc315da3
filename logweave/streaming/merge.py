"""Tables that a stream merges into without losing late rows.

A batch's rows go below ``part/batch=<id>`` in overwrite mode, so a batch that
runs again replaces what it wrote. Nothing is held back for a watermark: a late
row is one more partial of its key, and reading merges the partials (sums, or
the last row of a key). ``compact`` writes the merged rows of all batches so
far as ``base/upto=<id>`` and drops what it replaced, so a reader meets one
base and the few batches after it; a base counts only when its write has ended,
so a failure between the steps loses nothing.

Merging is a grouped aggregate with partial aggregation (sums), or
``max_by`` over the order columns (last rows): no row is collected anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.store import _exists, _fs

COMPACT_EVERY = 50


def _ended(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><n>`` below ``path`` whose write ended."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[len(prefix):]) for n in names
                  if n.startswith(prefix) and _exists(spark, f"{path}/{n}/_SUCCESS"))


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@dataclass
class MergeTable:
    """Rows of ``schema`` merged by ``keys``: ``sums`` are added up; or the row
    that is last by ``order`` (then by batch) stands for its key. With ``ttl``
    (an interval) rows whose ``ts`` is older than the newest less ``ttl`` leave
    the table when it is compacted, and are not read before that either."""

    spark: SparkSession
    root: str
    schema: str
    keys: list[str]
    sums: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    ts: str | None = None
    ttl: str | None = None

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """One batch's rows, merged among themselves."""
        rows = self._merged(rows.withColumn("_batch", F.lit(batch_id).cast("long")))
        rows.write.mode("overwrite").parquet(f"{self.root}/part/batch={batch_id}")

    def read(self) -> DataFrame:
        """The merged rows of all batches so far."""
        return self._live(self._merged(self._stored(None))).drop("_batch")

    def compact(self, every: int = COMPACT_EVERY) -> None:
        """Merge what stands so far into one base, once ``every`` batches
        came after the last one."""
        bases, parts = _ended(self.spark, f"{self.root}/base", "upto="), self._parts()
        new = [b for b in parts if not bases or b > bases[-1]]
        if len(new) < max(every, 1):
            return
        self._live(self._merged(self._stored(new[-1]))).write.mode("overwrite").parquet(f"{self.root}/base/upto={new[-1]}")
        for b in bases:
            _delete(self.spark, f"{self.root}/base/upto={b}")
        for b in parts:
            if b <= new[-1]:
                _delete(self.spark, f"{self.root}/part/batch={b}")

    def _parts(self) -> list[int]:
        return _ended(self.spark, f"{self.root}/part", "batch=")

    def _stored(self, upto: int | None) -> DataFrame:
        bases = _ended(self.spark, f"{self.root}/base", "upto=")
        low = bases[-1] if bases else None
        paths = [f"{self.root}/base/upto={low}"] if bases else []
        paths += [f"{self.root}/part/batch={b}" for b in self._parts()
                  if (low is None or b > low) and (upto is None or b <= upto)]
        schema = self.schema + ", _batch bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _merged(self, rows: DataFrame) -> DataFrame:
        if self.sums:
            return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], F.max("_batch").alias("_batch"))
        others = [c for c in rows.columns if c not in self.keys]
        last = F.max_by(F.struct(*others), F.struct(*self.order, "_batch"))
        return rows.groupBy(*self.keys).agg(last.alias("_last")).select(*self.keys, "_last.*").select(*rows.columns)

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.ttl:
            return rows
        newest = rows.agg(F.max(self.ts).alias("_newest"))  # one row
        return (rows.join(F.broadcast(newest), F.col(self.ts) >= F.col("_newest") - F.expr(self.ttl))
                .drop("_newest"))


def sliding_counts(minutes: DataFrame, keys: list[str], count: str, width: int = 5, minute: str = "minute") -> DataFrame:
    """Counts of windows of ``width`` minutes that start every minute, from
    counts per minute: each minute belongs to the ``width`` windows around it."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col(minute) - F.make_dt_interval(mins=k))
    return (minutes.select(*keys, F.explode(starts).alias("window_start"), count)
            .groupBy(*keys, "window_start").agg(F.sum(count).alias(count)))
