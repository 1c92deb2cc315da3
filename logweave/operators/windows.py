"""Ranking helpers that stay distributed (W-01, W-11, W-12, O-03/O-04).

``top_n`` without groups is an ``orderBy().limit()`` (each task keeps its own
top n, the driver merges n x tasks rows). ``top_n`` with groups ranks in two
phases: first inside (group, salt) sub-groups, keeping n rows each, then
inside the group over at most n x salts rows. A group holding a third of the
data is therefore sorted by ``salts`` tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 32


def top_n(df: DataFrame, n: int, order: list[Column], keys: list[str] | None = None,
          salt_by: list[str] | None = None, salts: int = DEFAULT_SALTS, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows by ``order`` (a total order: add a unique tie-break),
    overall or per ``keys``. ``salt_by`` columns feed the salt hash."""
    if not keys:
        out = df.orderBy(*order).limit(n)
        if rank_col:
            out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
        return out
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_by or df.columns)]), F.lit(salts))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pre = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    out = pre.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n).drop("_salt", "_r1")
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def beyond_n(df: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Rows after the first ``n`` (W-11/W-12 delete lists): anti join with
    the top ``n`` on the given unique ``id`` column."""
    keep = top_n(df, n, order, keys, salt_by=["id"]).select("id")
    return df.join(keep, "id", "left_anti")


def row_number_at_scale(df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
                        partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` without
    one task per key (or one task overall when ``keys`` is empty).

    Rows are range-partitioned on (keys, order), so a hot key is split over
    several partitions in order; per (partition, key) counts give each chunk
    its offset (a running sum over partitions, a small table), and the row
    number is the chunk-local rank plus that offset. ``order`` must be a total
    order (end it with a unique column).
    """
    from pyspark.sql import Window

    from logweave.session import cut_lineage

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # materialised once: the range bounds come from a sample, and counts and
    # local ranks must see the same partition of every row
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    local = ranged.withColumn("_lrn", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)))
    out = local.join(offsets, ["_pid", *keys], "inner")
    return out.withColumn(name, (F.col("_lrn") + F.col("_off")).cast("long")).drop("_pid", "_lrn", "_off")
