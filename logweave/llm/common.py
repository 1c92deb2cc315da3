"""Shared helpers: quoted column access, tables written to the shared folder
to cut lineage, a gap-free global row number, and the fixed word pattern."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logweave.session import ensure_checkpoint_dir

# fixed values of the contracts: ASCII white space and words
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NO_ID = -(2**63)
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def col(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` in one struct, so that extra columns can't clash
    with working columns; ``unpacked`` gives them back."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def unpacked(columns: list[str], *, name: str = "_row", without: tuple[str, ...] = ()) -> list[Column]:
    """The packed columns again, but for those that an operator puts itself."""
    return [F.col(name).getField(c).alias(c) for c in columns if c not in without]


def text_of(name: str) -> Column:
    """A text column with null as empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def id_of(name: str) -> Column:
    """A document id as long; a null id counts as one document below all others."""
    return F.coalesce(col(name).cast("long"), F.lit(NO_ID))


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else; the plain ``lower`` where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-llm/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, *, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs only the tasks it ran. The write's shuffle files go
    when it ends, as nothing can read them again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    schema = df.schema if partition_by is None else T.StructType(
        [f for f in df.schema if f.name != partition_by] + [df.schema[partition_by]])
    out = spark.read.schema(schema).parquet(path)
    out._lw_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lw_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def global_row_number(df: DataFrame, order_by: list[str], name: str = "_row_no") -> tuple[DataFrame, int]:
    """``df`` with a gap-free row number from 0 in the order of ``order_by``
    (nulls first), and the number of rows.

    Rows are range-partitioned and sorted, their places inside a partition are
    written down, and the partitions' counts (one row per partition) give the
    offsets. Equal keys are spread by an extra sort column, so a key held by a
    third of all rows fills many partitions; rows equal in all of ``order_by``
    are numbered in any order among themselves.
    """
    spark = df.sparkSession
    salted = df.withColumn("_lw_salt", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first("`" + c + "`") for c in order_by] + [F.asc("_lw_salt")]
    placed = stored(
        salted.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
        .withColumn("_lw_at", F.monotonically_increasing_id()).drop("_lw_salt"), "placed")
    part, place = F.shiftright("_lw_at", 33), F.col("_lw_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_lw_part")).agg(F.count("*").alias("_lw_n"))
    total = counts.agg(F.sum("_lw_n")).first()[0] or 0
    before = Window.orderBy("_lw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_lw_part", F.coalesce(F.sum("_lw_n").over(before), F.lit(0)).alias("_lw_off"))
    numbered = (placed.withColumn("_lw_part", part)
                .join(F.broadcast(offsets), "_lw_part")  # one row per shuffle partition
                .withColumn(name, F.col("_lw_off") + place)
                .drop("_lw_part", "_lw_off", "_lw_at"))
    return numbered, total
