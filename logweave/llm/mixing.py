"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are word counts. Sources in code-point order (null last) weigh 5, 2, 1,
repeating, and share all words; a target stops at three times its source's
size and the excess is shared again by weight until none is above (solved in
closed form over the per-source table, as caps bind in the order of
cap / weight). A source's target is taken as complete epochs first - every
document that many times - and the rest as a weighted sample without
replacement: documents sorted by the exponential key ``-ln(u) / weight``,
prefix-summed up to the budget; the document at the edge is taken when more
than half of it fits. ``u`` comes from a hash of id and seed, so reruns agree.

Prefix sums run in two levels: inside (source, key range) and over the ranges
of a source. The key is cut into sqrt(rows) ranges, so neither level puts more
than about sqrt(rows) rows of a source into one group, hot source or not.

Defined results: a null text has size 0 and is taken as nothing; a null source
is a source of its own, the last; null ids hash like the text 'null'; rows
equal in id and size are interchangeable; an empty table gives an empty
result; extra columns are carried along and an input column named like an
output column gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import WORD, col, packed, stored, text_of, unpacked

WEIGHTS = [5, 2, 1]
MAX_EPOCHS = 3
SEED = "mix-1"
# the per-source table is broadcast only up to this many sources
BROADCAST_SOURCES = 50_000

OWN = ("size", "source_size", "target", "copies", "taken")


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document in the sample: 1, less up to a half with the
    share of symbols per word."""
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return 1 - 0.5 * F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)))


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (``_src``, ``_z``): weight and target.

    With ``max_epochs * z / weight`` ascending, the first sources are capped;
    the common rate of the others is what is left over their weights.
    """
    order = Window.orderBy(F.asc_nulls_last("_src"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    weighed = (sizes.select("_src", "_z", w.alias("_weight"))
               .withColumn("_cap", F.col("_z") * max_epochs)
               .withColumn("_level", F.col("_cap") / F.col("_weight")))
    by_level = Window.orderBy("_level", F.asc_nulls_last("_src"))
    all_rows = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = ((F.sum("_z").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
            / F.sum("_weight").over(onward))
    rates = weighed.withColumn("_rate", rate).withColumn("_free", F.col("_level") > F.col("_rate"))
    common = F.min(F.when(F.col("_free"), F.struct("_level", F.col("_rate").alias("r")))).over(all_rows)["r"]
    return (rates.withColumn("_common", common)
            .select("_src", "_z", F.when(F.col("_common").isNull() | (F.col("_level") <= F.col("_common")),
                                         F.col("_cap").cast("double"))
                    .otherwise(F.col("_weight") * F.col("_common")).alias("_target")))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a hash of seed and id."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: list[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``carry``) with size, source_size, target,
    copies and taken (= copies * size), one row per input row."""
    carry = docs.columns if carry is None else carry
    size = F.size(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).cast("long")
    rows = (docs.select(packed(docs.select(*[col(c) for c in carry])), col(id_col).alias("_id"),
                        col(source_col).cast("string").alias("_src"), text_of(text_col).alias("_t"))
            .select("_row", "_id", "_src", "_t", size.alias("_size"))
            .select("_row", "_src", "_size", F.col("_id").cast("string").alias("_tie"),
                    (-F.log(uniform(F.col("_id"), seed)) / quality_weight(F.col("_t"), F.col("_size"))).alias("_key")))
    rows = stored(rows, "mix_rows")
    sizes = stored(rows.groupBy("_src").agg(F.sum("_size").alias("_z"), F.count("*").alias("_n")), "mix_sources")
    n_sources, n = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    targets = source_targets(sizes.select("_src", "_z"), weights, max_epochs)
    targets = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets

    ranges = math.isqrt(max(n, 1)) + 1
    cut = rows.withColumn("_cut", F.floor((1 - F.exp(-F.col("_key"))) * ranges))
    of_range = (cut.groupBy("_src", "_cut").agg(F.sum("_size").alias("_sum"))
                .withColumn("_before", F.coalesce(F.sum("_sum").over(
                    Window.partitionBy("_src").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .select(F.col("_src").alias("_src2"), F.col("_cut").alias("_cut2"), "_before"))
    inside = Window.partitionBy("_src", "_cut").orderBy("_key", "_tie", "_size").rowsBetween(
        Window.unboundedPreceding, -1)
    summed = (cut.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
              .join(of_range, F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_cut") == F.col("_cut2")))
              .select("_row", "_src", "_size", (F.col("_in") + F.col("_before")).alias("_cum")))
    t = targets.select(F.col("_src").alias("_src3"), "_z", "_target")
    epochs = F.when(F.col("_z") > 0, F.least(F.lit(max_epochs), F.floor(F.col("_target") / F.col("_z"))))
    joined = (summed.join(t, F.col("_src").eqNullSafe(F.col("_src3")))
              .withColumn("_epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
              .withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_z")))
    extra = F.when(F.col("_size") > 0, (2 * F.col("_cum") + F.col("_size") <= 2 * F.col("_rest")).cast("long"))
    copies = F.col("_epochs") + F.coalesce(extra, F.lit(0))
    return joined.withColumn("_copies", copies).select(
        *unpacked(carry, without=OWN), F.col("_size").alias("size"), F.col("_z").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the
    columns of ``docs`` only. The plan is made on ids and row hashes and joined
    back, so texts move once. Rows equal in all columns are interchangeable:
    one of them stands for the copies of all."""
    hashed = [col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(packed(docs), F.xxhash64(*hashed).alias("_h1"), F.xxhash64(F.lit(7), *hashed).alias("_h2"))
    slim = docs.select(F.xxhash64(*hashed).alias("_h1"), F.xxhash64(F.lit(7), *hashed).alias("_h2"),
                       col(id_col).alias("_i"), col(text_col).alias("_x"), col(source_col).alias("_s"))
    plan = mix(slim, id_col="_i", text_col="_x", source_col="_s", carry=["_h1", "_h2"], **options)
    copies = stored(plan.groupBy("_h1", "_h2").agg(F.sum("copies").cast("int").alias("_c"), F.count("*").alias("_m")),
                    "mix_copies")
    if not copies.filter(F.col("_m") > 1).isEmpty():
        rows = rows.dropDuplicates(["_h1", "_h2"])
    taken = rows.join(copies.filter(F.col("_c") > 0).hint("shuffle_hash"), ["_h1", "_h2"])
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_k")).select(
        *unpacked(docs.columns))


def q_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source"), carry=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def oracle() -> str:
    """The same plan in DuckDB SQL, with the caps found over the sorted sources."""
    weights = "CASE " + " ".join(f"WHEN (rn - 1) % {len(WEIGHTS)} = {i} THEN {w}.0::DOUBLE" for i, w in
                                 enumerate(WEIGHTS)) + " END"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE)
            / {float(2**52)}::DOUBLE)
        / (1 - 0.5::DOUBLE * least(1.0::DOUBLE, len(regexp_extract_all(t, '[#*$%&|<>]'))::DOUBLE / greatest(size, 1)))
        AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM k GROUP BY source),
s1 AS (SELECT source, z, {weights} AS weight, {MAX_EPOCHS} * z AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS level,
         ((SELECT sum(z) FROM s1) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s1),
c AS (SELECT arg_min(rate, level) AS common FROM s2 WHERE level > rate),
s3 AS (SELECT source, z, CASE WHEN (SELECT common FROM c) IS NULL OR level <= (SELECT common FROM c)
              THEN cap::DOUBLE ELSE weight * (SELECT common FROM c) END AS target FROM s2),
e AS (SELECT *, CASE WHEN z > 0 THEN least({MAX_EPOCHS}, floor(target / z))::BIGINT ELSE 0 END AS epochs FROM s3),
r AS (SELECT k.doc_id, k.size, e.z, e.target, e.epochs, e.target - e.epochs * e.z AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id::VARCHAR, k.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, z AS source_size, target,
  ((epochs + CASE WHEN size > 0 AND 2 * cum + size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  (epochs + CASE WHEN size > 0 AND 2 * cum + size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r"""
