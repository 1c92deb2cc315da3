"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends with A-Z
lowered; keys of at least ``min_chars`` code points held by at least
``min_docs`` documents lose all their lines but those of the largest document
id that holds them.

Documents arrive in batches from the largest ids down. Each batch counts its
own keys, merge-anti-joins them with the runs so far - what no run holds is
new, and this batch's largest id is the keeper; what a run holds adds its count
only - and is written as a run of its own, bucketed and sorted by the 128-bit
key hash, so that joins of runs and batches need no shuffle. When a level holds
``fan_out`` runs they are compacted into one run of the next level. The sum over the runs left at the end says which
keys go, and each document drops the places that a join of keys and lines gives.

Counts are pre-aggregated per document and per batch; a key held by a third of
all lines is one row per batch afterwards. The join of lines and dropped keys
is salted by the row hash, each dropped key standing once per salt.

Defined results: a null text is one empty line; a null id counts as one
document below all others; rows that share an id are one document for counting,
each cleaned by its own text; an empty table gives an empty result; extra
columns are carried along, and an input column named like an output column
gives way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import (SPACE, ascii_lower, id_of, packed, shared_path, shuffle_partitions, stored, text_of,
                                 unpacked)

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_OUT = 2
SALTS = 16
KEY = ["_h1", "_h2"]


class LineRuns:
    """Sorted runs of (key hash, number of documents, keeper) on levels."""

    def __init__(self, spark, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[DataFrame]] = []
        self.buckets = shuffle_partitions(spark)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, run: DataFrame) -> DataFrame:
        """A run as a table bucketed and sorted by the key in the shared folder."""
        name = f"lw_run_{uuid.uuid4().hex}"
        (run.select(*KEY, "_n", "_keeper").repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY)
         .sortBy(*KEY).option("path", shared_path(self.spark, name)).saveAsTable(name))
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (document, key), later batches with smaller ids."""
        own = (lines.groupBy(*KEY, "_doc").agg(F.lit(1).alias("_one"))
               .groupBy(*KEY).agg(F.count("*").alias("_n"), F.max("_doc").alias("_keeper")))
        rest, parts = own, []
        for run in self.runs():
            keys = run.select(*KEY).hint("merge")
            known = rest.join(keys, KEY, "left_semi").withColumn("_keeper", F.lit(None).cast("long"))
            parts.append(known)
            rest = rest.join(keys, KEY, "left_anti")
        batch = rest
        for part in parts:
            batch = batch.unionByName(part)
        self._push(0, self._write(batch))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        return both.groupBy(*KEY).agg(F.sum("_n").alias("_n"), F.max("_keeper").alias("_keeper"))

    def total(self) -> DataFrame:
        return self._merged(self.runs())


def _keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(document, row hash, place, key hash) of every line that is long enough."""
    lines = docs.select(id_of(id_col).alias("_doc"), text_of(text_col).alias("_t"))
    lines = lines.select("_doc", F.xxhash64("_t").alias("_rid"),
                         F.posexplode(_keys(F.split("_t", "\n", -1))).alias("_at", "_line"))
    lines = lines.filter(F.char_length("_line") >= min_chars).withColumn("_key", ascii_lower(F.col("_line")))
    return lines.select("_doc", "_rid", "_at", F.xxhash64("_key").alias("_h1"),
                        F.xxhash64(F.lit(7), "_key").alias("_h2"))


def _batched(lines: DataFrame, batches: int) -> DataFrame:
    """The lines with a batch number, 0 for the largest ids; the cuts are
    approximate quantiles and only balance the batches."""
    shares = [i / batches for i in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("_doc", shares, 1000)).first()[0] if shares else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + (F.col("_doc") <= cut).cast("int")
    return lines.withColumn("_batch", batch)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """``docs`` with the cleaned text in ``text_col``, ``n_lines`` (before)
    and ``n_dropped``."""
    spark = docs.sparkSession
    lines = stored(line_table(docs, id_col, text_col, min_chars), "lines")
    lines = _batched(lines, batches)
    runs = LineRuns(spark, fan_out)
    for b in range(batches):
        runs.add(lines.filter(F.col("_batch") == b))
    dropped = runs.total().filter(F.col("_n") >= min_docs).select(
        *KEY, "_keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = lines.drop("_batch").withColumn("_salt", F.pmod("_rid", F.lit(SALTS)).cast("int"))
    places = (salted.join(dropped, [*KEY, "_salt"]).filter(F.col("_doc") != F.col("_keeper"))
              .groupBy("_doc", "_rid").agg(F.array_distinct(F.collect_list("_at")).alias("_gone"))
              .select(F.col("_doc").alias("_doc2"), F.col("_rid").alias("_rid2"), "_gone"))
    rows = docs.select(packed(docs), id_of(id_col).alias("_doc"), text_of(text_col).alias("_t"))
    rows = rows.withColumn("_rid", F.xxhash64("_t"))
    joined = rows.join(places.hint("shuffle_hash"),
                       (F.col("_doc") == F.col("_doc2")) & (F.col("_rid") == F.col("_rid2")), "left")
    staged = joined.select("_row", "_t", "_gone", F.split("_t", "\n", -1).alias("_lines"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")),
                       lambda i: F.element_at("_lines", i + 1))
    kept = F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(left, "\n"))
    cols = [kept.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns
            if c not in ("n_lines", "n_dropped")]
    return staged.select(*cols, F.size("_lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def q_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    return rf"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key
      HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
f AS (SELECT k.doc_id, k.i, k.line, (g.key IS NOT NULL AND k.doc_id <> g.keeper) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
