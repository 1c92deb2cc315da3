"""MinHash near-dedup with tensored banding.

A document's set is its distinct word shingles (64-bit hashes; A-Z lowered,
words between ASCII white space; with fewer words the whole sequence is one).
Instead of one band of minhashes per table, two small collections of ``SIDE``
half-keys each (``HALF`` minhashes per half-key) are computed and every pair of
a left and a right half-key makes a table key: SIDE * SIDE tables out of
2 * SIDE * HALF minhashes. At a similarity of 0.8 a pair is missed by all
tables with probability 2 * (1 - 0.8**HALF)**SIDE = 6e-4 at most.

Equal sets collapse first into classes under their smallest id, so copies cost
one row. In every table bucket the members are compared with the bucket's
smallest id, links are confirmed on the full sets, and components are formed.
Only buckets that then still span several components are looked at again, and
there only pairs between different components that can reach the threshold at
all. Shingles are ordered by how many open sets hold them, rarest first; two
sets of similarity 0.8 share a shingle of both their prefixes (the rarest fifth
and one), and have no more in common than the shingles that any other open set
holds, nor than what follows their first common one. So near copies with edits of their own meet only where the edits are
shared, and a bucket of near copies costs one comparison per member, not one
per pair. Both bounds are exact: no link is lost by them.

Defined results: null, empty and blank texts have the empty set and link with
nothing; a null id counts as one document below all others (its component_id
is null); rows that share an id are one document, so classes that share their
smallest id are one node; an empty table gives an empty result; extra columns
are carried along, and an input column named like an output column gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import NO_ID, global_row_number, id_of, packed, stored, text_of, unpacked
from logweave.llm.components import connected_components

SIDE = 8
HALF = 2
# links: PART * intersection >= WHOLE * union
PART, WHOLE = 100, 80
OWN = ("n_shingles", "component_id", "kept")
_BLOCK = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit sums over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = (rolled ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return np.unique(_mixed(rolled))


_ODD = _mixed(np.arange(1, 2 * SIDE * HALF + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = _mixed(np.arange(1001, 2 * SIDE * HALF + 1001, dtype=np.uint64))


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """The 2 * SIDE half-keys of a set, left collection first."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _BLOCK):
        part = shingles[start:start + _BLOCK]
        h = part[None, :] * _ODD[:, None] + _ADD[:, None]
        low = np.minimum(low, (h ^ (h >> np.uint64(29))).min(axis=1))
    pairs = low.reshape(2 * SIDE, HALF)
    key = np.zeros(2 * SIDE, np.uint64)
    for k in range(HALF):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + pairs[:, k])
    return key


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, keys = [], [], [], []
            for text in batch.column("_t").to_pylist():
                s = shingle_set(text, words)
                d = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                one.append(int.from_bytes(d[:8], "big", signed=True))
                two.append(int.from_bytes(d[8:], "big", signed=True))
                keys.append(half_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), batch.column("_rid"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["_doc", "_rid", "_n", "_h1", "_h2", "_half"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_id", "_set"])
    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("_set1"), batch.column("_set2"), strict=True):
            x = np.frombuffer(a.as_buffer(), np.uint64)
            y = np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(PART * both >= WHOLE * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``pairs`` that link, by their sets."""
    one = sets.select(F.col("_id").alias("v"), F.col("_set").alias("_set2"))
    two = sets.select(F.col("_id").alias("u"), F.col("_set").alias("_set1"))
    return stored(pairs.join(one, "v").join(two, "u").select("u", "v", "_set1", "_set2")
                  .mapInArrow(_confirmed, "u long, v long").distinct(), "links")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets as arrays of longs, with a hash that tells the sets of an id apart."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("_set")]
        of = [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(of, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
            names=["_id", "_of", "_shingles"])


def _prefixes(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, _shared, _s, _rest, _before): the shingles in the prefix of each
    set that another set of ``ids`` holds too, how many of the whole set are
    so, how many follow this one in the order, and which of the prefix stand
    before it."""
    wanted = sets.join(ids.withColumnRenamed("_rep", "_id"), "_id", "left_semi")
    rows = stored(wanted.mapInArrow(_shingle_rows, "_id long, _of long, _shingles array<long>")
                  .select("_id", "_of", F.explode("_shingles").alias("_s")), "shingles")
    held = rows.groupBy("_s").agg(F.count("*").alias("_df"))
    ordered = rows.join(held, "_s").groupBy("_id", "_of").agg(
        F.array_sort(F.collect_list(F.struct("_df", "_s"))).alias("_all"))
    n = F.size("_all")
    length = n - F.ceil(n * F.lit(WHOLE) / PART).cast("int") + 1
    prefix = F.filter(F.transform(F.slice("_all", 1, length), lambda x, i: F.struct(
        x["_df"].alias("df"), x["_s"].alias("s"), (n - i - 1).alias("rest"))), lambda x: x["df"] > 1)
    listed = ordered.select("_id", F.size(F.filter("_all", lambda x: x["_df"] > 1)).alias("_shared"), prefix.alias("_l"))
    return listed.select("_id", "_shared", "_l", F.posexplode("_l").alias("_k", "_x")).select(
        "_id", "_shared", F.col("_x")["s"].alias("_s"), F.col("_x")["rest"].alias("_rest"),
        F.slice(F.transform("_l", lambda x: x["s"]), F.lit(1), F.col("_k")).alias("_before"))


def classified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per input row: id, hash of its text, size of its set and the
    smallest id of its component (``_doc``, ``_rid``, ``_n``, ``_comp``)."""
    rows = docs.select(id_of(id_col).alias("_doc"), text_of(text_col).alias("_t")).select(
        "_doc", F.xxhash64("_t").alias("_rid"), "_t")
    signed = stored(rows.mapInArrow(_signatures(words), "_doc long, _rid long, _n long, _h1 long, _h2 long, _half array<long>"),
                    "signatures")
    classes = stored(signed.filter(F.col("_n") > 0).groupBy("_h1", "_h2").agg(
        F.min("_doc").alias("_rep"), F.first("_n").alias("_n"), F.first("_half").alias("_half")), "classes")
    tables = F.array(*[F.xxhash64(F.lit(i * SIDE + j), F.col("_half")[i], F.col("_half")[SIDE + j])
                       for i in range(SIDE) for j in range(SIDE)])
    keys = classes.select("_rep", "_n", F.explode(tables).alias("_key"))

    buckets = keys.groupBy("_key").agg(F.min("_rep").alias("_lead"), F.max("_rep").alias("_last")).filter(
        F.col("_lead") != F.col("_last"))
    members = stored(keys.join(buckets.select("_key", "_lead"), "_key"), "members")
    sets = stored(rows.join(members.select(F.col("_rep").alias("_doc")).distinct(), "_doc", "left_semi")
                  .dropDuplicates(["_doc", "_rid"]).select("_doc", "_t")
                  .mapInArrow(_sets(words), "_id long, _set binary"), "sets")
    stars = members.filter(F.col("_rep") != F.col("_lead")).select(
        F.col("_lead").alias("u"), F.col("_rep").alias("v")).distinct()
    links = _links(stars, sets)
    joined = connected_components(links)

    placed = members.join(joined.withColumnRenamed("node", "_rep"), "_rep", "left").select(
        "_key", "_lead", "_rep", "_n", F.coalesce("component", "_rep").alias("_comp"))
    open_keys = placed.groupBy("_key").agg(
        F.min("_comp").alias("_c1"), F.max("_comp").alias("_c2"), F.count("*").alias("_m")).filter(
        (F.col("_c1") != F.col("_c2")) & (F.col("_m") > 2)).select("_key")
    open_ids = stored(placed.join(open_keys, "_key").filter(F.col("_rep") != F.col("_lead"))
                      .select("_rep", "_n", "_comp").distinct(), "open")
    prefixes = _prefixes(sets, open_ids.select("_rep").distinct()).join(
        open_ids.withColumnRenamed("_rep", "_id"), "_id").filter(PART * F.col("_shared") >= WHOLE * F.col("_n"))
    prefixes = stored(prefixes, "prefixes")
    a, b = (prefixes.select("_s", *[F.col(c).alias(c + n) for c in ("_id", "_n", "_shared", "_rest", "_before", "_comp")])
            for n in "12")
    common = F.least("_shared1", "_shared2", F.col("_rest1") + 1, F.col("_rest2") + 1)
    across = a.join(b, "_s").filter(
        (F.col("_comp1") != F.col("_comp2")) & (F.col("_id1") < F.col("_id2"))
        & (PART * common >= WHOLE * (F.col("_n1") + F.col("_n2") - common))
        & ~F.arrays_overlap("_before1", "_before2"))  # a pair meets at its first common shingle only
    across = stored(across.select(F.col("_id1").alias("u"), F.col("_id2").alias("v")).distinct(), "across")
    components = connected_components(links.unionByName(_links(across, sets)))

    of_class = (classes.join(components.withColumnRenamed("node", "_rep"), "_rep", "left")
                .select(F.col("_h1"), F.col("_h2"), F.coalesce("component", "_rep").alias("_comp")))
    return (signed.select("_doc", "_rid", "_n", "_h1", "_h2").join(of_class, ["_h1", "_h2"], "left")
            .select("_doc", "_rid", "_n", F.coalesce("_comp", "_doc").alias("_comp")))


def _result(n: str = "_n", comp: str = "_comp", doc: str = "_doc") -> list:
    return [F.col(n).alias("n_shingles"), F.nullif(F.col(comp), F.lit(NO_ID)).alias("component_id"),
            (F.col(doc) == F.col(comp)).alias("kept")]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept`` (the
    document is the smallest of its component)."""
    found = (classified(docs, id_col=id_col, text_col=text_col, words=words).dropDuplicates(["_doc", "_rid"])
             .select(F.col("_doc").alias("_doc2"), F.col("_rid").alias("_rid2"), "_n", "_comp"))
    rows = docs.select(packed(docs), id_of(id_col).alias("_doc"), F.xxhash64(text_of(text_col)).alias("_rid"))
    joined = rows.join(found.hint("shuffle_hash"), (F.col("_doc") == F.col("_doc2")) & (F.col("_rid") == F.col("_rid2")))
    return joined.select(*unpacked(docs.columns, without=OWN), *_result())


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each component, with their own columns.

    Where ids are null or repeat, rows are told apart by their number in the
    order of id (null first) and text, so one row of a component stays then too
    and rows without an id are not taken for one document."""
    whole = docs.select(packed(docs, "_whole"), *[F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in (
        ("_i", options.pop("id_col", "doc_id")), ("_x", options.pop("text_col", "text")))])
    if not whole.groupBy("_i").count().filter((F.col("count") > 1) | F.col("_i").isNull()).isEmpty():
        hashed = whole.withColumn("_h", F.xxhash64(text_of("_x")))
        whole = global_row_number(hashed, ["_i", "_h"], "_no")[0].withColumn("_i", F.col("_no")).drop("_no", "_h")
    found = near_duplicates(whole, id_col="_i", text_col="_x", **options).filter("kept")
    return found.select(*unpacked(docs.columns, name="_whole"))


def q_minhash(docs: DataFrame) -> DataFrame:
    return classified(docs.select("doc_id", "text"), words=4).select(
        F.nullif("_doc", F.lit(NO_ID)).alias("doc_id"), *_result())
