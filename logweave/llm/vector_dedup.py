"""Embedding near-dedup with a forest of random-projection trees.

Vectors of one label (and dimension) are split recursively: on each level of a
tree every node with more than ``LEAF`` members is cut by its members'
projections on a random direction of that tree and level, and members closer
than ``SPILL`` to the cut go to both sides. The cut is the one of the quantiles
from 20 to 80 % around which the fewest quantiles lie within the spill (the one
next to the median of equal ones), so a dense group is passed by and not
doubled level by level. Two unit vectors of cosine 0.98 are 0.2 apart, so the
spill keeps nearly all such pairs together, and ``TREES`` trees make up for the
rest. A node with no cut that leaves half of its members out of the spill is
not cut at that level; after ``STALLS`` such levels, or at the last level, it
becomes a leaf of any size.

Equal vectors collapse first into classes under their smallest id, with their
number. Members of a leaf are compared exactly (cosine in double precision); a
leaf of more than ``BLOCK`` members is cut into blocks and pairs of blocks, so no task gets an unbounded group. A
pair that meets in several leaves counts in the one with the smallest leaf id.
Tasks give counts and a spanning forest per leaf, never the pairs themselves.
Every level is written to the shared folder.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing and are kept; a null
id counts as one below all others (its component_id is null); rows equal in id,
label and vector are one vector, rows that share only the id share a node; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import NO_ID, col, id_of, stored
from logweave.llm.components import connected_components

COSINE = 0.98
TREES = 4
LEAF = 512
BLOCK = 1024
SPILL = 0.02
STALLS = 3
SEED = 20240131
NODE = ["_label", "_dim", "_tree", "_path"]


def vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, vector (float or double), its two hashes and whether it can link."""
    kind = rows.schema[vector_col].dataType.simpleString()
    v = col(vector_col) if kind == "array<float>" else col(vector_col).cast("array<double>")
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = (F.col("_label").isNotNull() & F.col("_v").isNotNull() & ~bad & F.exists("_v", lambda x: x != 0))
    return (rows.select(id_of(id_col).alias("_id"), col(label_col).alias("_label"), v.alias("_v"))
            .select("*", F.coalesce(usable, F.lit(False)).alias("_ok"), F.xxhash64("_v").alias("_h1"),
                    F.xxhash64(F.lit(7), "_v").alias("_h2")))


def _units(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Unit vectors of a column of equally long arrays; scaled by the largest
    component first, so that squares neither overflow nor vanish."""
    column = batch.column("_v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _projections(trees: int, levels: int):
    """For each vector and tree its projections on the tree's directions."""
    def directions(dim: int) -> np.ndarray:
        d = np.stack([np.random.default_rng([SEED, dim, t, lv]).standard_normal(dim)
                      for t in range(trees) for lv in range(levels)], axis=1)
        return d / np.sqrt((d * d).sum(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                known.setdefault(int(dim), directions(int(dim)))
                p = _units(part) @ known[int(dim)]
                flat = pa.array(p.astype(np.float32).reshape(-1), pa.float32())
                offsets = pa.array(np.arange(0, len(p) * trees * levels + 1, trees * levels, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_label"), part.column("_dim"),
                     pa.ListArray.from_arrays(offsets, flat)], names=["_id", "_label", "_dim", "_p"])
    return run


def forest(classes: DataFrame, n: int, *, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(_id, _label, _dim, _leaf): the leaves of every class in every tree."""
    levels = math.ceil(1.7 * math.log2(n / leaf)) + STALLS + 2 if n > leaf else 1
    kind = classes.schema["_label"].dataType.simpleString()
    projected = classes.select("_id", "_label", "_dim", "_v").mapInArrow(
        _projections(trees, levels), f"_id long, _label {kind}, _dim int, _p array<float>")
    active = stored(projected.select(
        "_id", "_label", "_dim", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"), "_p").select(
        "_id", "_label", "_dim", "_tree", F.lit(1).cast("long").alias("_path"), F.lit(0).alias("_stall"),
        F.slice("_p", F.col("_tree") * levels + 1, F.lit(levels)).alias("_p")), "forest_0")
    leaves = None
    for level in range(levels + 1):
        x = F.element_at("_p", min(level, levels - 1) + 1)
        q = F.percentile_approx(x, [k / 20 for k in range(1, 20)], 1000)
        # (quantiles within the spill, places from the median, cut)
        best = F.array_min(F.transform(F.sequence(F.lit(3), F.lit(15)), lambda i: F.struct(
            F.size(F.filter("_q", lambda v: F.abs(v - F.get("_q", i)) < spill)).alias("near"), F.abs(i - 9).alias("off"),
            F.get("_q", i).alias("cut"))))
        nodes = active.groupBy(*NODE).agg(F.count("*").alias("_n"), q.alias("_q")).select(*NODE, "_n", best.alias("_best")).select(
            *NODE, "_n", F.col("_best.cut").alias("_cut"), (F.col("_best.near") > 10).alias("_flat"))
        final = (F.col("_n") <= leaf) | (F.col("_stall") >= STALLS) | F.lit(level == levels)
        left = F.when(F.col("_flat") | (x <= F.col("_cut") + spill), F.col("_path") * 2)
        right = F.when(~F.col("_flat") & (x > F.col("_cut") - spill), F.col("_path") * 2 + 1)
        # written once: what has come to a leaf, and where the others go
        here = stored(active.join(nodes, NODE).select(
            "_id", "_label", "_dim", "_tree", final.alias("_final"), F.xxhash64(*NODE, F.lit(level)).alias("_leaf"),
            F.array_compact(F.array(left, right)).alias("_next"),
            F.when(F.col("_flat"), F.col("_stall") + 1).otherwise(F.lit(0)).alias("_stall"),
            F.when(~final, F.col("_p")).alias("_p")), f"forest_{level + 1}")
        done = here.filter("_final").select("_id", "_label", "_dim", "_leaf")
        leaves = done if leaves is None else leaves.unionByName(done)
        if level == levels:
            break
        active = here.filter("not _final").select("_id", "_label", "_dim", "_tree", F.explode("_next").alias("_path"), "_stall", "_p")
        if active.isEmpty():
            break
    return leaves


def _compared(table: pa.Table) -> pa.Table:
    """Links inside a leaf, or between two blocks of it: per member the number
    of vectors it links with in pairs that this leaf owns, and the smallest
    member it is joined to."""
    ids = table.column("_id").to_numpy()
    times = table.column("_times").to_numpy()
    block = table.column("_block").to_numpy()
    here = table.column("_leaf")[0].as_py()
    one, two = table.column("_b1")[0].as_py(), table.column("_b2")[0].as_py()
    x = _units(table)
    links = (x @ x.T) >= COSINE
    links &= ids[:, None] != ids[None, :]
    if one != two:
        links &= block[:, None] != block[None, :]
    member = np.flatnonzero(links.any(axis=1))
    links = links[np.ix_(member, member)]
    ids, times = ids[member], times[member]
    lists = [[y for y in ls if y < here] for ls in table.column("_leaves").take(pa.array(member)).to_pylist()]
    smaller = {leaf: k for k, leaf in enumerate(sorted({y for ls in lists for y in ls}))}
    owned = links.copy()
    if smaller:
        at = np.zeros((len(member), len(smaller)), np.float32)
        for k, ls in enumerate(lists):
            at[k, [smaller[y] for y in ls]] = 1
        owned &= (at @ at.T) == 0
    root, last = ids.copy(), None
    while last is None or not np.array_equal(root, last):
        last = root
        root = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
    return pa.table({"_id": pa.array(ids, pa.int64()), "_links": pa.array(owned @ times, pa.int64()),
                     "_root": pa.array(root, pa.int64())})


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", trees: int = TREES) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    all_rows = vectors(rows, id_col, vector_col, label_col)
    same = ["_label", "_h1", "_h2"]
    each = all_rows.filter("_ok").groupBy("_id", *same).agg(F.first("_v").alias("_v"))
    classes = stored(each.groupBy(*same).agg(
        F.min("_id").alias("_rep"), F.count("*").alias("_times"), F.first("_v").alias("_v")), "classes")
    nodes = classes.select(F.col("_rep").alias("_id"), "_label", F.size("_v").alias("_dim"), "_v", "_times")
    leaves = forest(nodes, classes.count(), trees=trees)

    sizes = leaves.groupBy("_leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    of_class = leaves.groupBy("_id").agg(F.collect_set("_leaf").alias("_leaves"))
    block = F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
    members = (leaves.join(sizes, "_leaf").withColumn("_block", block)
               .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
               .select("_id", "_label", "_dim", "_leaf", "_block", F.least("_block", "_other").alias("_b1"),
                       F.greatest("_block", "_other").alias("_b2")))
    members = members.join(of_class, "_id").join(nodes, ["_id", "_label", "_dim"])
    found = stored(members.groupBy("_leaf", "_label", "_dim", "_b1", "_b2").applyInArrow(
        _compared, "_id long, _links long, _root long"), "found")

    links = found.groupBy("_id").agg(F.sum("_links").alias("_links"))
    components = connected_components(found.select(F.col("_id").alias("u"), F.col("_root").alias("v")))
    of_class = (classes.select(*same, "_rep", "_times").join(links.withColumnRenamed("_id", "_rep"), "_rep", "left")
                .join(components.withColumnRenamed("node", "_rep"), "_rep", "left")
                .select(F.lit(True).alias("_ok"), *same, (F.col("_times") - 1 + F.coalesce("_links", F.lit(0))).alias("_l"),
                        F.coalesce("component", "_rep").alias("_comp")))
    done = all_rows.select("_id", "_ok", *same).join(of_class, ["_ok", *same], "left").withColumn(
        "_c", F.coalesce("_comp", "_id"))
    return done.select(F.nullif("_id", F.lit(NO_ID)).alias(id_col), F.coalesce("_l", F.lit(0)).alias("n_links"),
                       F.nullif("_c", F.lit(NO_ID)).alias("component_id"), (F.col("_id") == F.col("_c")).alias("kept"))


def q_vectors(rows: DataFrame) -> DataFrame:
    return near_duplicates(rows.select("vec_id", "embedding", "label"))
