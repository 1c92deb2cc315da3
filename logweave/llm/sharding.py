"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get a gap-free number in the order of the given columns; a keyed Feistel
network permutes the numbers, and the permuted place gives shard
(place mod shards) and slot (place div shards). Every shard's count differs by
one at most, slots have no gaps, and where a row goes can be computed from its
number alone (``place_of``) and back (``row_of``).

The network works on a grid of ``a`` x ``b`` cells just above the row count
(a = ceil(sqrt(n)), b = ceil(n / a)); a place beyond the row count walks on
through the permutation until it is inside. Fewer than ``a`` cells are outside,
so a walk of ``a * b - n`` steps always ends; where that number is above
``MAX_WALK``, a walk longer than ``MAX_WALK`` has a chance below n ** -32 and
would raise an error, never give a wrong row.

Defined results: null ids sort first; a null text has no bytes (size 1, crc 0);
rows equal in all ordering columns are numbered in any order among themselves;
an empty table gives an empty result; extra columns are carried along, and an
input column named like an output column gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import col, global_row_number, text_of

SHARDS = 16
ROUND_KEYS = [314159265, 271828182, 161803398, 141421356, 173205080, 223606797]
MAX_WALK = 64
M31 = 2**31


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mixed(v: Column, key: Column) -> Column:
    """Round function: two multiply, add and xor-shift steps below 2**31."""
    t = (v * 1103515245 + key) % M31
    t = t.bitwiseXOR(F.shiftright(t, 15))
    t = (t * 1664525 + 1013904223) % M31
    return t.bitwiseXOR(F.shiftright(t, 13))


def _permuted(x: Column, n: int, keys: list[int], back: bool = False) -> Column:
    """One pass of the network over the grid; ``back`` undoes it."""
    a, b = _grid(n)
    rounds = list(enumerate(keys))
    rounds = rounds[::-1] if back else rounds
    sign = -1 if back else 1
    steps = F.array(*[F.struct(F.lit(i % 2).alias("side"), F.lit(k).cast("long").alias("key")) for i, k in rounds])

    def step(s: Column, r: Column) -> Column:
        left = F.when(r["side"] == 0, F.pmod(s["l"] + sign * _mixed(s["r"], r["key"]), F.lit(a))).otherwise(s["l"])
        right = F.when(r["side"] == 1, F.pmod(s["r"] + sign * _mixed(s["l"], r["key"]), F.lit(b))).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct((x % a).cast("long").alias("l"), F.floor(x / a).cast("long").alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["l"] + s["r"] * F.lit(a).cast("long"))


def _walked(x: Column, n: int, keys: list[int], back: bool = False) -> Column:
    a, b = _grid(n)
    outside = a * b - n
    first = _permuted(x, n, keys, back)
    if outside <= 0:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(outside, MAX_WALK))), first,
                       lambda y, _: F.when(y < n, y).otherwise(_permuted(y, n, keys, back)))
    if outside <= MAX_WALK:
        return walk
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("walk too long: change the round keys")).cast("long"))


def place_of(row_no: Column, n: int, keys: list[int] = ROUND_KEYS) -> Column:
    """Permuted place of a row number below ``n``."""
    return _walked(row_no, n, keys)


def row_of(shard: Column, slot: Column, n: int, shards: int = SHARDS, keys: list[int] = ROUND_KEYS) -> Column:
    """The row number that sits in a slot of a shard."""
    return _walked(slot * shards + shard, n, keys, back=True)


def shard_rows(df: DataFrame, order_by: list[str], shards: int = SHARDS, keys: list[int] = ROUND_KEYS) -> DataFrame:
    """``df`` with ``row_no``, ``shard`` and ``slot``."""
    own = ("row_no", "shard", "slot")
    carried = df.select(*[col(c) for c in df.columns if c not in own])
    numbered, n = global_row_number(carried, order_by)
    placed = numbered.withColumn("_lw_place", place_of(F.col("_row_no"), n, keys))
    return placed.select(
        *[col(c) for c in carried.columns], F.col("_row_no").alias("row_no"),
        (F.col("_lw_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_lw_place") / shards).cast("long").alias("slot"))


def q_sharding(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", (F.octet_length(text_of("text")) + 1).cast("long").alias("size"),
                       F.crc32(text_of("text").cast("binary")).cast("long").alias("text_crc32"))
    out = shard_rows(slim, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _sql_pass(x: str, source: str) -> str:
    """The network over column ``x`` of ``source``, as nested subqueries."""
    sql = f"(SELECT *, {x} % a AS l, {x} // a AS r FROM {source})"
    for i, key in enumerate(ROUND_KEYS):
        other, own, mod = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        t1 = f"(({other} * 1103515245 + {key}) % {M31})"
        t2 = f"xor({t1}, {t1} >> 15)"
        t3 = f"(({t2} * 1664525 + 1013904223) % {M31})"
        mixed = f"xor({t3}, {t3} >> 13)"
        sql = f"(SELECT * REPLACE (({own} + {mixed}) % {mod} AS {own}) FROM {sql})"
    return sql


def oracle() -> str:
    """The permutation in DuckDB SQL, walking by recursion; DuckDB has no
    CRC-32, so it is folded over the bytes with a derived table of 256 rows."""
    step = _sql_pass("place", "walk WHERE outside")
    first = _sql_pass("rn", "numbered")
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)),
  lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS k))),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
bytes AS (SELECT doc_id, list_transform(range(0, length(x) // 2),
  lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS x FROM hexed),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, x),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
n AS (SELECT count(*)::BIGINT AS n FROM documents),
grid AS (SELECT n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM n),
numbered AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, n, a, b,
  row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS rn FROM documents, grid),
walk AS (
  SELECT doc_id, size, n, a, b, l + r * a AS place, l + r * a >= n AS outside FROM {first}
  UNION ALL
  SELECT doc_id, size, n, a, b, l + r * a AS place, l + r * a >= n AS outside FROM {step})
SELECT walk.doc_id, size, text_crc32, 'rows' AS law, (place % {SHARDS})::INTEGER AS shard, place // {SHARDS} AS slot,
  NULL::INTEGER AS grown_shard
FROM walk JOIN crc ON walk.doc_id = crc.doc_id WHERE NOT outside"""
