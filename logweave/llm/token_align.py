"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded by a byte-level BPE (A, over a space and the text) and by a
sentencepiece model (B, which puts the space in front itself). Both token lists
cut the same bytes, and the byte offsets at which a token of each ends cut them
into groups. Groups are found by diagonal run skipping: the two end arrays are
compared at the current index shift with slices that double while they agree,
so a stretch of one-to-one tokens is jumped in a logarithm of its length; where
they part, the group is resolved token by token up to the next common end, and
its two sizes give the new shift. Inside a group every step of that walk is one
pair of overlapping tokens, so links come out of the same pass.

Links are counted over the whole corpus: a document's distinct id pairs with
their times are written once to the shared folder, pairs are summed with
partial aggregation, the highest count of a B id is a window over that id (at
most one row for each A id), and the pair table is joined back. It is broadcast
where it holds at most ``PAIRS_BROADCAST`` rows (17 bytes each), else the join
is a shuffle join whose hot pairs AQE splits; a document's links are summed
within their task before they move.

A's ids come from tiktoken with the ranks read from the tokenizer's own file,
where a text has only characters up to U+00FF; other texts go to the tokenizers
library. Both give the same
ids (letter and digit classes of those characters are the same in both), the
second is some five times slower.

Defined results: null and empty texts, and texts whose joined A or B bytes
differ from a space and the text (a literal U+2581, say), have no tokens: empty
arrays and zeros. Ids are never read: null, tied and repeated ids stay as they
are, repeated rows are aligned and counted one by one. Texts are taken whole.
An empty table gives an empty result. Extra columns are carried along, and an
input column named like an output column gives way.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import packed, stored, text_of, unpacked
from logweave.llm.piece_codec import load_model

BYTE_MODEL = "byte_bpe_50k.json"
ROWS = 256
NEAR = 4
PAIRS_BROADCAST = 2_000_000

# what ``align`` can give for a text, with its type
OUTPUTS = {
    "ids_a": "array<int>", "ids_b": "array<int>",
    "ends_a": "array<int>", "ends_b": "array<int>",
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
    "links": "array<struct<pair:bigint,times:int>>",
    "groups_sha256": "string",
}


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable
    bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def is_latin(text: str) -> bool:
    """Only characters up to U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteTokens:
    """Ids of the byte-level BPE and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        value = byte_values()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, special = model["model"]["vocab"], {t["content"] for t in model.get("added_tokens", ())}
        own = {t: i for t, i in vocab.items() if t not in special}
        self.table = [b""] * (max(self.whole.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in own.items():
            self.table[i] = bytes(value[c] for c in token)
        self.fast = self._fast(model["model"]["merges"], own)

    def _fast(self, merges: list, own: dict[str, int]):
        """tiktoken over the same vocabulary, if ids follow the merges."""
        import public_tokenizers
        import tiktoken

        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if [own.get(t) for t in joined] != list(range(256, 256 + len(joined))):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={self.table[i]: i for i in own.values()})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and is_latin(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """Ids of the sentencepiece model and the bytes of each id."""

    def __init__(self, path: str | None):
        self.sp = load_model(path)
        self.table = [int(p[1:-1], 16).to_bytes() if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.sp.id_to_piece(list(range(self.sp.get_piece_size()))))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


def walk(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ends, B ends) of the groups as token counts and (A places, B places)
    of the links, from two rising lists of byte ends with the same last end."""
    runs, odd = [], []
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        if a[i] == b[j]:
            # along the diagonal: singly at first, then with slices that double
            k, most = 1, min(n - i, m - j)
            near = most if most < NEAR else NEAR
            while k < near and a[i + k] == b[j + k]:
                k += 1
            if k == NEAR:
                step = NEAR
                while k + step <= most and a[i + k:i + k + step] == b[j + k:j + k + step]:
                    k += step
                    step += step
                while step > 1:  # back to the place where it parts
                    step >>= 1
                    if k + step <= most and a[i + k:i + k + step] == b[j + k:j + k + step]:
                        k += step
            runs += (i, j, k)
            i += k
            j += k
        else:
            while True:
                odd += (i, j)
                x, y = a[i], b[j]
                if x < y:
                    i += 1
                elif x > y:
                    j += 1
                else:
                    break
            # a group ends here: one entry whose "run" is its last link
            runs += (i, j, -1)
            i += 1
            j += 1
    at_a, at_b, long = np.array(runs, np.int64).reshape(-1, 3).T
    odd_a, odd_b = np.array(odd, np.int64).reshape(-1, 2).T
    sizes = np.abs(long)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    all_a, all_b, even = np.repeat(at_a, sizes) + within, np.repeat(at_b, sizes) + within, np.repeat(long > 0, sizes)
    links_a, links_b = np.concatenate([all_a[even], odd_a]), np.concatenate([all_b[even], odd_b])
    return all_a + 1, all_b + 1, links_a, links_b


class Digits:
    """Group texts as bytes: ids in decimal, each with the sign after it."""

    def __init__(self, size_a: int, size_b: int):
        def table(n: int, last: str) -> np.ndarray:
            return np.array([f"{i}{sign}".encode() for sign in (",", last) for i in range(n)])
        self.size_a, self.size_b = size_a, size_b
        self.a, self.b = table(size_a, "|"), table(size_b, ";")

    def sha256(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """Of ``a1,a2|b1;a3|b2,b3``: tokens are put to their places among both lists."""
        if not len(ids_a):
            return ""
        out = np.empty(len(ids_a) + len(ids_b), max(self.a.dtype, self.b.dtype))
        place_a, place_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        # after all B tokens of the groups before, and all A tokens up to the own group's end
        place_a += np.repeat(ends_b - sizes_b, sizes_a)
        place_b += np.repeat(ends_a, sizes_b)
        last_a, last_b = ids_a.copy(), ids_b.copy()
        last_a[ends_a - 1] += self.size_a
        last_b[ends_b - 1] += self.size_b
        out[place_a], out[place_b] = self.a[last_a], self.b[last_b]
        return hashlib.sha256(out.tobytes().replace(b"\0", b"")[:-1]).hexdigest()


@functools.lru_cache(maxsize=2)
def _loaded(byte_path: str | None, piece_path: str | None):
    """Both tokenizers, once for a Python worker."""
    if byte_path is None:
        import public_tokenizers

        byte_path = public_tokenizers.path(BYTE_MODEL)
    a, b = ByteTokens(byte_path), PieceTokens(piece_path)
    lengths = [np.array([len(x) for x in t.table], np.int64) for t in (a, b)]
    return a, b, lengths, Digits(len(a.table), len(b.table))


def _aligned(byte_path: str | None, piece_path: str | None, want: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, (len_a, len_b), digits = _loaded(byte_path, piece_path)
        size_b, no = len(b.table), np.empty(0, np.int64)

        def one(text: str, ids_b: list[int]) -> dict:
            whole = (" " + text).encode() if text else b""
            ia = a.encode(" " + text) if text else no
            ib = np.array(ids_b, np.int64) if text else no
            # A's pieces are cut from the text itself, so none is missing where the lengths agree
            if len_a[ia].sum() != len(whole) or b"".join(map(b.table.__getitem__, ids_b)) != whole:
                ia = ib = no
            ends_a, ends_b, at_a, at_b = walk(np.cumsum(len_a[ia]).tolist(), np.cumsum(len_b[ib]).tolist()) if len(ia) \
                else (no, no, no, no)
            out = {"ids_a": ia, "ids_b": ib, "ends_a": ends_a, "ends_b": ends_b, "n_a": len(ia), "n_b": len(ib),
                   "n_groups": len(ends_a), "n_links": len(at_a)}
            if "links" in want:
                out["links"] = np.unique(ia[at_a] * size_b + ib[at_b], return_counts=True)
            if "groups_sha256" in want:
                out["groups_sha256"] = digits.sha256(ia, ib, ends_a, ends_b)
            return out

        def column(name: str, rows: list[dict]) -> pa.Array:
            kind, got = OUTPUTS[name], [r[name] for r in rows]
            if kind == "string":
                return pa.array(got, pa.string())
            if kind == "bigint":
                return pa.array(got, pa.int64())
            parts = [g[0] if name == "links" else g for g in got]
            offsets = pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32())
            flat = np.concatenate(parts) if parts else no
            if name != "links":
                return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            times = np.concatenate([g[1] for g in got]) if got else no
            return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                [pa.array(flat, pa.int64()), pa.array(times, pa.int32())], ["pair", "times"]))

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = part.column("_t").to_pylist()
                rows = [one(t, ids) for t, ids in zip(texts, b.encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *(column(c, rows) for c in want)],
                                                 names=["_row", *want])
    return run


def align(docs: DataFrame, *, text_col: str = "text", byte_path: str | None = None, piece_path: str | None = None,
          outputs: tuple[str, ...] = ("ids_a", "ids_b", "ends_a", "ends_b"), carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``carry``) with the ``outputs`` asked for:
    both tokenizers' ids, the groups' ends as counts of A and of B tokens, their
    numbers, the distinct linked pairs (A id * B's size + B id) with their
    times, and the hash of the groups' text."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in outputs]
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in carry])
    rows = docs.select((packed(kept) if carry else F.struct(F.lit(0).alias("x")).alias("_row")),
                       text_of(text_col).alias("_t"))
    schema = ", ".join([f"_row {rows.schema['_row'].dataType.simpleString()}", *(f"{c} {OUTPUTS[c]}" for c in outputs)])
    return rows.mapInArrow(_aligned(byte_path, piece_path, outputs), schema).select(*unpacked(carry), *outputs)


def pair_counts(aligned: DataFrame, size_b: int, links: str = "links") -> DataFrame:
    """(pair, count, best) over all links of ``aligned``; ``best`` where the
    count is the highest of the pair's B id."""
    counts = (aligned.select(F.inline(links)).groupBy("pair")
              .agg(F.sum("times").alias("count")))
    top = F.max("count").over(Window.partitionBy(F.pmod("pair", F.lit(size_b))))
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def link_scores(docs: DataFrame, *, text_col: str = "text", byte_path: str | None = None,
                piece_path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups_sha256 and, from the
    corpus-wide pair counts, n_best and count_sum."""
    own = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*own, "n_best", "count_sum")]
    rows = align(docs, text_col=text_col, byte_path=byte_path, piece_path=piece_path, outputs=own, carry=carry)
    inner = rows.select(packed(rows.select(*[F.col("`" + c.replace("`", "``") + "`") for c in carry])) if carry
                        else F.struct(F.lit(0).alias("x")).alias("_row"), *own)
    done = stored(inner.withColumn("_rid", F.monotonically_increasing_id()), "aligned", compression="zstd")
    pairs = stored(pair_counts(done, load_model(piece_path).get_piece_size()), "pairs")
    if pairs.count() <= PAIRS_BROADCAST:
        pairs = F.broadcast(pairs)
    sums = (done.select("_rid", F.inline("links")).join(pairs, "pair").groupBy(F.col("_rid").alias("_rid2"))
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    return done.drop("links").join(sums, F.col("_rid") == F.col("_rid2"), "left").select(
        *unpacked(carry), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def q_alignment(docs: DataFrame) -> DataFrame:
    return link_scores(docs.select("doc_id", "text"), carry=["doc_id"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256")
