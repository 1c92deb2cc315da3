"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the model holds a white-space marker after another character, so
pieces can't cross from a character into a marker: a text is cut before each
run of markers, each distinct marked chunk is segmented once by the
sentencepiece library, and the ids are joined back by the chunks' places. The
result is that of the library on the whole text; ``chunks_hold`` checks the
model for the property the cut needs.

The table is kept per task and filled batch by batch from the distinct new
chunks; past ``TABLE`` chunks it starts anew, so memory is bounded. A table
for all documents at once would have to shuffle every pair of document and
chunk. Nothing is shuffled here, and a lost task is simply run again.

Defined results: a null text is an empty text (the end id alone); ids are never
read; repeated rows are encoded one by one; an empty table gives an empty
result; extra columns are carried along, and an input column named like an
output column gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import packed, text_of, unpacked

MODEL = "piece_bpe_32k.model"
TABLE = 200_000
ROWS = 256
MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
OWN = ("ids", "n_tokens", "decoded")


def load_model(path: str | None = None):
    """The processor for a model file; without a path the public one by name."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))


def chunks_hold(sp) -> bool:
    """No ordinary piece has a marker after another character."""
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())
                   if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))


class ChunkTable:
    """Ids of distinct chunks. A chunk is looked up without its first marker,
    as the library puts one in front of what it encodes; a chunk that is one
    marker alone is that piece."""

    def __init__(self, sp, limit: int = TABLE):
        self.sp, self.limit, self.ids = sp, limit, {}
        self._clear()

    def _clear(self) -> None:
        self.ids = {"": np.array([self.sp.piece_to_id(MARK)], np.int32)}

    @staticmethod
    def chunks(text: str) -> list[str]:
        found = CHUNK.findall(text)
        return found[:1] + [c[1:] for c in found[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.chunks(t) for t in texts]
        if len(self.ids) > self.limit:
            self._clear()
        new = list(set(chain.from_iterable(cut)) - self.ids.keys())
        for chunk, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            self.ids[chunk] = np.array(ids, np.int32)
        end = np.array([self.sp.eos_id()], np.int32)
        return [np.concatenate([*map(self.ids.__getitem__, c), end]) for c in cut]


def _coded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load_model(path)
        if not chunks_hold(sp):
            raise ValueError("a piece of this model crosses white-space markers: chunks can't be encoded alone")
        table = ChunkTable(sp)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = table.encode(part.column("_t").to_pylist())
                decoded = [sp.decode(x.tolist()) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                     pa.array(decoded, pa.string())], names=["_row", "ids", "decoded"])
    return run


def encode(docs: DataFrame, *, text_col: str = "text", model_path: str | None = None,
           carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``carry``) with ids (end id last), n_tokens
    and the decoded text."""
    carry = docs.columns if carry is None else carry
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in carry if c not in OWN])
    rows = docs.select((packed(kept) if kept.columns else F.struct(F.lit(0).alias("x")).alias("_row")),
                       text_of(text_col).alias("_t"))
    kind = rows.schema["_row"].dataType.simpleString()
    coded = rows.mapInArrow(_coded(model_path), f"_row {kind}, ids array<int>, decoded string")
    return coded.select(*unpacked(kept.columns), "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


def q_pieces(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text"), carry=["doc_id"]).select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
