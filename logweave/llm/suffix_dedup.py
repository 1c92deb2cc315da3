"""Suffix-order dedup by prefix-free parsing.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier
(smaller document id, or earlier in the document) is removed; matches never
cross documents and are judged on the input.

Parsing. The rolling hash of every ``GRAM`` bytes gives a priority; the trigger
of a ``LENGTH``-byte window is its gram of least priority (the first of
equals). The trigger depends on the window's bytes alone, so equal windows
have equal triggers at equal offsets, and every window has one. A phrase is a
run of window starts with one trigger, together with the bytes its windows
reach: the parse of a document is its list of phrases, the dictionary the
distinct phrases with their first places.

Combining. The corpus order is needed to the depth of ``LENGTH`` bytes only,
and only where a trigger's gram occurs more than once. There suffixes are
brought together by (gram, phrase): every occurrence of a phrase but the first
is covered by an earlier one as a whole. What is left are the first occurrences
of distinct phrases that share a gram - the dictionary's own suffixes. They are
cut once more by the offset of the trigger, ``PART`` offsets a part; all windows of a
part share its core of ``LENGTH - PART + 1`` bytes. Parts whose core is found
once only hold no repeat; of equal parts all but the first are covered as a
whole; the windows of the others are brought together by (gram, hash of
their ``LENGTH`` bytes), and all but the first place of each are repeats. Full
suffix arrays are not kept: within a gram, equality to that depth and the first
place decide.

Only the grams of all triggers and one row per phrase are shuffled, about one
per 35 bytes; texts move to where their phrases are cut and once at the end.
Minima are pre-aggregated, so a passage in a third of all documents is one row
per task; the joins' hot keys are split by Spark. Long texts are parsed in
pieces that overlap; a phrase cut at a piece's end only becomes two.

Defined results: a null text is an empty text; a null id is below all others;
rows with the same id are told apart by a hash of their texts, identical rows
are one document and get the same result; an empty table gives an empty result;
extra columns are carried along, and an input column named like an output
column gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import discard, id_of, packed, stored, text_of, unpacked

LENGTH = 100
GRAM = 32
PART = 17
PIECE = 1 << 18
OWN = ("n_bytes", "n_removed", "n_spans", "kept")

_ROOM = 2 * PIECE + 4 * LENGTH


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte range from prefix sums of byte codes times powers,
    modulo 2**64."""

    def __init__(self, seed: int, base: int):
        self.codes = _mixed(np.arange(seed, seed + 256, dtype=np.uint64))
        self.powers = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        steps = np.full(_ROOM, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]

    def all(self, sums: np.ndarray, width: int) -> np.ndarray:
        return (sums[width:] - sums[:-width]) * self.inverse[:len(sums) - width]


_tables: list[Rolling] = []


def _rolling() -> list[Rolling]:
    """The two independent hashes, made once per worker: grams, strings."""
    if not _tables:
        _tables.extend([Rolling(1, 0x9E3779B97F4A7C15), Rolling(100_001, 0xD6E8FEB86659FD93)])
    return _tables


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Parse(NamedTuple):
    """Phrases of texts laid end to end: text index, first and last window
    start and trigger (places in the joined bytes), hash of the trigger's gram;
    prefix sums of the joined bytes for the hashes of strings."""

    text: np.ndarray
    a: np.ndarray
    b: np.ndarray
    trigger: np.ndarray
    gram: np.ndarray
    sums: np.ndarray


def _phrases_of(data: np.ndarray, lengths: np.ndarray) -> Parse:
    grams, strings = _rolling()
    n = len(data)
    sums = strings.sums(data)
    if n < LENGTH:
        empty = np.empty(0, np.int64)
        return Parse(empty, empty, empty, empty, empty.view(np.uint64), sums)
    gram = _mixed(grams.all(grams.sums(data), GRAM))
    mask = np.uint64((1 << n.bit_length()) - 1)
    low = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if want > width:
        low = np.minimum(low[:width - want], low[want - width:])
    trigger = (low & mask).astype(np.int64)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)[:len(trigger)]
    start = np.flatnonzero(np.arange(len(trigger)) + LENGTH <= ends[text])
    trigger, text = trigger[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return Parse(text[first], start[first], start[last], trigger[first], gram[trigger[first]], sums)


def _phrase_hash(p: Parse) -> np.ndarray:
    return _mixed(_rolling()[1].of(p.sums, p.a, p.b + LENGTH) + (p.b - p.a).astype(np.uint64))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of texts or overlapping pieces of long texts,
    some PIECE bytes at a time."""
    rows, bases, parts, size = [], [], [], 0
    for row, text in enumerate(batch.column("_t").to_pylist()):
        for base in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[base:base + PIECE + LENGTH - 1]
            rows.append(row)
            bases.append(base)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, bases, parts
                rows, bases, parts, size = [], [], [], 0
    if parts:
        yield rows, bases, parts


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Parse]]:
    """For some texts at a time: the row of each phrase, what to add to get
    from places in the joined bytes to places in its text, and the parse."""
    for rows, bases, parts in _pieces(batch):
        lengths = np.array([len(p) for p in parts], np.int64)
        parse = _phrases_of(np.frombuffer(b"".join(parts), np.uint8), lengths)
        shift = np.array(bases, np.int64) - (np.cumsum(lengths) - lengths)
        yield np.array(rows, np.int64)[parse.text], shift[parse.text], parse


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, parse in _parsed(batch):
            yield pa.RecordBatch.from_arrays([_signed(parse.gram)], names=["_gram"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, shift, parse in _parsed(batch):
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc").take(at), batch.column("_rid").take(at), _signed(parse.gram),
                 _signed(_phrase_hash(parse)), pa.array((parse.a + shift).astype(np.int32)),
                 pa.array((parse.b + shift).astype(np.int32))],
                names=["_doc", "_rid", "_gram", "_phrase", "_a", "_b"])


def _parts(parse: Parse, chosen: np.ndarray):
    """The windows of the chosen phrases in parts by the trigger's offset:
    phrase, first and last start, hash of the core, hash of all bytes."""
    strings = _rolling()[1]
    a, b, trigger = parse.a[chosen], parse.b[chosen], parse.trigger[chosen]
    for j in range((LENGTH - GRAM) // PART + 1):
        core = trigger - PART * j
        first, last = np.maximum(core - PART + 1, a), np.minimum(core, b)
        some = np.flatnonzero(first <= last)
        first, last, core = first[some], last[some], core[some]
        shared = _mixed(strings.of(parse.sums, core, core + LENGTH - PART + 1) + np.uint64(j))
        whole = _mixed(strings.of(parse.sums, first, last + LENGTH) + (last - first).astype(np.uint64))
        yield chosen[some], first, last, shared, whole


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the phrases listed (by first start) with each text, one
    row per part."""
    strings = _rolling()[1]
    for batch in batches:
        lists = batch.column("_starts")
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        wanted = (np.repeat(np.arange(batch.num_rows), counts) << 32) + lists.flatten().to_numpy()
        for row, shift, parse in _parsed(batch):
            chosen = np.flatnonzero(np.isin((row << 32) + parse.a + shift, wanted))
            if not len(chosen):
                continue
            windows = _mixed(strings.all(parse.sums, LENGTH))
            for phrase, first, last, core, whole in _parts(parse, chosen):
                n = last - first + 1
                ends = np.cumsum(n)
                every = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
                at = pa.array(row[phrase])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").take(at), batch.column("_rid").take(at), _signed(parse.gram[phrase]),
                     _signed(core), _signed(whole), pa.array((first + shift[phrase]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                              _signed(windows[every]))],
                    names=["_doc", "_rid", "_gram", "_core", "_whole", "_a", "_hashes"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the union of their spans."""
    for batch in batches:
        n_bytes, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column("_t"), batch.column("_spans"), strict=True):
            text, last, out, gone, n = text.as_py(), 0, [], 0, 0
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans.as_py() or []):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in merged:
                out.append(text[last:s])
                last, gone, n = e, gone + e - s, n + 1
            out.append(text[last:])
            n_bytes.append(len(text))
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["_row", *OWN])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(_doc, _rid, s, e) of byte spans of ``rows`` (``_doc``, ``_rid``,
    ``_t`` binary) that an earlier place holds too; spans may overlap."""
    place = F.struct("_doc", "_rid", "_a")
    first = F.struct("_first._doc", "_first._rid", "_first._a")

    def several(table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.count("*").alias("_c")).filter(F.col("_c") > 1).drop("_c")

    # stored, so that the join's hot grams stand right above an exchange and can be split
    shared = stored(several(rows.mapInArrow(_grams, "_gram long"), "_gram"), "shared_grams")
    found = rows.mapInArrow(_phrases, "_doc long, _rid long, _gram long, _phrase long, _a int, _b int")
    parse = stored(found.join(shared.hint("shuffle_hash"), "_gram"), "parse")

    dictionary = stored(parse.groupBy("_gram", "_phrase").agg(
        F.min(place).alias("_first"), F.count("*").alias("_c")), "dictionary")
    repeats = dictionary.filter(F.col("_c") > 1).select("_gram", "_phrase", "_first")
    phrases = stored(parse.join(repeats, ["_gram", "_phrase"]).filter(place != first).select(
        "_doc", "_rid", F.col("_a").alias("s"), (F.col("_b") + LENGTH).alias("e")), "covered_phrases")
    discard(parse)

    firsts = dictionary.join(several(dictionary, "_gram"), "_gram").select("_first.*")
    of_text = firsts.groupBy("_doc", "_rid").agg(F.collect_list("_a").alias("_starts"))
    parts = stored(rows.join(of_text.hint("shuffle_hash"), ["_doc", "_rid"]).mapInArrow(
        _part_rows, "_doc long, _rid long, _gram long, _core long, _whole long, _a int, _hashes array<long>"), "parts")
    discard(dictionary)
    kinds = stored(parts.groupBy("_gram", "_core", "_whole").agg(
        F.min(place).alias("_first"), F.count("*").alias("_c"), F.max(F.size("_hashes")).alias("_n")), "part_kinds")
    again = kinds.filter(F.col("_c") > 1).select("_gram", "_core", "_whole", "_first", "_n")
    covered = stored(parts.drop("_hashes").join(again, ["_gram", "_core", "_whole"]).filter(place != first).select(
        "_doc", "_rid", F.col("_a").alias("s"), (F.col("_a") + F.col("_n") - 1 + LENGTH).alias("e")), "covered_parts")

    mixed = kinds.join(several(kinds, "_gram", "_core"), ["_gram", "_core"]).select(
        "_gram", "_core", "_whole", "_first.*")
    keys = ["_gram", "_core", "_whole", "_doc", "_rid", "_a"]
    suffixes = stored(parts.join(mixed.hint("shuffle_hash"), keys).select(
        "_doc", "_rid", "_gram", F.col("_a").alias("_from"), F.posexplode("_hashes").alias("_k", "_hash")).select(
        "_doc", "_rid", "_gram", (F.col("_from") + F.col("_k")).alias("_a"), "_hash"), "suffixes")
    discard(parts, kinds)
    ordered = stored(suffixes.groupBy("_gram", "_hash").agg(
        F.min(place).alias("_first"), F.count("*").alias("_c")).filter(F.col("_c") > 1).drop("_c"), "ordered")
    single = stored(suffixes.join(ordered, ["_gram", "_hash"]).filter(place != first).select(
        "_doc", "_rid", F.col("_a").alias("s"), (F.col("_a") + LENGTH).alias("e")), "single")
    discard(suffixes)
    return phrases.unionByName(covered).unionByName(single)


def dedup_suffixes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``carry``) with n_bytes, n_removed, n_spans
    and the kept bytes (binary, as a cut may split a character)."""
    carry = docs.columns if carry is None else carry
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in carry if c not in OWN])
    # where ids are unique no hash is needed to tell rows apart
    shared_ids = docs.groupBy(id_of(id_col).alias("_doc")).agg(F.count("*").alias("_c")).filter(F.col("_c") > 1)
    many = not shared_ids.isEmpty()
    text = text_of(text_col)
    rows = docs.select(
        packed(kept) if kept.columns else F.struct(F.lit(0).alias("x")).alias("_row"), id_of(id_col).alias("_doc"),
        (F.xxhash64(text) if many else F.lit(0).cast("long")).alias("_rid"), text.cast("binary").alias("_t"))
    bare = rows.select("_doc", "_rid", "_t")
    spans = repeated_spans(bare.dropDuplicates(["_doc", "_rid"]) if many else bare)
    of_text = spans.groupBy("_doc", "_rid").agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    kind = rows.schema["_row"].dataType.simpleString()
    joined = rows.join(of_text.hint("shuffle_hash"), ["_doc", "_rid"], "left").select("_row", "_t", "_spans")
    done = joined.mapInArrow(_cut, f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(*unpacked(kept.columns), *OWN)


def q_suffixes(docs: DataFrame) -> DataFrame:
    return dedup_suffixes(docs.select("doc_id", "text"), carry=["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
