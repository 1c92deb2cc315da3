"""Substring dedup over sliding sentence spans.

A text is cut into sentences (up to and with its end marks and the white space
after them, or a line end; together they are the whole text). A sentence of
more than ``MAX_WORDS`` words is cut into pieces after the longest word (the
last of equal ones) of every ``MAX_WORDS`` words in a row, so pieces have that
many words at most and depend on the words around them only. From every such
unit a run goes on until it holds ``SPAN`` units and ``MIN_WORDS`` words at
least; a text of fewer units is one run, if it has the words. Where no such run
ends at a unit, one goes back from it in the same way, so the end of a passage
is covered too. A run is hashed over the lowered, trimmed units (96 bits); runs
are counted over all documents; every unit that a run covers which isn't the
first of its kind (smallest document id, then earliest place) is removed.

Any 50 whole words that two texts share in a row hold a whole run: at each end
at most ``MAX_WORDS`` words can be cut in another way, and a run has 30 words at
most. Words end at ASCII white space; a character of a script without blanks
(Han, Kana, Hangul, Thai, Lao, Burmese, Khmer) is a word of its own. Other text
without blanks is one word, whatever its length.

Units and hashes are made by numpy within a text. A first pass moves each
document's distinct hashes with its id only, combined within tasks; the hashes
found in two documents are stored with the first one. A second pass moves hash
and place to join these, and only what is to go comes back to the texts. A
passage that a third of all documents share is one row of the first table, and
Spark splits the join's hot key.

Defined results: null and empty texts have no sentences and stay as empty
texts; a null id is below all others; rows with the same id are told apart by
a hash of their text, identical rows are one document and get the same result;
an empty table gives an empty result; extra columns are carried along, and an
input column named like an output column gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SPACE, col, discard, id_of, packed, stored, text_of

SPAN = 3
MIN_WORDS = 12
MAX_WORDS = 10
SENTENCE = r"[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+$"
CUT = re.compile(SENTENCE.replace("$", r"\Z"))

# characters of scripts without blanks between words: each one is a word
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF),
         (0xFF00, 0xFFEF))
MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def layout(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(starts, words, sentence) of a text's units, and its number of sentences;
    the starts end with the text's length."""
    ends = np.array([m.end() for m in CUT.finditer(low)], np.int64)
    if not len(ends):
        return np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    code = np.frombuffer(low.encode("utf-32-le"), "<u4")
    space = (code == 32) | ((code >= 9) & (code <= 13))
    begin = np.ones(len(code), bool)
    begin[1:] = space[:-1]
    begin[ends[:-1]] = True
    if code.max() >= ALONE[0][0]:
        alone = np.zeros(len(code), bool)
        for a, b in ALONE:
            alone |= (code >= a) & (code <= b)
        begin |= alone
        begin[1:] |= alone[:-1]
    begin &= ~space
    words = np.flatnonzero(begin)
    of = np.searchsorted(ends, words, "right")
    cuts = np.empty(0, np.int64)
    if len(words) > MAX_WORDS:
        size = np.bincount(np.cumsum(begin)[~space] - 1, minlength=len(words))
        # the longest word, then the last one, in one number
        order = (size << 32) | np.arange(len(words))
        inside = np.flatnonzero(of[MAX_WORDS - 1:] == of[:len(of) - MAX_WORDS + 1])
        if len(inside):
            best = np.lib.stride_tricks.sliding_window_view(order, MAX_WORDS)[inside].max(1)
            last = np.unique(best & 0xFFFFFFFF)
            # a sentence of MAX_WORDS words stays whole
            last = last[np.bincount(of)[of[last]] > MAX_WORDS]
            last = last[last + 1 < len(words)]
            cuts = words[(last + 1)[of[last] == of[last + 1]]]
    starts = np.unique(np.concatenate([[0], ends[:-1], cuts]))
    bounds = np.append(starts, len(code))
    return bounds, np.diff(np.searchsorted(words, bounds)), np.searchsorted(ends, starts, "right"), len(ends)


def runs(words: np.ndarray, span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, unit after the last) of a text's runs, in order of the first."""
    n, total = len(words), np.concatenate([[0], np.cumsum(words)])
    if n < span:
        whole = [0] if n and total[n] >= min_words else []
        return np.array(whole, np.int64), np.array([n] * len(whole), np.int64)
    at = np.arange(n)
    to = np.maximum(at + span, np.searchsorted(total, total[:-1] + min_words))
    at, to = at[to <= n], to[to <= n]
    rest = np.setdiff1d(np.arange(1, n + 1), to)
    back = np.minimum(rest - span, np.searchsorted(total, total[rest] - min_words, "right") - 1)
    at, to = np.concatenate([at, back[back >= 0]]), np.concatenate([to, rest[back >= 0]])
    order = np.lexsort((to, at))
    return at[order], to[order]


def hashed_runs(text: str, span: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(at, to, h, g) of a text's runs: 64 and 32 bits over the units."""
    low = text.encode().lower().decode()  # A-Z alone
    bounds, words, _, _ = layout(low)
    at, to = runs(words, span, min_words)
    cut = bounds.tolist()
    keys = np.array([xxhash.xxh3_64_intdigest(low[a:b].strip(SPACE)) for a, b in zip(cut, cut[1:], strict=False)],
                    np.uint64)
    h, g = np.full(len(at), 1, np.uint64), np.full(len(at), 2, np.uint64)
    for k in range(int((to - at).max(initial=0))):
        more = np.flatnonzero(at + k < to)
        key = keys[at[more] + k]
        for v, m, shift in ((h, MIX[0], np.uint64(29)), (g, MIX[1], np.uint64(31))):
            x = (v[more] ^ key) * m
            v[more] = (x ^ (x >> shift)) * MIX[1]
    return at, to, h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _later_in_text(h: np.ndarray) -> np.ndarray:
    """Runs that stand earlier in the same text already."""
    later = np.ones(len(h), bool)
    later[np.unique(h, return_index=True)[1]] = False
    return later


def _emit(span: int, min_words: int, places: bool):
    """The distinct runs of each text; or all, with their places and whether
    they stand earlier in the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for text in batch.column("_t").to_pylist():
                at, to, h, g = hashed_runs(text, span, min_words)
                later = _later_in_text(h)
                new = np.arange(len(h)) if places else np.flatnonzero(~later)
                parts.append((h[new], g[new], at[new] << 32 | to[new], later[new]))
                sizes.append(len(new))
            h, g, at, later = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))
            of = np.repeat(np.arange(len(sizes)), sizes)
            columns = [batch.column(c).take(pa.array(of)) for c in ("_doc", "_rid")]
            columns += [pa.array(h, pa.int64()), pa.array(g.astype(np.int32), pa.int32())]
            names = ["_doc", "_rid", "_h", "_g"]
            if places:
                columns += [pa.array(at, pa.int64()), pa.array(later.astype(bool), pa.bool_())]
                names += ["_place", "_again"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _cleaned(text: str, gone: list[int] | None) -> tuple[str, int, int]:
    """(text without the units of the places in ``gone``, sentences, sentences that lose text)."""
    if not gone:
        return text, sum(1 for _ in CUT.finditer(text)), 0
    bounds, words, sentence, n = layout(text.encode().lower().decode())
    places = np.array(gone, np.int64)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, places >> 32, 1)
    np.add.at(step, places & 0xFFFFFFFF, -1)
    out = np.cumsum(step)[:-1] > 0
    left = [text[a:b] for a, b, x in zip(bounds.tolist(), bounds[1:].tolist(), out.tolist(), strict=False) if not x]
    return "".join(left), n, len(np.unique(sentence[out]))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_cleaned(t, x) for t, x in zip(batch.column("_t").to_pylist(), batch.column("_gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array([r[0] for r in rows], pa.string()),
             *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))],
            names=["_row", "_kept", "n_sentences", "n_removed"])


def dedup_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the cleaned text in ``text_col``, ``n_sentences`` (before)
    and ``n_removed`` (sentences that lost text)."""
    others = [c for c in docs.columns if c not in (text_col, "n_sentences", "n_removed")]
    row = packed(docs.select(*[col(c) for c in others])) if others else F.struct(F.lit(0).alias("x")).alias("_row")
    rows = docs.select(row, id_of(id_col).alias("_doc"), text_of(text_col).alias("_t"))
    unique = rows.groupBy("_doc").count().filter("count > 1").isEmpty()
    rows = rows.withColumn("_rid", F.lit(0).cast("long") if unique else F.xxhash64("_t"))
    place = F.col("_doc") if unique else F.struct("_doc", "_rid")
    kind = "_doc bigint, _rid bigint, _h bigint, _g int"
    texts = rows.select("_doc", "_rid", "_t")
    repeated = stored(texts.mapInArrow(_emit(span, min_words, False), kind).groupBy("_h", "_g")
                      .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
                      .filter("_n > 1").select("_h", "_g", "_first"), "repeated")
    later = (texts.mapInArrow(_emit(span, min_words, True), kind + ", _place bigint, _again boolean")
             .join(repeated, ["_h", "_g"], "left").filter(F.col("_again") | (place != F.col("_first"))))
    gone = stored(later.groupBy(F.col("_doc").alias("_doc2"), F.col("_rid").alias("_rid2"))
                  .agg(F.collect_set("_place").alias("_gone")), "gone")
    discard(repeated)
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("_doc") == F.col("_doc2")) & (F.col("_rid") == F.col("_rid2")),
                       "left").select("_row", "_t", "_gone")
    out = joined.mapInArrow(_clean, f"_row {rows.schema['_row'].dataType.simpleString()}, _kept string, "
                            "n_sentences bigint, n_removed bigint")
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col("_row").getField(c).alias(c)
                        for c in docs.columns if c not in ("n_sentences", "n_removed")], "n_sentences", "n_removed")


def q_span_dedup(docs: DataFrame) -> DataFrame:
    return dedup_spans(docs.select("doc_id", "text")).select(
        "doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    """The same rule with runs as lists of whole units."""
    alone = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ALONE)
    ws = r"[\x20\x09-\x0D]*"
    token = rf"{ws}(?:[{alone}]|[^\x20\x09-\x0D{alone}]+){ws}"
    parts = r"regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+$')"
    trim = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    most = max(SPAN, MIN_WORDS + 1)
    return rf"""
WITH s AS (SELECT doc_id, unnest({parts}) AS s, generate_subscripts({parts}, 1) AS si FROM documents),
l AS (SELECT *, regexp_extract_all(s, '{token}') AS ws FROM s),
w AS (SELECT doc_id, si, unnest(ws) AS w, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM l WHERE len(ws) > {MAX_WORDS}),
b AS (SELECT *, max(length({trim.format('w')}) * 4294967296 + j) OVER
        (PARTITION BY doc_id, si ORDER BY j ROWS BETWEEN CURRENT ROW AND {MAX_WORDS - 1} FOLLOWING) % 4294967296 AS e FROM w),
e AS (SELECT DISTINCT doc_id, si, e AS j FROM b WHERE j <= n - {MAX_WORDS - 1}),
p AS (SELECT w.*, coalesce(count(e.j) OVER
        (PARTITION BY w.doc_id, w.si ORDER BY w.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece
      FROM w LEFT JOIN e ON w.doc_id = e.doc_id AND w.si = e.si AND w.j = e.j),
u0 AS (SELECT doc_id, si, piece, string_agg(w, '' ORDER BY j) AS t, count(*) AS n FROM p GROUP BY ALL
       UNION ALL SELECT doc_id, si, 0, s, len(ws) FROM l WHERE len(ws) <= {MAX_WORDS}),
u AS (SELECT doc_id, si, t, n, row_number() OVER (PARTITION BY doc_id ORDER BY si, piece) - 1 AS i,
        count(*) OVER (PARTITION BY doc_id) AS size,
        translate({trim.format('t')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u0),
r AS (SELECT doc_id, i, size, list(key) OVER f AS kf, list(n) OVER f AS nf, list(key) OVER g AS kb, list(n) OVER g AS nb
      FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {most - 1} FOLLOWING),
                    g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {most - 1} PRECEDING AND CURRENT ROW)),
o AS (SELECT *, list_filter(range(least({SPAN}, size), len(nf) + 1), lambda k: list_sum(nf[1:k]) >= {MIN_WORDS})[1] AS lf,
        list_filter(range({SPAN}, len(nb) + 1), lambda k: list_sum(nb[len(nb) - k + 1:len(nb)]) >= {MIN_WORDS})[1] AS lb FROM r),
fw AS (SELECT doc_id, i AS a, i + lf - 1 AS z, kf[1:lf] AS run FROM o WHERE lf IS NOT NULL AND (size >= {SPAN} OR i = 0)),
c AS (SELECT * FROM fw UNION ALL
      SELECT doc_id, i - lb + 1, i, kb[len(kb) - lb + 1:len(kb)] FROM o
      WHERE lb IS NOT NULL AND size >= {SPAN} AND NOT EXISTS (SELECT 1 FROM fw WHERE fw.doc_id = o.doc_id AND fw.z = o.i)),
d AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS rn FROM c),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM d WHERE rn > 1),
f AS (SELECT u.*, gone.i IS NOT NULL AS g FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i),
a AS (SELECT doc_id, count(DISTINCT si) AS n, count(DISTINCT si) FILTER (WHERE g) AS r,
        string_agg(t, '' ORDER BY i) FILTER (WHERE NOT g) AS t FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(r, 0)::BIGINT AS n_removed,
  sha256(coalesce(a.t, '')) AS kept_sha256 FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""
