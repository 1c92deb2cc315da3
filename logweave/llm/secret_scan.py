"""Secret scan: three fixed patterns and character Markov models.

Base spans come from the patterns, leftmost and non-overlapping per kind. The
method adds ``markov`` spans: tokens of secret-like characters whose
log-likelihood under a character Markov model of random strings exceeds that
under a model of ordinary identifiers by ``MIN_RATIO`` per transition. Tokens of
fewer than 20 characters are not scored (shorter words and numbers come close to
random strings); the base patterns find shorter secrets where they are assigned
to a name. Both
models are first-order tables over 65 character classes (letters, digits, two
signs, rest) with add-one smoothing. They are trained from labelled samples:
values that the base patterns find in the documents plus hash-made random
strings (label random), and the other tokens of the documents (label
ordinary). The sample is bounded by ``SAMPLE_DOCS`` documents, chosen by the
smallest hashes of their ids; the scan covers every whole text.

Match places come from the pieces between matches: the same pattern gives the
matches and the pieces, and sums of their code points, in blocks and over the
blocks, give start and end. All of it is column expressions; nothing is shuffled but the sample.

Defined results: a null text is an empty text without spans; null ids stay
null; repeated rows are scanned one by one; an empty table gives an empty
result (the models are then trained on random strings alone); extra columns are
carried along, and an input column named like an output column gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import col, packed, text_of, unpacked

# fixed patterns of the contract: kind, pattern, group that is measured, least characters
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
N_CLASSES = len(CLASSES) + 1
SAMPLE_DOCS = 2000
RANDOM_STRINGS = 4000
MIN_RATIO = 0.3
BLOCK = 64
OWN = ("n_assign", "n_access", "n_hex", "base_spans", "spans")


def _bound(value: Column, body) -> Column:
    """``body(value)``, an array, with ``value`` computed once."""
    return F.flatten(F.transform(F.array(value), body))


def matches(text: str, pattern: str, group: int, least: int, kind: str, keep=None) -> Column:
    """Spans (start, end, order of the kind, kind) of the matches that are long
    enough (and for which ``keep`` of the matched text holds), in code points.

    Places are sums of the lengths of matches and of the texts between them,
    taken in two levels: within blocks of ``BLOCK`` matches, then over the
    blocks, so the work grows with the matches and not with their square."""
    order = [k for k, *_ in BASE].index(kind) if kind in [k for k, *_ in BASE] else len(BASE)
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else found
    # the last piece, after all matches, has no match beside it
    pieces = F.split(F.col(text), pattern, -1)
    zipped = F.filter(F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m"), measured.alias("g")), lambda x: F.struct(
        F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("len"),
        ((F.char_length(x["g"]) >= least) & (keep(x["m"]) if keep else F.lit(True))).alias("ok"))), lambda x: x["len"].isNotNull())
    empty = F.array().cast("array<struct<s:int,e:int,k:int,kind:string>>")

    def of_block(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("spans")), lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.when(x["ok"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e"),
                F.lit(order).alias("k"), F.lit(kind).alias("kind"))))).otherwise(acc["spans"]).alias("spans")))

    def placed(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x["at"])))
        return _bound(before, lambda start: F.flatten(F.transform(blocks, lambda x, i: F.transform(
            x["spans"], lambda y: F.struct((y["s"] + F.get(start, i)).alias("s"), (y["e"] + F.get(start, i)).alias("e"),
                                           y["k"].alias("k"), y["kind"].alias("kind"))))))

    walked = _bound(zipped, lambda z: _bound(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")),
                    lambda k: of_block(F.slice(z, k * BLOCK + 1, F.lit(BLOCK)))), placed))
    return F.when(F.col(text).rlike(pattern), walked).otherwise(empty)


def _class_of(c: Column) -> Column:
    """Class of a character: its place among CLASSES, 0 for the rest."""
    return F.instr(F.lit(CLASSES), c)


def _chars(token: Column) -> Column:
    return F.split(token, "")


def labelled_samples(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(random 0/1, token): base values and random strings against the other
    tokens of a bounded sample of documents."""
    hashed = docs.select(F.xxhash64(F.lit(5), col(id_col).cast("string")).alias("_h"), text_of(text_col).alias("_t"))
    # the cut comes from ids alone; the last limit only bounds rows that share an id
    cut = hashed.select("_h").orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
    sample = hashed.filter(F.col("_h") <= F.lit(cut)).limit(sample_docs).select("_t")
    part = F.lit(r"[A-Za-z0-9+/_-]{4,}")
    kind, pattern, group, least = BASE[0]
    assigned = F.filter(F.regexp_extract_all("_t", F.lit(pattern), F.lit(group)), lambda v: F.char_length(v) >= least)
    both = sample.select(F.regexp_extract_all("_t", part, F.lit(0)).alias("_tokens"),
                         F.flatten(F.transform(assigned, lambda v: F.regexp_extract_all(v, part, F.lit(0)))).alias("_values"))
    tokens = both.select(F.explode(F.concat(
        F.transform(F.array_except("_tokens", "_values"), lambda t: F.struct(t.alias("_tok"), F.lit(False).alias("_value"))),
        F.transform("_values", lambda t: F.struct(t.alias("_tok"), F.lit(True).alias("_value"))))).alias("_x")).select("_x.*")
    is_base = F.col("_tok").rlike(r"^[0-9a-f]{16,}$|^AKIA[A-Z0-9]{14,}$") & ~F.col("_tok").rlike("^[0-9]+$")
    found = tokens.select((F.col("_value") | is_base).cast("int").alias("_random"), "_tok")
    ids = docs.sparkSession.range(RANDOM_STRINGS)
    raw = F.unhex(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256))
    made = ids.select(F.lit(1).alias("_random"), F.explode(F.array(
        F.regexp_replace(F.base64(raw), "=", ""), F.lower(F.hex(raw)), F.hex(raw))).alias("_tok"))
    return found.unionByName(made)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all class pairs, random against ordinary, as
    one flat table of N_CLASSES squared numbers."""
    chars = samples.select("_random", F.transform(_chars(F.col("_tok")), _class_of).alias("_c")).filter(F.size("_c") > 1)
    pairs = chars.select("_random", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_c") - 1),
        lambda i: F.element_at("_c", i) * N_CLASSES + F.element_at("_c", i + 1))).alias("_p"))
    counts = {(r["_random"], r["_p"]): r["n"] for r in
              pairs.groupBy("_random", "_p").agg(F.count("*").alias("n")).collect()}  # at most 2 * 65 * 65 rows
    logs = []
    for label in (1, 0):
        rows = [[counts.get((label, a * N_CLASSES + b), 0) + 1 for b in range(N_CLASSES)] for a in range(N_CLASSES)]
        logs.append([math.log(n / sum(row)) for row in rows for n in row])
    return [a - b for a, b in zip(*logs, strict=True)]


def score(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    end = F.aggregate(
        _chars(token), F.struct(F.lit(-1).alias("c"), F.lit(0.0).alias("sum")),
        lambda acc, ch: F.struct(
            _class_of(ch).alias("c"),
            F.when(acc["c"] < 0, F.lit(0.0)).otherwise(
                acc["sum"] + F.element_at(table, acc["c"] * N_CLASSES + _class_of(ch) + 1)).alias("sum")),
        lambda acc: acc["sum"])
    return end / (F.char_length(token) - 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
         min_ratio: float = MIN_RATIO, model: list[float] | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and spans (both as
    ``kind:start:end`` joined by commas)."""
    model = train(labelled_samples(docs, id_col, text_col, sample_docs)) if model is None else model
    rows = docs.select(packed(docs), text_of(text_col).alias("_t"))
    rows = rows.select("_row", "_t", *[matches("_t", p, g, n, k).alias(f"_{k}") for k, p, g, n in BASE],
                       matches("_t", TOKEN, 0, 20, "markov", lambda m: score(m, model) >= min_ratio).alias("_tokens"))
    rows = rows.select("*", F.concat(*[F.col(f"_{k}") for k, *_ in BASE]).alias("_base"))
    odd = F.filter("_tokens", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    rows = rows.select("*", F.when(F.size("_tokens") > 0, odd).otherwise(F.col("_tokens")).alias("_odd"))

    def ordered(spans: Column) -> Column:
        return F.sort_array(F.transform(spans, lambda x: F.struct(
            x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))

    return rows.select(
        *unpacked(docs.columns, without=OWN), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE],
        _joined(ordered(F.col("_base"))).alias("base_spans"),
        _joined(ordered(F.concat("_base", "_odd"))).alias("spans"))


def q_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans")
