"""Quality rules: a threshold table compiled into one projection.

Every rule is a row of ``RULES``: a numerator and a denominator out of the
measured columns, a lower and an upper bound on their ratio. ``measured`` adds
the measures as plain column expressions, ``verdict`` compiles the table into
one boolean expression; nothing is shuffled. Rules on word lengths and on the
stop words of four languages say nothing of a text that is mostly written in
another script than Latin (``latin_only``); a text in another language of Latin
script is judged by them.

Defined results: a null text counts as no text (no words, not kept); an id of
null stays null; repeated rows are judged one by one; an empty table gives an
empty result; extra columns never clash, as the operator reads only the two
columns it is told to. Windows are told apart by 64-bit hashes inside one
document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import WORD, packed, text_of, unpacked

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "not",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with", "you",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "dans", "de", "du", "elle", "en", "et", "il", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui",
    "sur", "un", "une",
    "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "una", "y",
]


class Rule(NamedTuple):
    name: str
    part: str
    whole: str
    at_least: float
    at_most: float
    latin_only: bool = False  # says nothing of a text whose letters are mostly of another script


# thresholds on ratios of the measured columns
RULES = [
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 20.0, latin_only=True),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("shouted_share", "n_upper", "word_chars", 0.0, 0.4),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, 1.0, latin_only=True),
    Rule("dup_line_share", "n_dup_lines", "n_text_lines", 0.0, 0.5),
]

# characters of other scripts than Latin, from Greek on
OTHER_SCRIPT = r"[\x{370}-\x{1CFF}\x{1F00}-\x{1FFF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}]"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stop_words",
            "n_text_lines", "n_other_script"]


def _covered() -> Column:
    """Words inside windows that occur twice or more: the length of the union
    of the windows that start at the sorted places in ``_at``."""
    return F.aggregate(
        F.sequence(F.lit(1), F.size("_at") - 1), F.lit(WINDOW).cast("long"),
        lambda n, k: n + F.least(F.lit(WINDOW), F.element_at("_at", k + 1) - F.element_at("_at", k)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_row`` (all columns of ``docs``) and the measures of each text."""
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    staged = (docs.select(packed(docs), text_of(text_col).alias("_t"))
              .select("*", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), lines.alias("_l"))
              .select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
              .select("*", F.when(F.size("_h") > WINDOW, F.transform(
                  F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)),
                  lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).alias("_x"))
              .select("*", F.when(F.size(F.array_distinct("_x")) < F.size("_x"), F.sort_array(F.transform(
                  "_x", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s")))

    def same(k: Column, other: Column) -> Column:
        return F.element_at("_s", k)["h"] == F.element_at("_s", other)["h"]

    size = F.size("_s")
    staged = staged.select("*", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(1), size), lambda k: F.when(k > 1, same(k, F.greatest(k - 1, F.lit(1))))
                 .otherwise(F.lit(False)) | F.when(k < size, same(k, F.least(k + 1, size))).otherwise(F.lit(False))),
        lambda k: F.element_at("_s", k)["i"]))).alias("_at"))
    return staged.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_at").isNull(), F.lit(0).cast("long")).when(F.size("_at") == 1, F.lit(WINDOW).cast("long"))
        .otherwise(_covered()).alias("n_repeat_words"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_text_lines"),
        # no such character in a text of one byte each
        F.when(F.octet_length("_t") == F.char_length("_t"), F.lit(0)).otherwise(
            F.regexp_count("_t", F.lit(OTHER_SCRIPT))).cast("long").alias("n_other_script"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def rule_passes(rule: Rule) -> Column:
    """One row of the table as a condition; a ratio over nothing is 0."""
    whole = F.col(rule.whole)
    ratio = F.when(whole > 0, F.col(rule.part) / whole).otherwise(F.lit(0.0))
    passed = (ratio >= rule.at_least) & (ratio <= rule.at_most)
    return passed | (2 * F.col("n_other_script") > F.col("word_chars")) if rule.latin_only else passed


def verdict(rules: list[Rule] = RULES) -> Column:
    passed = ~base_failed()
    for rule in rules:
        passed = passed & rule_passes(rule)
    return passed


def quality(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``. An input
    column of one of those names gives way to the operator's."""
    own = (*MEASURES, "base_failed", "kept")
    return measured(docs, text_col).select(
        *unpacked(docs.columns, without=own), *MEASURES, base_failed().alias("base_failed"),
        verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only. The verdict
    feeds a generator, as a filter would be pushed through the staged
    projections and repeat their expressions."""
    passed = measured(docs, text_col).select(F.explode(F.when(verdict(rules), F.array("_row"))).alias("_row"))
    return passed.select(*unpacked(docs.columns))


def q_quality(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_upper", "n_stop_words", "n_text_lines")


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _sql_rule(r: Rule) -> str:
    ratio = f"(CASE WHEN {r.whole} > 0 THEN {r.part}::DOUBLE / {r.whole} ELSE 0.0 END)"
    passed = f"{ratio} >= {r.at_least}::DOUBLE AND {ratio} <= {r.at_most}::DOUBLE"
    return f"({passed} OR 2 * n_other_script > word_chars)" if r.latin_only else passed


def oracle() -> str:
    """The contract in DuckDB SQL: windows unnested and compared as text."""
    rules = " AND ".join(_sql_rule(r) for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
wins AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM starts),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM wins),
spots AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS r FROM spots GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
       len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper,
       len(list_filter(w, lambda x: lower(x) IN ({_sql_list(STOP_WORDS)})))::BIGINT AS n_stop_words,
       len(l)::BIGINT AS n_text_lines,
       len(regexp_extract_all(t, '{OTHER_SCRIPT}'))::BIGINT AS n_other_script
      FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {rules}) AS kept, n_upper, n_stop_words, n_text_lines FROM b"""
