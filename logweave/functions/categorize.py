"""Event category by weighted keyword score (F-06), as column expressions.

Per keyword of a category: +1 per non-overlapping occurrence in
``lower(message) + ' ' + lower(source)``, +2 when it occurs as a whole word,
+3 when it occurs in ``lower(source)``. A source holding both ``kernel`` and
``[0]`` is kernel outright; otherwise the highest score wins, ties going to
the first category in keyword-table order, and all zero is ``unknown``.

The whole-word test uses one tokenisation per row instead of one regex per
keyword: every keyword is made of word characters only, so ``\\bkw\\b``
holds exactly when ``kw`` is one of the maximal word runs of the text, and the
number of such keywords of a category is the size of an array intersection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import rules as R


def occurrences(text: Column, kw: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``)."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(kw), F.lit("")))) / len(kw)).cast("int")


def category_scores(message: Column, source: Column) -> dict[str, Column]:
    src = F.lower(source)
    text = F.concat(F.lower(message), F.lit(" "), src)
    return _scores(text, F.split(text, r"(?U)\W+"), src)


def category_inputs(message: Column, source: Column) -> list[Column]:
    """Columns to project before ``category_from_inputs`` (text built once)."""
    src = F.lower(source)
    text = F.concat(F.lower(message), F.lit(" "), src)
    return [src.alias("_cat_src"), text.alias("_cat_text"), F.split(text, r"(?U)\W+").alias("_cat_words")]


def category_score_columns() -> list[Column]:
    """One score column per category from the projected ``_cat_*`` inputs."""
    scores = _scores(F.col("_cat_text"), F.col("_cat_words"), F.col("_cat_src"))
    return [sc.alias(f"_cat_{cat}") for cat, sc in scores.items()]


def category_from_scores() -> Column:
    """Category from the projected ``_cat_<category>`` scores and ``_cat_src``."""
    return _pick({cat: F.col(f"_cat_{cat}") for cat in R.CATEGORY_KEYWORDS}, F.col("_cat_src"))


def _scores(text: Column, words: Column, src: Column) -> dict[str, Column]:
    """Per category: occurrences summed over its keywords, +2 per keyword that
    is one of the words, +3 per keyword inside the source. A keyword that isn't
    in the text (which holds the source) adds nothing, so all but the few found
    cost one search; the terms are plain expressions, compiled as a whole."""
    scores = {}
    for cat, kws in R.CATEGORY_KEYWORDS.items():
        total = F.lit(0)
        for kw in kws:
            found = (occurrences(text, kw) + F.when(F.array_contains(words, kw), R.WORD_BONUS).otherwise(0)
                     + F.when(F.contains(src, F.lit(kw)), R.SOURCE_BONUS).otherwise(0))
            total = total + F.when(F.contains(text, F.lit(kw)), found).otherwise(0)
        scores[cat] = F.when(text.isNotNull(), total)
    return scores


def category_of(message: Column, source: Column) -> Column:
    """Category of an event from its raw message and its source (single
    expression; in a DataFrame prefer ``category_inputs`` + ``category_from_inputs``
    so the text is built once)."""
    src = F.lower(source)
    return _pick(category_scores(message, source), src)


def _pick(scores: dict[str, Column], src: Column) -> Column:
    best = F.greatest(*scores.values())
    pick = F.when((F.instr(src, "kernel") > 0) & (F.instr(src, "[0]") > 0), F.lit("kernel"))
    pick = pick.when(best <= 0, F.lit("unknown"))
    for cat, sc in scores.items():
        pick = pick.when(sc == best, F.lit(cat))
    return pick.otherwise(F.lit("unknown"))
