"""Rule-based analysis of an event as column expressions (F-07..F-14, F-29).

``severity``: hits = distinct rule keywords of the category found in
lower(message); no hit keeps the base score, else
``min(10, trunc(base * mult * (1 + hits * 0.1)))``, clamped to 1..10.
``explanation`` and ``recommendations`` follow the fixed texts in
``logweave.rules``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import rules as R


def keyword_hits(category: Column, message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(0)
    expr = None
    for cat, (kws, _base, _mult) in R.SEVERITY_RULES.items():
        hits = F.lit(0)
        for kw in kws:
            hits = hits + F.when(F.contains(low, F.lit(kw)), 1).otherwise(0)
        expr = F.when(category == cat, hits) if expr is None else expr.when(category == cat, hits)
    return expr.otherwise(out)


def severity(category: Column, message: Column) -> Column:
    return severity_of_hits(category, keyword_hits(category, message))


def severity_of_hits(category: Column, hits: Column) -> Column:
    expr = None
    for cat, (_kws, base, mult) in R.SEVERITY_RULES.items():
        scaled = F.least(F.lit(10), (F.lit(float(base)) * F.lit(float(mult)) * (F.lit(1.0) + hits * F.lit(R.KEYWORD_STEP))).cast("int"))
        val = F.when(hits > 0, scaled).otherwise(F.lit(base))
        expr = F.when(category == cat, val) if expr is None else expr.when(category == cat, val)
    base_unknown = R.SEVERITY_RULES["unknown"][1]
    return F.greatest(F.lit(1), F.least(F.lit(10), expr.otherwise(F.lit(base_unknown)))).cast("int")


def _tier(score: Column, tiers, default) -> Column:
    expr = None
    for lo, text in tiers:
        expr = F.when(score >= lo, F.lit(text)) if expr is None else expr.when(score >= lo, F.lit(text))
    return expr.otherwise(F.lit(default))


def explanation(category: Column, sev: Column, hits: Column) -> Column:
    context = None
    for cat, text in R.CATEGORY_CONTEXT.items():
        context = F.when(category == cat, F.lit(text)) if context is None else context.when(category == cat, F.lit(text))
    context = context.otherwise(F.lit(R.CONTEXT_DEFAULT))
    return F.concat(
        F.initcap(category), F.lit(" event classified as "), _tier(sev, R.RISK_TIERS, R.RISK_DEFAULT),
        F.lit(" (severity "), sev.cast("string"), F.lit("/10). "),
        F.when(hits > 0, F.concat(F.lit("Contains "), hits.cast("string"), F.lit(" security-relevant keyword(s). "))).otherwise(F.lit("")),
        context,
    )


def _arr(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def recommendations(category: Column, sev: Column, message: Column) -> Column:
    by_sev = None
    for lo, items in R.SEVERITY_RECOMMENDATIONS:
        by_sev = F.when(sev >= lo, _arr(items)) if by_sev is None else by_sev.when(sev >= lo, _arr(items))
    by_sev = by_sev.otherwise(_arr(R.SEVERITY_RECOMMENDATIONS_DEFAULT))
    by_cat = None
    for cat, items in R.CATEGORY_RECOMMENDATIONS.items():
        if cat == "auth":
            items_col = F.when(F.instr(F.lower(message), "failed") > 0, _arr(items + [R.AUTH_FAILED_RECOMMENDATION])).otherwise(_arr(items))
        else:
            items_col = _arr(items)
        by_cat = F.when(category == cat, items_col) if by_cat is None else by_cat.when(category == cat, items_col)
    by_cat = by_cat.otherwise(F.array().cast("array<string>"))
    recs = F.concat(by_sev, by_cat)
    recs = F.when(F.size(recs) < R.MIN_RECOMMENDATIONS, F.concat(recs, _arr(R.PAD_RECOMMENDATIONS))).otherwise(recs)
    return F.slice(recs, 1, R.MAX_RECOMMENDATIONS)


def ui_severity_label(sev: Column) -> Column:
    """F-12: Critical / High / Medium / Low / Info at 9 / 7 / 5 / 3."""
    return _tier(sev, R.UI_SEVERITY_LABELS, R.UI_SEVERITY_DEFAULT)


def alert_severity_label(sev: Column) -> Column:
    """F-13: Low <= 2, Medium <= 4, High <= 6, Critical <= 8, else Very Critical."""
    expr = None
    for hi, text in R.ALERT_SEVERITY_LABELS:
        expr = F.when(sev <= hi, F.lit(text)) if expr is None else expr.when(sev <= hi, F.lit(text))
    return expr.otherwise(F.lit(R.ALERT_SEVERITY_DEFAULT))


def decode_recommendations(text: Column) -> Column:
    """F-29: JSON array text -> array, else a one-element array of the text."""
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).otherwise(
        F.coalesce(F.from_json(text, "array<string>"), F.array(text)))


def score(df, category: str = "category", message: str = "message"):
    """Add ``keyword_hits severity_score explanation recommendations``."""
    cat, msg = F.col(category), F.col(message)
    staged = df.withColumn("keyword_hits", keyword_hits(cat, msg))
    staged = staged.withColumn("severity_score", severity_of_hits(cat, F.col("keyword_hits")))
    return staged.withColumn("explanation", explanation(cat, F.col("severity_score"), F.col("keyword_hits"))).withColumn(
        "recommendations", recommendations(cat, F.col("severity_score"), msg))
