"""Log format detection as a batch job (D-01, D-03).

Per source, all lines (or, on request, the first ``n`` by a distributed top-n
in line order) are scanned: every timestamp pattern's matches are counted with ``regexp_count``
(non-overlapping, as ``re.findall``), the most frequent kind wins with a
confidence by its share of the sample; delimiter occurrences are counted and
the most frequent non-blank one is the primary delimiter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.windows import top_n

# FIXED VALUES: timestamp kinds and their patterns, in order (ties go to the first)
TIMESTAMP_KINDS = [
    ("syslog", r"\b(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\b"),
    ("iso_datetime", r"\b(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\b"),
    ("iso_with_ms", r"\b(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\b"),
    ("us_datetime", r"\b(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})\b"),
    ("epoch_seconds", r"\b(\d{10})\b"),
    ("epoch_milliseconds", r"\b(\d{13})\b"),
    ("apache_common", r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})\]"),
]
# FIXED VALUES: delimiters in order; the blank is counted but never primary
DELIMITERS = [" ", "\t", "|", ",", ";", ":", "="]
HIGH_SHARE, MEDIUM_SHARE = 0.8, 0.5


def sample_lines(lines: DataFrame, source: str, order: str, n: int | None = None) -> DataFrame:
    """All lines, or the first ``n`` of each source."""
    return lines if n is None else top_n(lines, n, [F.col(order).asc()], [source], salt_by=[order])


def timestamp_counts(line: str) -> list[Column]:
    """Aggregates: matches of each timestamp kind."""
    return [F.sum(F.regexp_count(F.col(line), F.lit("(?U)" + rx))).alias(k) for k, rx in TIMESTAMP_KINDS]


def chosen_timestamp() -> list[Column]:
    """best_pattern, matches and confidence from ``timestamp_counts`` and
    ``sample_lines``."""
    best_n = F.greatest(*[F.col(k) for k, _ in TIMESTAMP_KINDS])
    best = None
    for k, _ in TIMESTAMP_KINDS:
        best = F.when(F.col(k) == best_n, F.lit(k)) if best is None else best.when(F.col(k) == best_n, F.lit(k))
    conf = (F.when(best_n > F.col("sample_lines") * HIGH_SHARE, "high")
            .when(best_n > F.col("sample_lines") * MEDIUM_SHARE, "medium").otherwise("low"))
    return [F.when(best_n > 0, best).alias("best_pattern"), best_n.alias("matches"), conf.alias("confidence")]


def delimiter_count(line: str, d: str) -> Column:
    return F.length(F.col(line)) - F.length(F.replace(F.col(line), F.lit(d), F.lit("")))


def delimiter_counts(line: str) -> list[Column]:
    """Aggregates: occurrences of each delimiter."""
    return [F.sum(delimiter_count(line, d)).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]


def chosen_delimiter() -> list[Column]:
    """primary_delimiter, primary_count, structured and blank_count from
    ``delimiter_counts`` and ``sample_lines``."""
    names = {d: f"d{i}" for i, d in enumerate(DELIMITERS)}
    non_blank = [d for d in DELIMITERS if d != " "]
    top = F.greatest(*[F.col(names[d]) for d in non_blank])
    prim = None
    for d in non_blank:
        prim = F.when(F.col(names[d]) == top, F.lit(d)) if prim is None else prim.when(F.col(names[d]) == top, F.lit(d))
    return [prim.alias("primary_delimiter"), top.alias("primary_count"),
            (top > F.col("sample_lines") * 2).alias("structured"), F.col(names[" "]).alias("blank_count")]


def detect_timestamp(lines: DataFrame, source: str = "source_name", line: str = "line", order: str = "line_no",
                     n: int | None = None) -> DataFrame:
    """D-01: per source the best timestamp kind, its match count, the sample
    size and a confidence (high > 80 %, medium > 50 % of the sample lines)."""
    counts = sample_lines(lines, source, order, n).groupBy(source).agg(
        F.count(F.lit(1)).alias("sample_lines"), *timestamp_counts(line))
    return counts.select(source, "sample_lines", *chosen_timestamp())


def detect_delimiter(lines: DataFrame, source: str = "source_name", line: str = "line", order: str = "line_no",
                     n: int | None = None) -> DataFrame:
    """D-03: per source the delimiter counts over the sample, the primary
    (most frequent non-blank) delimiter and whether it is structured
    (more than two per sample line)."""
    counts = sample_lines(lines, source, order, n).groupBy(source).agg(
        F.count(F.lit(1)).alias("sample_lines"), *delimiter_counts(line))
    return counts.select(source, "sample_lines", *chosen_delimiter())
