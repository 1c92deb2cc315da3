"""Rule severity table, explanation and recommendations (F-07..F-09, F-12/13)."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import severity as S

# category -> severity by number of keyword hits (0, 1, 2, ...), computed from
# base * multiplier * (1 + 0.1 * hits), truncated, capped at 10
TABLE = {
    "security": [8, 10, 10, 10, 10, 10, 10, 10],
    "auth": [6, 7, 7, 8, 9, 9],
    "network": [5, 5, 6, 6, 7, 7],
    "system": [4, 3, 4, 4, 5, 5],
    "application": [3, 2, 2, 3, 3],
    "kernel": [7, 8, 9, 10, 10],
    "unknown": [2],
}
KW = {
    "security": ["attack", "breach", "malware", "virus", "intrusion", "exploit", "vulnerability"],
    "auth": ["failed", "denied", "unauthorized", "invalid", "blocked"],
    "network": ["blocked", "denied", "suspicious", "anomaly", "flood"],
    "system": ["error", "failure", "crash", "panic", "critical"],
    "application": ["error", "exception", "crash", "fatal"],
    "kernel": ["panic", "oops", "fault", "error"],
    "unknown": [],
}


def test_severity_table(spark):
    rows = []
    for cat, sev in TABLE.items():
        for hits, expected in enumerate(sev):
            rows.append((cat, " ".join(KW[cat][:hits]) or "nothing here", expected, hits))
    df = spark.createDataFrame(rows, "category string, message string, expected int, hits int")
    got = df.select("expected", "hits", S.keyword_hits(F.col("category"), F.col("message")).alias("h"),
                    S.severity(F.col("category"), F.col("message")).alias("s")).collect()
    for r in got:
        assert r.h == r.hits
        assert r.s == r.expected


def test_explanation_and_recommendations(spark):
    df = spark.createDataFrame([("auth", "Failed password for root", 7, 1), ("application", "app started", 3, 0)],
                               "category string, message string, sev int, hits int")
    got = df.select(S.explanation(F.col("category"), F.col("sev"), F.col("hits")).alias("e"),
                    S.recommendations(F.col("category"), F.col("sev"), F.col("message")).alias("r")).collect()
    assert got[0].e == ("Auth event classified as medium risk (severity 7/10). Contains 1 security-relevant keyword(s). "
                        "Authentication events require monitoring for potential unauthorized access attempts.")
    assert got[0].r == ["Review within 24 hours", "Monitor for similar events", "Check system status",
                        "Review user account activity"]
    assert got[1].e == ("Application event classified as informational (severity 3/10). "
                        "Event requires review to determine appropriate response.")
    assert got[1].r == ["Log for informational purposes", "Monitor for recurring patterns", "Document in security log"]


@pytest.mark.parametrize("sev,ui,alert", [(10, "Critical", "Very Critical"), (7, "High", "Critical"), (5, "Medium", "High"),
                                          (3, "Low", "Medium"), (1, "Info", "Low")])
def test_labels(spark, sev, ui, alert):
    r = spark.range(1).select(S.ui_severity_label(F.lit(sev)).alias("u"), S.alert_severity_label(F.lit(sev)).alias("a")).first()
    assert (r.u, r.a) == (ui, alert)
