"""Pluggable scorer: reply repair and rule fallback."""

from pyspark.sql import functions as F

from logweave.operators.scoring import method_counts, repair_replies, score_events_with, score_in_batches


REPLIES = {
    '{"security_log_event": {"severity_score": 9, "explanation": "long enough text", "recommendations": ["a1b2c"]}}':
        (9, "long enough text", ["a1b2c", "Monitor for similar events"]),
    '{"x": {"severity_score": 42}}': (5, "No explanation provided", ["Review manually", "Monitor for similar events"]),
    '{"severity_score": "7", "explanation": "short", "recommendations": []}':
        (5, "AI analysis completed for system event", ["Review this event manually", "Monitor for similar events"]),
    '{"severity_score": true, "explanation": null, "recommendations": {"a": 1}}':
        (5, "AI analysis completed for system event", ["Review this event manually", "Monitor for similar events"]),
    '{"severity_score": 7.0, "explanation": "  ten letters and more ", "recommendations": ["a", " ", 3]}':
        (None, "ten letters and more", ["a", "3"]),
    '{"other": 1, "security_log_event": 5}': None,
    "{}": (1, "No explanation provided", ["Review manually", "Monitor for similar events"]),
    '{"a": 1}': (1, "No explanation provided", ["Review manually", "Monitor for similar events"]),
    "not json": None, "[1, 2]": None, "7": None, "": None, '{"severity_score": ': None,
}


def test_repair_replies(spark):
    rows = [*REPLIES, None]
    df = spark.createDataFrame([(r,) for r in rows], "reply string")
    got = {r.reply: r.f for r in df.select("reply", repair_replies(F.col("reply"), F.lit("system")).alias("f")).collect()}
    assert got[None] is None
    for reply, want in REPLIES.items():
        if want is None:
            assert got[reply] is None, reply
        else:
            assert (got[reply].explanation, got[reply].recommendations) == want[1:], reply
            assert want[0] is None or got[reply].severity_score == want[0], reply


def test_batch_scorer_that_raises_or_answers_short(spark):
    df = spark.createDataFrame([(f"e{i}", "Failed password", "h:sshd[1]", "auth") for i in range(20)],
                               "id string, message string, source string, category string").repartition(4)
    fields = ("id", "message", "source", "category")

    def broken(rows):
        raise RuntimeError("down")
    for scorer in (broken, lambda rows: ["{}"]):
        got = score_in_batches(df, scorer, fields)
        assert got.count() == 20 and {r.analysis_method for r in got.collect() if scorer is broken} <= {"rules"}
    good = score_in_batches(df, lambda rows: '{"severity_score": ' + rows["id"].str[1:] + "}", fields).collect()
    assert {(r.id, r.severity_score) for r in good} == {(f"e{i}", i if 1 <= i <= 10 else 5) for i in range(20)}


def test_scorer_with_fallback(spark):
    df = spark.createDataFrame(
        [("e1", "Failed password for root", "h:sshd[1]", "auth"), ("e2", "Malware attack", "h:securityd[2]", "security"),
         ("e3", "kernel panic", "h:kernel[0]", "kernel")], "id string, message string, source string, category string")

    def scorer(ev):
        if ev["id"] == "e1":
            return {"severity_score": 3, "explanation": "scored by the plug-in", "recommendations": ["Check it", "Log it"]}
        if ev["id"] == "e2":
            raise RuntimeError("scorer down")
        return None

    out = {r.id: r for r in score_events_with(df, scorer, fields=("id", "message", "source", "category")).collect()}
    assert (out["e1"].severity_score, out["e1"].analysis_method) == (3, "scorer")
    assert out["e1"].recommendations == ["Check it", "Log it"]
    assert (out["e2"].severity_score, out["e2"].analysis_method) == (10, "rules")
    assert (out["e3"].severity_score, out["e3"].analysis_method) == (8, "rules")
    counts = {r.analysis_method: r.n for r in method_counts(score_events_with(df, scorer, fields=("id", "message", "source", "category"))).collect()}
    assert counts == {"scorer": 1, "rules": 2}
