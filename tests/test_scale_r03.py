"""Work spread over tasks whatever the files look like (findings of round 3)."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions import sanitize as T
from logweave.functions.categorize import category_of
from logweave.functions.parse import parse_lines
from logweave.operators import detect as D
from logweave.operators import stats as S
from logweave.operators import status as ST
from logweave.operators.throttle import throttle
from logweave.plans import store
from logweave.sources import files as FS
from logweave.streaming import pipeline as SP
from logweave.streaming import side
from logweave.streaming import throttled as TS


def test_events_of_one_row_group_are_spread(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(store, "ROWS_PER_TASK", 50)
    spread = store.spread_events(spark, str(tmp_path))
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 40 and max(sizes) < 500
    days = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct(F.to_date("ts")).alias("n"))
    assert days.agg(F.max("n")).first()[0] <= 2


def test_category_scores_against_plain_python(spark):
    rnd = random.Random(3)
    words = sorted({k for ks in R.CATEGORY_KEYWORDS.values() for k in ks}) + ["of", "the", "sussudo", "Üser", "ip_ip", "[0]", ":", ""]
    rows = [("".join(rnd.choice(words) + rnd.choice(["", " ", "-", "X"]) for _ in range(rnd.randint(0, 6))),
             rnd.choice(words) + rnd.choice(["", "[0]"])) for _ in range(300)]

    def plain(message, source):
        src = source.lower()
        text = message.lower() + " " + src
        if "kernel" in src and "[0]" in src:
            return "kernel"
        score = {c: sum(text.count(k) + (2 if re.search(rf"\b{k}\b", text) else 0) + (3 if k in src else 0) for k in ks)
                 for c, ks in R.CATEGORY_KEYWORDS.items()}
        best = max(score.values())
        return next(c for c in score if score[c] == best) if best else "unknown"

    df = spark.createDataFrame([*rows, (None, "sshd")], "m string, s string")
    got = df.select("m", "s", category_of(F.col("m"), F.col("s")).alias("c"))
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        assert r["c"] == ("unknown" if r["m"] is None else plain(r["m"], r["s"])), r


def test_equal_sources_are_compared_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ST, "broadcast_if_small", lambda df, *a: seen.append(df.count()) or df)
    src = spark.createDataFrame(
        [("a", "directory", "/logs/b/", "*.log")] * 50 + [("b", "directory", "/logs", None), ("c", "file", "/logs/b/x.log", None),
         ("a", "file", "/logs/b/x.log", None), (None, "directory", "/logs/b/x.log", ""), ("d", "file", "/logs/b", None),
         ("e", None, "/logs", None)], "source_name string, source_type string, path string, file_pattern string")
    files = spark.createDataFrame([("/logs/b/x.log",), ("/logs/b/x.log",), ("/logs/b/y.txt",), ("z",), (None,)], "path string")
    got = sorted((r["path"], r["source_name"] or "") for r in ST.match_sources(files, src).collect())
    assert got == [("/logs/b/x.log", ""), ("/logs/b/x.log", "a"), ("/logs/b/x.log", "b"), ("/logs/b/x.log", "c"), ("/logs/b/y.txt", "b")]
    assert sum(seen) == 6


def test_document_files_have_a_task_each(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(-3, 61)] + [(None, "n")], "doc_id bigint, text string")
    tasks = FS.in_buckets(docs).groupBy(F.spark_partition_id().alias("p")).agg(
        F.countDistinct(F.pmod("bucket", F.lit(8))).alias("b"), F.count("*").alias("n")).collect()
    assert len(tasks) == 8 and {t["b"] for t in tasks} == {1} and sum(t["n"] for t in tasks) == 65


def test_replay_has_no_more_batches_for_more_files(spark, tmp_path):
    for n in (3, 40):
        spark.range(n).select(F.col("id").alias("event_id")).repartitionByRange(n, "event_id").write.parquet(f"{tmp_path}/{n}")
    assert SP.files_a_batch(spark, f"{tmp_path}/3") == 2
    assert -(-40 // SP.files_a_batch(spark, f"{tmp_path}/40")) <= SP.REPLAY_BATCHES


def test_points_of_a_sliding_count_carry_no_rows(spark, monkeypatch):
    seen, cut = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: seen.append(df) or cut(df))
    rows = [("a", 10, "x"), ("a", 10, "x"), ("a", 300, None), ("b", None, "y"), (None, 5, "z"), (None, 6, "z")]
    df = spark.createDataFrame(rows, "k string, s int, wide string").withColumn("ts", F.timestamp_seconds("s"))
    got = D.sliding_count(df, ["k"], "ts", 60, name="n")
    assert "_row" not in str(seen[1].schema) and "_prow" not in seen[1].columns
    assert sorted(((r.k, r.s, r.wide, r.n) for r in got.collect()), key=str) == sorted(
        [("a", 10, "x", 2), ("a", 10, "x", 2), ("a", 300, None, 1), ("b", None, "y", None), (None, 5, "z", 1), (None, 6, "z", 2)], key=str)


def test_arrivals_are_staged_by_many_tasks_and_a_batch_is_a_part(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("i"), F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.lit(600).alias("g"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 40).cast("timestamp_ntz").alias("at"))
    monkeypatch.setattr(TS, "ROWS_PER_FILE", 100)
    root = side.stream_root(spark, "arrivals")
    folder, files = TS.stage_disordered(rows, f"{root}/in", "at")
    assert files >= 7 and TS.stage_disordered(rows, f"{root}/in", "at") == (folder, files)
    assert all(TS._data_files(spark, f"{folder}/part{k}") == files for k in range(4))
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder))
    TS.run(TS.throttled(stream, key="k", ts="at", id_col="i", seconds="g", delay="3 hours"), root)
    got = TS.decided_so_far(spark, root)
    assert got.count() == 3000
    sent = {r["i"] for r in throttle(rows, "k", "at", "i", "g", unit_seconds=1).collect()}
    assert {r["id"] for r in got.where("sent").collect()} == sent


def test_a_part_with_few_rows_has_as_many_files(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), 1_704_067_200 + (0 if i < 40 else 900_000)) for i in range(41)], "i string, s long").select(
        "i", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"))
    monkeypatch.setattr(TS, "ROWS_PER_FILE", 8)
    folder, files = TS.stage_disordered(rows, f"{side.stream_root(spark, 'few')}/in", "at")
    assert files == 5 and all(TS._data_files(spark, f"{folder}/part{k}") == 5 for k in range(4))
    assert spark.read.option("recursiveFileLookup", "true").parquet(folder).count() == 41


def test_waiting_alerts_are_decided_in_one_pass(spark, monkeypatch):
    n = 5000
    alerts = [(1_000_000 * i, f"a{i:05d}", 3_000_000) for i in range(n)]
    state = spark.createDataFrame([(None, *map(list, zip(*reversed(alerts), strict=True))), (n * 1_000_000, [5], ["late"], [1]), (7, [], [], [])], TS.STATE)
    root = side.stream_root(spark, "waiting")
    spark.createDataFrame([("done", 1, True)], TS.OUT).write.parquet(f"{root}/decisions")
    monkeypatch.setattr(TS, "waiting", lambda *_: state)
    out = TS.decided_so_far(spark, root)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["sent"] for r in out.collect()}
    assert len(got) == n + 2 and got["done"] and not got["late"]
    assert all(got[i] == (int(i[1:]) % 3 == 0) for _, i, _ in alerts)


def test_coverage_broadcasts_neither_side(spark):
    ev = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "id string")
    an = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("z",)], "event_id string")
    got = S.coverage(ev, an)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(got.first()) == (6, 4, 66.666667)


def test_gated_patterns_against_plain_search(spark):
    rnd = random.Random(5)
    bits = ["union  select", "DROP table", "or 1=1", "AND 1 = 1", "<SCRIPT", "javascript:", "onload =", "alert (", "PROMPT(", "../", "..\\",
            "etc/passwd", "ETC\\passwd", "windows\\System32", "| x", "&& y", "& y", ";z", ";", "curl ", "NC ", "%2F", "%2", "\\x4a", "\\x", "x", " ", "=",
            "..", "(", "ok", "etc", ":", "/"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 3))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.entry_verdict(F.col("t")).alias("v"))
    for r in df.collect():
        assert r["v"] == ("suspicious" if any(re.search(p, r["t"], re.ASCII) for p in T.SUSPICIOUS_PATTERNS) else "valid"), r


def test_texts_without_a_patterns_literals_need_no_regex():
    for i, needs in T.SUSPICIOUS_NEEDS.items():
        rnd, chars = random.Random(i), "ORonscriptaleETC1 \t=<:(./\\|&;%"
        for _ in range(3000):
            text = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 9)))
            assert not re.search(T.SUSPICIOUS_PATTERNS[i], text) or any(x in text for x in needs)
    assert len(T.SUSPICIOUS_NEEDS) == 8


def test_fallback_times_found_anywhere(spark):
    lines = ["x 2024-01-05 01:02:03 app: hi", "x 01/05/2024 01:02:03 app: hi", "on Jan 5 01:02:03 it", "x 2024-13-05 01:02:03 01/06/2024 04:05:06 y",
             "no time - here / at all", "12:00 only", "x 2024-01-05 010203 y"]
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    got = {r["line"]: (r["pattern"], r["event_ts"]) for r in parse_lines(df).collect()}
    at = lambda d, h, m, s: dt.datetime(2024, 1, d, h, m, s)
    assert [got[t][0] for t in lines] == ["fallback_ts"] * 4 + ["fallback_now"] * 3
    assert [got[t][1] for t in lines[:4]] == [at(5, 1, 2, 3), at(5, 1, 2, 3), at(5, 1, 2, 3), at(6, 4, 5, 6)]
    assert "contains(line" in df.transform(parse_lines)._jdf.queryExecution().optimizedPlan().toString().lower()
