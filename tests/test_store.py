"""Stored tables: joins without a shuffle, paging by position, re-analysis of
touched days."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logweave.operators import events as E
from logweave.operators.reanalysis import reanalyse
from logweave.plans import store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_by_id_has_no_exchange(spark):
    ev, an = store.by_id(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(E.with_analysis(ev, an))
        point = plan(E.event_detail(ev, an, "rl_5:5"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in joined and "SortMergeJoin" in joined
    assert "SelectedBucketsCount: 1 out of" in point
    assert ev.count() == store.events(spark, SF).count() and an.count() == store.analysis(spark, SF).count()


@pytest.mark.parametrize("order", ["desc", "asc"])
@pytest.mark.parametrize("sort_by", ["timestamp", "severity"])
def test_pages_by_position_are_all_rows_once_in_order(spark, sort_by, order):
    view = E.with_analysis(store.events(spark, SF), store.analysis(spark, SF)).where("event_id < 260").cache()
    want = [r.id for r in E.sort_events(view, sort_by, order).select("id").collect()]
    got, last = [], None
    while True:
        rows = E.page_after(view, 100, last, sort_by=sort_by, order=order)
        now = E.last_position(rows, sort_by)
        if now is None:
            break
        got += [r.id for r in rows.select("id").collect()]
        last = now
    assert got == want


def test_a_late_page_reads_as_few_days_as_the_first(spark):
    ev = store.events(spark, SF)
    days = store.day_counts(spark, SF)
    assert sum(days.values()) == ev.count()
    cursor = (dt.datetime(2024, 1, 9, 12), "rl_0:0")
    page = E.page_after(ev, 20, cursor, days=days)
    assert "event_date" in plan(page).split("PartitionFilters: ")[1].split("]")[0]
    bounds = plan(page).split("PartitionFilters: ")[1]
    assert ">=" in bounds and "<=" in bounds and len({r.event_date for r in page.collect()}) <= 2
    want = E.sort_events(ev.where(F.col("timestamp") < F.lit(cursor[0]).cast("timestamp_ntz"))).limit(20)
    assert [r.id for r in page.collect()] == [r.id for r in want.collect()]
    assert E.page_after(ev, 20, (dt.datetime(2023, 1, 1), "x"), days=days).count() == 0


def test_reanalysis_changes_scores_and_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "analysis")
    ev = store.events(spark, SF)
    an = store.analysis(spark, SF).join(ev.select(F.col("id").alias("event_id"), "event_date"), "event_id")
    an.write.partitionBy("event_date").parquet(path)
    files = {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = {r.event_id: (r.severity_score, r.analyzed_at) for r in spark.read.parquet(path).collect()}
    day = sorted({r.event_date for r in ev.select("event_date").distinct().collect()})[3]
    ids = ev.where((F.col("event_date") == day) & F.col("category").isin("system", "application", "kernel")).select("id")
    asked = {r.id for r in ids.collect()}
    at = dt.datetime(2024, 3, 1)
    found = reanalyse(spark, path, ev.withColumn("category", F.lit("security")),
                      ids.unionByName(spark.createDataFrame([("none",)], "id string")), at)
    assert {r.id: r.found for r in found.collect()} == {**{i: True for i in asked}, "none": False}
    spark.catalog.clearCache()
    after = {r.event_id: (r.severity_score, r.analyzed_at) for r in spark.read.parquet(path).collect()}
    assert set(after) == set(before) | asked
    assert all(after[i][1] == at for i in asked) and any(after[i][0] != before[i][0] for i in asked & set(before))
    assert all(after[i] == before[i] for i in set(before) - asked)
    for f, m in files.items():
        if f"event_date={day}" not in f:
            assert os.stat(f).st_mtime_ns == m
