"""Regression tests: rule and filter matching, store key, file size limit."""

from pyspark.sql import functions as F

from logweave.operators import alerts, throttle
from logweave.plans import store
from logweave.sources import files


def test_repeated_category_matches_once(spark):
    rule = spark.createDataFrame([(["auth", "auth"],)], "categories array<string>")
    assert alerts.by_category(rule).count() == 1


def test_open_filter_takes_updates_without_a_known_category(spark):
    updates = spark.createDataFrame([("a", None, "s", "t", 5), ("b", "odd", "s", "t", 5), ("c", "auth", "s", "t", 5)],
                                    "id string, category string, source string, event_type string, priority int")
    filters = spark.createDataFrame([("all", [], None, None, [], []), ("odd", [], None, None, ["odd", "odd"], [])],
                                    alerts.CLIENT_FILTER_SCHEMA)
    got = sorted((r.id, r.client_id) for r in alerts.client_fanout(updates, filters).collect())
    assert got == [("a", "all"), ("b", "all"), ("b", "odd"), ("c", "all")]


def test_store_key_follows_the_data(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.range(10).write.parquet(path)
    one = store._root(spark, str(tmp_path), "x")
    spark.range(1000).write.mode("overwrite").parquet(path)
    assert store._root(spark, str(tmp_path), "x") != one


def test_size_limit_is_off_by_default(spark):
    row = spark.createDataFrame([("a.log", 50_000_000, "00000000")], "file_name string, size_bytes long, magic string")
    assert files.admission(row).first().is_valid
    assert not files.admission(row, files.MAX_FILE_BYTES).first().is_valid


def test_next_allowed_on_one_dense_key(spark):
    n = 30_000
    events = spark.range(n).select(F.lit("k").alias("k"), F.format_string("%06d", "id").alias("id"), F.timestamp_micros(
        F.col("id") * 1000).alias("ts"), F.lit(1).alias("m"))
    got = {r.id: r.nxt for r in throttle.next_allowed(events.limit(n), "k", "ts", "id", "m").collect()}
    assert len(got) == n and all(v is None for v in got.values())
