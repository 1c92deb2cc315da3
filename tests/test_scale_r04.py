"""Fourth round: the stream throttle keeps its state in a table, decides many
keys in one pass and any number of alerts of a key in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.plans import store
from logweave.streaming import side
from logweave.streaming import throttled as TS

SCHEMA = "k string, i string, s double, g int"
T0 = 1_704_067_200


def plain(rows):
    """Ids in the order they are decided and whether each was sent."""
    until, out = {}, []
    for k, i, s, g in sorted(rows, key=lambda r: (r[2] if r[2] is not None else 0, r[1], r[3] or 0)):
        free = s is None or (g or 0) <= 0
        sent = free or k not in until or s >= until[k]
        if sent and not free:
            until[k] = s + g
        out.append((i, sent))
    return sorted(out)


def write(spark, folder, name, rows):
    spark.createDataFrame([(k, i, None if s is None else T0 + s, g) for k, i, s, g in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, root, delay="1 hour"):
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
              .withColumn("at", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))))
    TS.run(TS.throttled(stream, key="k", ts="at", id_col="i", seconds="g", delay=delay), root)
    return sorted((r.id, r.sent) for r in TS.decided_so_far(spark, root).collect())


def some(n, keys, seed, span=20_000):
    rnd = random.Random(seed)
    gap = {k: rnd.choice([0, 60, 300, 600, None]) for k in keys}
    rows = [(k, f"i{j}", rnd.randrange(span * 4) / 4, gap[k]) for j, k in enumerate(rnd.choices(keys, k=n))]
    return sorted(rows, key=lambda r: r[2] + rnd.random() * 3600)  # up to an hour late


@pytest.fixture
def small(spark, monkeypatch):
    """Arrow batches of 7 rows, tasks of 50 rows and 3 keys held."""
    monkeypatch.setattr(TS, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(TS, "KEYS_HELD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_keys_repeats_nulls_and_a_hot_key(spark, small):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "many")
    rows = some(900, [None, *["hot"] * 200, *[f"k{j}" for j in range(150)]], seed=3)
    rows += [rows[-1], (None, "n1", rows[-1][2], 60), ("hot", "n2", None, 300)]  # twice, no key, no time
    for j in range(0, len(rows), 350):
        write(spark, folder, f"p{j}", rows[j:j + 350])
    assert run(spark, folder, root) == plain(rows)


def test_tasks_follow_the_rows_and_not_the_keys(spark, monkeypatch):
    alerts = spark.createDataFrame([(f"k{j}", f"i{j}", j, 60, None) for j in range(500)], "key string, id string, at long, gap long, until long")
    assert TS._decided(alerts, None, 500).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(TS, "ROWS_PER_TASK", 20)
    assert TS._decided(alerts, None, 500).rdd.getNumPartitions() == 25


def test_alerts_that_wait_are_rows_of_a_table(spark, small):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "wait")
    rows = [("hot", f"i{j:03d}", float(j * 30), 600) for j in range(300)]  # 2.5 hours, none passed by the watermark
    for j in range(0, 300, 75):
        write(spark, folder, f"p{j}", rows[j:j + 75])
    assert run(spark, folder, root, delay="3 hours") == plain(rows)
    assert not store._exists(spark, f"{root}/_checkpoint/state")  # no key's alerts are one value of a state store
    kept = spark.read.parquet(f"{root}/batches").groupBy("batch", "kind").count().collect()
    assert {(r.batch, r["count"]) for r in kept if r.kind == "waiting"} == {(2, 225), (3, 300)}  # older state is dropped


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark):
    folder, root = side.stream_root(spark, "in"), side.stream_root(spark, "again")
    rows = some(300, ["a", "b", "c"], seed=8)
    for j in range(0, 300, 100):
        write(spark, folder, f"p{j}", rows[j:j + 100])
    first = run(spark, folder, root)
    for name in ("2", ".2.crc"):  # as if the run had ended before the last batch was committed
        fs, p = store._fs(spark, f"{root}/_checkpoint/commits/{name}")
        fs.delete(p, True)
    assert run(spark, folder, root) == first == plain(rows)
