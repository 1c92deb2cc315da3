"""Tail source: appended lines, blank lines, rotation."""

import os
import tempfile

import pytest

from logweave.sources import tail


def test_tail_appends_and_rotation(spark):
    tail.register(spark)
    d = tempfile.mkdtemp(prefix="logweave-tail-")
    path = os.path.join(d, "a.log")
    with open(path, "w") as f:
        f.write("old line\n")
    out = tempfile.mkdtemp(prefix="logweave-tail-out-")
    df = spark.readStream.format("logtail").option("path", os.path.join(d, "*.log")).load()  # starts at the end
    q = (df.writeStream.format("memory").queryName("tail_t").trigger(processingTime="200 milliseconds")
         .option("checkpointLocation", out).start())
    try:
        q.processAllAvailable()
        with open(path, "a") as f:
            f.write("first\n\n   \nsecond\n")
        q.processAllAvailable()
        with open(path, "w") as f:  # rotation: the file shrinks
            f.write("new\n")
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.sql("SELECT file_offset, content FROM tail_t ORDER BY content").collect()
    assert [(r.content, r.file_offset) for r in rows] == [("first", 9), ("new", 0), ("second", 20)]


def _read(reader, start):
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    return end, [(at, text) for _, at, text in rows]


def test_partial_lines_rotation_and_ranges(tmp_path):
    f = tmp_path / "a.log"
    f.write_bytes(b"one\ntwo")
    reader = tail._TailReader({"path": f"file:{tmp_path}/*.log", "startingPosition": "earliest"})
    at, rows = _read(reader, reader.initialOffset())
    assert rows == [(0, "one")]  # the unfinished line waits
    f.write_bytes(b"one\ntwo more\n")
    at, rows = _read(reader, at)
    assert rows == [(4, "two more")]
    f.write_bytes(b"another file that is longer than the first\n")  # rotated and grown past the old position
    at, rows = _read(reader, at)
    assert rows == [(0, "another file that is longer than the first")]
    assert _read(reader, at)[1] == []
    long = "x" * 20000
    f.write_text("\n".join([*(f"line {i}" for i in range(200)), long]) + "\n")
    small = tail._TailReader({"path": f"{tmp_path}/*.log", "startingPosition": "earliest", "maxRangeBytes": "37"})
    assert [t for _, t in _read(small, small.initialOffset())[1]] == [f"line {i}" for i in range(200)] + [long]
    with pytest.raises(ValueError):
        tail._TailReader({"path": "hdfs://host/logs/*.log"})
