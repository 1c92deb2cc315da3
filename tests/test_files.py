"""Log files of any size: lines by byte ranges, decoding per file, numbering."""

import pytest
from pyspark.sql import functions as F

from logweave.functions.parse import split_lines
from logweave.sources import files


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(folder, name, data):
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def test_one_file_is_many_tasks_and_lines_are_whole(spark, folder):
    texts = {"big.log": "\n \n\t\n" + "\n".join(f"line {i} {'x' * (i % 90)} é漢" * (i % 3 > 0) for i in range(20000)) + "\n\n  ",
             "small.log": "one\r\n\n two \nthree", "gap.log": "\n" * 5000 + "a\n\nb\n"}
    for name, t in texts.items():
        put(folder, name, t.encode())
    put(folder, "empty.log", b"")
    put(folder, "blank.log", b" \n\t\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        f = files.LogFiles(spark, folder)
        assert f.ranges().groupBy("path").count().agg(F.max("count")).first()[0] > 20
        got = {}
        for r in f.lines().collect():
            got.setdefault(r.file_name, []).append((r.line_no, r.line))
        facts = {r.file_name: r for r in f.facts().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = spark.createDataFrame(list(texts.items()), "name string, content string")
    want = {}
    for r in split_lines(whole, id_col="name").collect():  # the rule on the text as a whole
        want.setdefault(r.raw_log_id, []).append((r.line_no, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert facts["empty.log"].size_bytes == 0 and facts["empty.log"].magic is None
    assert {r.file_name: r.line_count for r in files.inventory(f.files, f.lines()).collect()} == {
        **{k: len(v) for k, v in want.items()}, "empty.log": 0, "blank.log": 0}


def test_a_file_is_latin_1_as_a_whole_where_one_line_is_not_utf_8(spark, folder):
    put(folder, "mixed.log", "good é\n".encode() + b"bad \xe9\xff\n" + b"\xa0\n" + "end ü\n".encode())
    put(folder, "fine.log", "good é\nend 漢\n".encode())
    put(folder, "cut.log", b"ok\nhalf \xc3\nA\n")  # a character is never completed over a line end
    f = files.LogFiles(spark, folder)
    got = {}
    for r in f.lines().orderBy("file_name", "line_no").collect():
        got.setdefault(r.file_name, []).append((r.line_no, r.line))
    assert got["mixed.log"] == [(1, "good Ã©"), (2, "bad éÿ"), (4, "end Ã¼")]
    assert got["fine.log"] == [(1, "good é"), (2, "end 漢")]
    assert got["cut.log"] == [(1, "ok"), (2, "half Ã"), (3, "A")]
    assert {r.file_name: r.utf8 for r in f.facts().collect()} == {"mixed.log": False, "fine.log": True, "cut.log": False}


def test_admission_reads_the_first_bytes(spark, folder):
    for name, data in {"a.log": b"plain", "b.log": b"PK\x03\x04rest\nmore", "c.txt": b"MZ", "d.exe": b"x", "e.log": b"",
                       "f.bin": b"x", "g": b"x", "h.json": b"\n\x1f\x8b\x08", "i.OUT": b"BZh9"}.items():
        put(folder, name, data)
    got = {r.file_name: r.reason for r in files.admission(files.LogFiles(spark, folder).facts()).collect()}
    binary, unknown = "Binary or compressed files are not allowed", "File type not supported"
    assert got == {"a.log": None, "b.log": binary, "c.txt": binary, "d.exe": "File type not allowed: .exe",
                   "e.log": "File is empty", "f.bin": unknown, "g": unknown, "h.json": None, "i.OUT": binary}
    limited = files.admission(files.LogFiles(spark, folder).facts(), 4).where("file_name = 'a.log'").first()
    assert limited.reason == "File too large (maximum 10MB)"
