"""Tail growing log files as a stream (T-01): a Python Data Source.

``spark.readStream.format("logtail").option("path", "<glob>")`` yields one
row per line appended since the last micro-batch: ``(path, file_offset,
content)``. The offset is a JSON map file -> byte position after the last whole
line and a checksum of the file's first bytes. A last line without its line end
is held back until it is whole (``flushPartial`` = ``true`` takes it as it is);
a file that shrank or whose first bytes changed (rotation, also when the new
file has grown past the old position) is read again from its start, a new file
from 0, and ``startingPosition`` = ``latest`` (default) skips what the files
hold when the query starts. Blank lines are skipped; lines stay whole unless
``maxLineLength`` sets a limit, then longer ones are cut and marked.

Ranges over ``maxRangeBytes`` (64 MB) are split: a part takes the lines that
start in it, read one by one, so memory is bounded by the longest line. Paths
are local or ``file:`` paths visible to the executors (a shared mount); others
are refused. Spark's own file source cannot do this: it reads a file once and
never sees what is appended to it.
"""

from __future__ import annotations

import glob
import os
import zlib

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TRUNCATED = "... [truncated]"
HEAD = 256
BLOCK = 1 << 16
RANGE = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def _whole_lines(path: str, size: int) -> int:
    """Position after the last line end in the first ``size`` bytes."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            start = max(0, at - BLOCK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def _head(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.pattern:
            raise ValueError(f"logtail reads local or file: paths, not {options['path']}")
        self.start_at = options.get("startingPosition", "latest")
        self.max_line = int(options["maxLineLength"]) if "maxLineLength" in options else None
        self.partial = options.get("flushPartial", "false").lower() == "true"
        self.range = int(options.get("maxRangeBytes", RANGE))

    def _ends(self) -> dict:
        found = {}
        for p in sorted(glob.glob(self.pattern, recursive=True)):
            if os.path.isfile(p):
                size = os.path.getsize(p)
                end = size if self.partial else _whole_lines(p, size)
                n = min(HEAD, end)
                found[p] = {"pos": end, "n": n, "head": _head(p, n)}
        return found

    def initialOffset(self) -> dict:
        ends = self._ends()
        if self.start_at != "latest":
            ends = {p: {"pos": 0, "n": 0, "head": 0} for p in ends}
        return {"files": ends}

    def latestOffset(self) -> dict:
        return {"files": self._ends()}

    def partitions(self, start: dict, end: dict):
        before = start.get("files", {})
        parts = []
        for path, now in end["files"].items():
            was = before.get(path, {"pos": 0, "n": 0, "head": 0})
            stop = now["pos"]
            begin = was["pos"]
            if stop < begin or _head(path, was["n"]) != was["head"] and was["n"]:  # rotated or truncated
                begin = 0
            cuts = list(range(begin, stop, self.range)) + [stop]
            parts += [_Range(path, a, b, a == begin) for a, b in zip(cuts, cuts[1:])]
        return parts

    def read(self, part: _Range):
        with open(part.path, "rb") as f:
            at = part.start
            if not part.first:  # a line that started before belongs to the part before
                f.seek(part.start - 1)
                at = part.start - 1 + len(f.readline())
            f.seek(at)
            while at < part.end:
                raw = f.readline()
                if not raw:
                    break
                here, at = at, at + len(raw)
                text = raw.decode("utf-8", errors="ignore")
                if not text.strip():
                    continue
                if self.max_line is not None and len(text) > self.max_line:
                    text = text[: self.max_line] + TRUNCATED
                yield (part.path, here, text.strip())

    def commit(self, end: dict) -> None:
        pass


class LogTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "path string, file_offset long, content string"

    def streamReader(self, schema):
        return _TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LogTailSource)
