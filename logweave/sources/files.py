"""Log files: admission (S-04), lines of files of any size with the file's
decoding (S-01), labels from the path (S-05), inventory (S-06).

``stage_document_files`` writes the driver's ``documents`` as text log files
(one folder per ``bucket = doc_id % 8``, documents in id order) into the
shared checkpoint folder once; it is the stand-in for a folder of uploaded
logs and does none of the jobs' work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.functions.parse import strip
from logweave.session import broadcast_if_small
from logweave.sources.tables import read_table

N_BUCKETS = 8
RANGES_BROADCAST = 1_000_000
NOT_BLANK = r"(?U)\S"

# FIXED VALUES: upload admission
MAX_FILE_BYTES = 10 * 1024 * 1024
DANGEROUS_EXTENSIONS = [
    ".exe", ".bat", ".cmd", ".com", ".scr", ".pif", ".vbs", ".js", ".jar",
    ".msi", ".deb", ".rpm", ".dmg", ".app", ".ps1", ".sh", ".php", ".asp",
    ".aspx", ".jsp", ".py", ".rb", ".pl", ".cgi",
]
ALLOWED_EXTENSIONS = [".log", ".txt", ".out", ".csv", ".json"]
DANGEROUS_SIGNATURES = ["4d5a", "7f454c46", "cafebabe", "504b0304", "1f8b08", "425a68"]


def in_buckets(docs: DataFrame) -> DataFrame:
    """Documents with their ``bucket``, one task a bucket (hashed, several
    buckets would meet in one task), in id order."""
    return (docs.withColumn("bucket", (F.col("doc_id") % N_BUCKETS).cast("int"))
            .repartitionById(N_BUCKETS, F.coalesce(F.pmod("bucket", F.lit(N_BUCKETS)), F.lit(0)))
            .sortWithinPartitions("bucket", "doc_id"))


def stage_document_files(spark: SparkSession, sf_dir: str) -> str:
    from logweave.plans import store

    root = store._root(spark, sf_dir, "files") + "/document-files"
    if not store._exists(spark, f"{root}/_SUCCESS"):
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
        in_buckets(docs).select("bucket", "text").write.mode("overwrite").partitionBy("bucket").text(root)
    return root


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """One row per file: path, name, bytes, label from the ``bucket=`` folder;
    no content is read. Empty files, which a scan passes over, come from the
    driver's file listing (one path a file, as the scan itself holds it)."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root))
    sizes = raw.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"))
    # the listing writes local paths with three slashes
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", p),) for p in raw.inputFiles()], "path string")
    path = F.col("path")
    return listed.join(sizes, "path", "left").select(
        path, F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.regexp_extract(path, r"bucket=(\d+)", 1).try_cast("int").alias("bucket"))


class LogFiles:
    """The log files below ``root`` as lines (S-01, S-05): byte ranges of a
    file are read by tasks of their own, and a line belongs to the range it
    starts in.

    A first pass over the ranges decides for each file whether all its lines
    are UTF-8 (a line end is never inside a character, so the file is valid
    where its lines are); the others are Latin-1 as a whole. The same pass
    counts lines, so that a second one can number them over all ranges. Its
    result has one row per range and is broadcast up to ``RANGES_BROADCAST``.
    """

    def __init__(self, spark: SparkSession, root: str, glob: str = "*"):
        self.files = list_files(spark, root, glob)
        text = (spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
                .text(root))
        self._raw = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
                                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 31) - 1)).alias("_row"), "value")

    def ranges(self) -> DataFrame:
        """Per range: its first row with the first four bytes (one long, so
        that the aggregate stays a hash aggregate), lines, whether all are
        UTF-8, first row that isn't blank under either decoding."""
        data = F.col("value").cast("binary")
        head = F.conv(F.rpad(F.hex(F.substring(data, 1, 4)), 8, "0"), 16, 10).cast("long")
        first = F.shiftleft("_row", 32).bitwiseOR(F.when(F.col("_block") == 0, head).otherwise(0))
        return self._raw.groupBy("path", "_block").agg(
            F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n"),
            F.min(F.is_valid_utf8("value")).alias("_utf8"),
            F.min(F.when(F.col("value").rlike(NOT_BLANK), F.col("_row"))).alias("_text_u"),
            F.min(F.when(F.decode(data, "ISO-8859-1").rlike(NOT_BLANK), F.col("_row"))).alias("_text_l"))

    def _placed(self) -> DataFrame:
        """Ranges with their file's decoding, lines before them, and the place
        of the file's first line that isn't blank."""
        of, ordered = Window.partitionBy("path"), Window.partitionBy("path").orderBy("_block")
        row = F.shiftright("_first", 32)
        r = self.ranges().withColumn("_utf8", F.min("_utf8").over(of)).withColumn(
            "_before", F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        text = F.when(F.col("_utf8"), F.col("_text_u")).otherwise(F.col("_text_l"))
        return (r.withColumn("_begin", F.min(F.col("_before") + text - row).over(of))
                .select("path", "_block", "_utf8", "_begin", (F.col("_before") - row).alias("_shift"), "_first"))

    def facts(self) -> DataFrame:
        """The files with ``magic`` (hex of the first bytes) and ``utf8``."""
        head = self.ranges().groupBy("path").agg(
            F.min("_utf8").alias("utf8"),
            F.max(F.when(F.col("_block") == 0, F.col("_first").bitwiseAND(F.lit((1 << 32) - 1)))).alias("_magic"))
        return self.files.join(head, "path", "left").withColumn("magic", F.lower(F.lpad(F.hex("_magic"), 8, "0"))).drop("_magic")

    def lines(self, files: DataFrame | None = None) -> DataFrame:
        """(path, file_name, bucket, size_bytes, line_no, line) of the stripped
        lines that aren't blank; numbers count all lines from the first of
        these on. ``files`` limits to some of the files."""
        placed = broadcast_if_small(self._placed(), RANGES_BROADCAST)
        text = F.when(F.col("_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
        out = self._raw.join(placed, ["path", "_block"]).select(
            "path", (F.col("_row") + F.col("_shift") - F.col("_begin") + 1).cast("int").alias("line_no"), strip(text).alias("line"))
        names = (self.files if files is None else files).select("path", "file_name", "bucket", "size_bytes")
        return out.where(F.col("line") != "").join(broadcast_if_small(names), "path").select(
            "path", "file_name", "bucket", "size_bytes", "line_no", "line")


def _ext(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise(F.lit(""))


def admission(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """S-04: size (only where ``max_bytes`` sets a limit), emptiness, extension deny/allow lists and executable or
    archive signatures (first bytes), in this order -> (is_valid, reason)."""
    ext = _ext(F.col("file_name"))
    sig = F.lit(False)
    for s in DANGEROUS_SIGNATURES:
        sig = sig | F.coalesce(F.lower(F.col("magic")).startswith(s), F.lit(False))
    reason = (F.when(F.col("size_bytes") > F.lit(max_bytes), F.lit("File too large (maximum 10MB)"))
              .when(F.col("size_bytes") == 0, F.lit("File is empty"))
              .when(ext.isin(DANGEROUS_EXTENSIONS), F.concat(F.lit("File type not allowed: "), ext))
              .when(~ext.isin(ALLOWED_EXTENSIONS), F.lit("File type not supported"))
              .when(sig, F.lit("Binary or compressed files are not allowed")))
    return files.withColumn("is_valid", reason.isNull()).withColumn("reason", reason)


def labelled(files: DataFrame, labels: DataFrame) -> DataFrame:
    """S-05: the files of a label table (``file_name``, ``source``,
    ``description``): its rows with the path and size of their file, null and
    ``found`` false where there is none. A name that stands in several folders
    has a row for each."""
    have = files.select("file_name", "path", "size_bytes")
    return labels.join(have, "file_name", "left").withColumn("found", F.col("path").isNotNull())


def inventory(files: DataFrame, lines: DataFrame) -> DataFrame:
    """S-06: per file its size, its non-empty line count and the first three
    non-empty lines as a preview."""
    from logweave.operators.windows import top_n

    first3 = top_n(lines, 3, [F.col("line_no").asc()], ["path"], salt_by=["path", "line_no"], rank_col="_k")
    prev = first3.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))),
                                                                lambda s: s["line"]), " | ").alias("preview"))
    cnt = lines.groupBy("path").agg(F.count(F.lit(1)).alias("line_count"))
    return (files.join(cnt, "path", "left").join(prev, "path", "left")
            .withColumn("line_count", F.coalesce("line_count", F.lit(0))))


# ways in which a stand-in file differs, by bucket: name, and what it holds
ODD_FILES = ["plain.log", "latin.txt", "tool.exe", "data.bin", "packed.log", "empty.log", "UPPER.TXT", "README"]
ODD_BUCKET = 100


def latin_text(c: Column) -> Column:
    """Characters beyond Latin-1 as question marks."""
    return F.regexp_replace(c, "[^\\x{00}-\\x{FF}]", "?")


def stage_odd_files(spark: SparkSession, sf_dir: str) -> str:
    """Stand-in for files of all kinds: the documents of each bucket as one
    file under ``bucket=100`` and on, with the names of ``ODD_FILES``: one in
    Latin-1, one that starts like an archive, one empty."""
    from logweave.plans import store

    root = store._root(spark, sf_dir, "files") + "/odd-files"
    if not store._exists(spark, f"{root}/_DONE"):
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
        for b, name in enumerate(ODD_FILES):
            text = F.col("text")
            if name == "latin.txt":
                text = F.encode(latin_text(text), "ISO-8859-1").cast("string")
            rows = docs.where(F.col("doc_id") % N_BUCKETS == b).select("doc_id", text.alias("value"))
            if name == "packed.log":
                rows = rows.unionByName(spark.createDataFrame([(-1, "PK\x03\x04")], "doc_id bigint, value string"))
            rows = rows.repartition(1).sortWithinPartitions("doc_id").select("value")
            tmp, final = f"{root}/tmp/{b}", f"{root}/bucket={ODD_BUCKET + b}/{name}"
            fs, p = store._fs(spark, tmp)
            fs.mkdirs(store._fs(spark, final)[1].getParent())
            if name == "empty.log":
                store._touch(spark, final)
                continue
            rows.write.mode("overwrite").text(tmp)
            part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
            fs.rename(part, store._fs(spark, final)[1])
        fs, p = store._fs(spark, f"{root}/tmp")
        fs.delete(p, True)
        store._touch(spark, f"{root}/_DONE")
    return root
