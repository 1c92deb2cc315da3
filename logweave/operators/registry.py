"""Format registry: detect, compose, remember and parse (D-02, D-04..D-07,
F-04, F-30, O-07).

``compose_formats`` turns the detection results of each source into registry
rows (regex and the group number of every field); ``best_formats`` keeps the
best row of a source; ``parse_with_formats`` parses lines with the row of their
source and hands the rest to the format cascade. One aggregate over all lines
(``source_profile``: match counts, delimiters, field positions; numbers alone,
so it is a hash aggregate) gives everything a registry is composed of. The
regexes of a registry are put together from a closed set of parts, so a parse
has a branch with a constant regex for each of the few that occur; the registry
itself has a handful of rows a source and is broadcast behind a size check.

Group numbers count the groups that are really in the regex (one group for the
timestamp), confidence is compared by rank, and the Apache time keeps its
brackets and its zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.categorize import category_from_scores, category_inputs, category_score_columns
from logweave.functions.parse import FLAGS, iso_time, lit_ts, parse_lines, strip, us_time
from logweave.operators.formats import (DELIMITERS, TIMESTAMP_KINDS, chosen_delimiter, chosen_timestamp, delimiter_count,
                                         delimiter_counts, timestamp_counts)
from logweave.session import broadcast_if_small, cut_lineage

# FIXED VALUES: field patterns, in order
FIELD_PATTERNS = [
    ("hostname", r"\b([a-zA-Z0-9\-\.]+)\b"),
    ("ip_address", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"),
    ("process_name", r"\b([a-zA-Z0-9_\-]+)\b"),
    ("pid", r"\[(\d+)\]"),
    ("log_level", r"\b(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b"),
    ("quoted_string", r'"([^"]*)"'),
    ("bracketed_content", r"\[([^\]]*)\]"),
    ("parenthesized_content", r"\(([^)]*)\)"),
]
# FIXED VALUES: thresholds and pattern parts
PRESENT_SHARE, SPREAD_MAX = 0.3, 50
HOST_PART, PROCESS_PART, PID_PART, MESSAGE_PART = r"\s+(\S+)", r"\s+([^:\[\s]+)", r"(?:\[(\d+)\])?", r"\s*:\s*(.+)"
GENERIC_PATTERN = "(.+)"
MAX_FIELDS = 6
GROUP_MARK = "\u0001"
KEEP_FORMATS = 5
MIN_LINES = 10
UNPARSED_CUT = 1000
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def _field_places(line: str) -> list[Column]:
    """(n, first, last) of every field's matches in a line: their number, the
    first start and the last one.

    The texts between the matches of a line give the first start and, from the
    end, the last one, so all matches of a line count and none is listed."""
    L = F.col(line)
    out = []
    for name, rx in FIELD_PATTERNS:
        between = F.split(L, FLAGS + rx, -1)
        hits = F.regexp_extract_all(L, F.lit(FLAGS + rx), F.lit(0))
        last = F.length(L) - F.length(F.element_at(between, -1)) - F.length(F.try_element_at(hits, F.lit(-1)))
        out.append(F.struct(F.size(hits).alias("n"), F.length(between[0]).alias("first"), last.alias("last")).alias("_" + name))
    return out


def _field_counts() -> list[Column]:
    """Aggregates over ``_field_places``: matches and extreme starts of each field."""
    out = []
    for name, _ in FIELD_PATTERNS:
        c = F.col("_" + name)
        seen = c["n"] > 0
        out += [F.sum(c["n"]).alias("n_" + name), F.min(F.when(seen, c["first"])).alias("first_" + name),
                F.max(F.when(seen, c["last"])).alias("last_" + name)]
    return out


def source_profile(lines: DataFrame, source: str = "source_name", line: str = "line", order: str = "line_no") -> DataFrame:
    """All counts of a source in one pass over its lines: lines, matches of the
    timestamp kinds, delimiters (over all lines and in the first one), and the
    matches and extreme starts of the fields."""
    in_first = [F.min_by(delimiter_count(line, d).cast("long"), F.col(order)).alias(f"f{i}") for i, d in enumerate(DELIMITERS)]
    return (lines.select(source, line, order, *_field_places(line)).groupBy(source)
            .agg(F.count(F.lit(1)).alias("sample_lines"), *timestamp_counts(line), *delimiter_counts(line), *in_first,
                 *_field_counts()))


def _present(name: str) -> Column:
    return (F.col("n_" + name) > 0) & (F.col("n_" + name) >= F.col("sample_lines") * PRESENT_SHARE)


def _spread(name: str) -> Column:
    return (F.col("last_" + name) - F.col("first_" + name)).cast("int")


def detect_fields(lines: DataFrame, source: str = "source_name", line: str = "line") -> DataFrame:
    """D-02: per source and field the number of matches, the spread of their
    start positions, whether it is present (matches >= 30 % of the lines) and
    consistent (spread < 50). Fields without a match have no row."""
    g = lines.select(source, *_field_places(line)).groupBy(source).agg(F.count(F.lit(1)).alias("sample_lines"), *_field_counts())
    rows = [F.struct(F.lit(n).alias("field"), F.col("n_" + n).alias("matches"), _spread(n).alias("spread"),
                     _present(n).alias("present"), (_present(n) & (_spread(n) < SPREAD_MAX)).alias("consistent"))
            for n, _ in FIELD_PATTERNS]
    return g.select(source, F.inline(F.array(*rows))).where(F.col("matches") > 0)


def _timestamp_part(kind: str, rx: str) -> str:
    """The kind's pattern without its word boundaries; brackets stay."""
    return rx if kind == "apache_common" else rx.removeprefix(r"\b").removesuffix(r"\b")


def _rank(confidence: Column) -> Column:
    expr = F.lit(0)
    for name, rank in CONFIDENCE_RANK.items():
        expr = F.when(confidence == name, rank).otherwise(expr)
    return expr


def compose_formats(lines: DataFrame, source: str = "source_name", line: str = "line", order: str = "line_no") -> DataFrame:
    """D-04: registry rows ``(source, format_name, regex_pattern, ts_kind,
    g_timestamp, g_host, g_process, g_pid, g_message, confidence, rank,
    frequency, place)``. A source gets a timestamp format where a timestamp
    kind was found, a delimited format (at most 6 fields, counted in its first
    line) where its delimiter is structured, and ``(.+)`` where neither holds."""
    d_first = F.create_map(*[x for i, d in enumerate(DELIMITERS) for x in (F.lit(d), F.col(f"f{i}"))])
    s = source_profile(lines, source, line, order).select(
        source, "sample_lines", *chosen_timestamp(), *chosen_delimiter(), d_first.alias("_first"),
        F.coalesce(_present("hostname") & (_spread("hostname") < SPREAD_MAX), F.lit(False)).alias("host"),
        _present("process_name").alias("process"), _present("pid").alias("pid"),
        sum(_present(n).cast("int") for n, _ in FIELD_PATTERNS).alias("n_present")).withColumnRenamed("confidence", "ts_conf")

    none = F.lit(None).cast("int")
    ts_part = F.lit(None).cast("string")
    for kind, rx in TIMESTAMP_KINDS:
        ts_part = F.when(F.col("best_pattern") == kind, F.lit(_timestamp_part(kind, rx))).otherwise(ts_part)
    part = {c: F.when(F.col(c), F.lit(p)).otherwise(F.lit("")) for c, p in
            (("host", HOST_PART), ("process", PROCESS_PART), ("pid", PID_PART))}
    one = {c: F.col(c).cast("int") for c in part}
    timed = F.struct(
        F.concat(F.lit("detected_"), F.col("best_pattern")).alias("format_name"),
        F.concat(ts_part, part["host"], part["process"], part["pid"], F.lit(MESSAGE_PART)).alias("regex_pattern"),
        F.col("best_pattern").alias("ts_kind"), F.lit(1).alias("g_timestamp"),
        F.when(F.col("host"), 2).alias("g_host"),
        F.when(F.col("process"), 2 + one["host"]).alias("g_process"),
        F.when(F.col("pid"), 2 + one["host"] + one["process"]).alias("g_pid"),
        (2 + one["host"] + one["process"] + one["pid"]).alias("g_message"),
        F.when(F.col("ts_conf") == "medium", "medium").when(F.col("n_present") < 2, "low").otherwise("high").alias("confidence"),
        F.lit(1).alias("place"))
    d = F.col("primary_delimiter")
    n_fields = F.least(F.lit(MAX_FIELDS), F.col("_first")[d].cast("int") + 1)
    quoted = F.concat(F.lit("\\"), d)
    cell = F.concat(F.lit("([^"), quoted, F.lit("]*)"))
    delimited = F.struct(
        F.concat(F.lit("delimited_"), d).alias("format_name"),
        F.array_join(F.array_repeat(cell, n_fields), "\u0000").alias("regex_pattern"),
        F.lit(None).cast("string").alias("ts_kind"), none.alias("g_timestamp"), none.alias("g_host"),
        none.alias("g_process"), none.alias("g_pid"), n_fields.alias("g_message"),
        F.lit("medium").alias("confidence"), F.lit(2).alias("place"))
    delimited = delimited.withField("regex_pattern", F.replace(delimited["regex_pattern"], F.lit("\u0000"), quoted))
    generic = F.struct(
        F.lit("generic_fallback").alias("format_name"), F.lit(GENERIC_PATTERN).alias("regex_pattern"),
        F.lit(None).cast("string").alias("ts_kind"), none.alias("g_timestamp"), none.alias("g_host"),
        none.alias("g_process"), none.alias("g_pid"), F.lit(1).alias("g_message"),
        F.lit("low").alias("confidence"), F.lit(3).alias("place"))
    has_ts, has_dl = F.col("best_pattern").isNotNull(), F.coalesce(F.col("structured"), F.lit(False))
    rows = F.array_compact(F.array(F.when(has_ts, timed), F.when(has_dl, delimited), F.when(~has_ts & ~has_dl, generic)))
    out = s.select(source, F.col("sample_lines").alias("frequency"), F.inline(rows))
    return out.withColumn("rank", _rank(F.col("confidence")))


def best_formats(registry: DataFrame, source: str = "source_name", min_lines: int = 1) -> DataFrame:
    """D-06: the registry row a source is remembered by: highest confidence,
    then most lines, then the order of composition; at most three candidates
    a source, so the aggregate is one row per source."""
    rest = [c for c in registry.columns if c != source]
    best = registry.where(F.col("frequency") >= min_lines).groupBy(source).agg(
        F.max_by(F.struct(*rest), F.struct("rank", "frequency", (-F.col("place")).alias("p"))).alias("_b"))
    return best.select(source, "_b.*")


def top_formats(registry: DataFrame, n: int = KEEP_FORMATS) -> DataFrame:
    """O-07: formats (name and regex) over all sources, the ``n`` best by
    frequency, then confidence rank, then name and regex."""
    from logweave.operators.windows import top_n

    g = registry.groupBy("format_name", "regex_pattern").agg(F.sum("frequency").alias("frequency"), F.max("rank").alias("rank"))
    return top_n(g, n, [F.col("frequency").desc(), F.col("rank").desc(), F.col("format_name").asc(), F.col("regex_pattern").asc()])


def _apache_time(ts: Column) -> Column:
    rx = FLAGS + r"^\[?(\d{2})/(\w{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s+([+-])(\d{2})(\d{2})\]?$"
    g = [F.regexp_extract(ts, rx, i) for i in range(1, 10)]
    local = syslog_like(g[1], g[2], g[0], g[3], g[4], g[5])
    minutes = F.when(g[6] == "-", -1).otherwise(1) * (_int(g[7]) * 60 + _int(g[8]))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def syslog_like(month: Column, year: Column, *rest: Column) -> Column:
    """Timestamp of a month name, a year and day, hour, minute, second."""
    day, h, mi, s = rest
    months = F.create_map(*[x for i, m in enumerate(R.MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    return F.when(_int(s) < 60, F.try_make_timestamp_ntz(
        _int(year), F.try_element_at(months, month), _int(day), _int(h), _int(mi), _int(s).cast("decimal(8,6)")))


def time_of_kind(kind: Column, ts: Column, ref_ts=R.REF_TS) -> Column:
    """F-04: the timestamp of a string of a detected kind: syslog in the
    reference year, ISO (with milliseconds), US, epoch seconds and
    milliseconds, Apache moved to UTC; the reference time where it can't be
    read."""
    ref = lit_ts(ref_ts)
    rx = FLAGS + r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
    g = [F.regexp_extract(ts, rx, i) for i in range(1, 6)]
    syslog = syslog_like(g[0], F.year(ref).cast("string"), *g[1:])
    millis = F.coalesce(_int(F.regexp_extract(ts, r"\.(\d{3})$", 1)), F.lit(0))
    read = (F.when(kind == "syslog", syslog)
            .when(kind.isin("iso_datetime", "iso_with_ms"), iso_time(ts) + F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)")))
            .when(kind == "us_datetime", us_time(ts))
            .when(kind == "epoch_seconds", F.timestamp_seconds(F.try_to_number(ts, F.lit("9999999999")).cast("long")).cast("timestamp_ntz"))
            .when(kind == "epoch_milliseconds", F.timestamp_millis(F.try_to_number(ts, F.lit("9999999999999")).cast("long")).cast("timestamp_ntz"))
            .when(kind == "apache_common", _apache_time(ts)))
    return F.coalesce(read, ref)


def parse_with_formats(lines: DataFrame, learned: DataFrame, detected: DataFrame, *, source: str = "source_name",
                       line: str = "line", ref_ts=R.REF_TS) -> DataFrame:
    """D-05/D-07/F-30: lines with ``format_name method event_ts source
    message category`` added. A source's learned format goes before the one
    detected now; a line its format does not match is parsed by the cascade,
    and what that can't parse either is kept as an unparsed event (message cut
    at 1000 characters, category unknown, the line's own source).

    ``method``: ``learned_pattern``, ``auto_detection``, ``fallback_parser`` or
    ``unparsed``. Lines are stripped and empty ones left out."""
    keep = lines.columns
    fields = ["format_name", "regex_pattern", "ts_kind", "g_timestamp", "g_host", "g_process", "g_pid", "g_message"]
    known = learned.select(source, *fields, F.lit("learned_pattern").alias("method"))
    new = detected.join(known.select(source), source, "left_anti").select(source, *fields, F.lit("auto_detection").alias("method"))
    formats = cut_lineage(known.unionByName(new))
    rows = lines.withColumn(line, strip(F.col(line))).where(F.col(line) != "").join(broadcast_if_small(formats), source, "left")
    # at most a few dozen, put together from the parts above: a branch with a constant regex for each
    patterns = formats.select(*fields[1:]).distinct().collect()
    caught = F.lit(None).cast("string")
    for p in patterns:
        rx = f"{FLAGS}^(?:{p['regex_pattern']})"
        groups = GROUP_MARK.join(f"${p[g]}" if p[g] else "" for g in fields[3:])
        caught = F.when((F.col("regex_pattern") == p["regex_pattern"]) & F.col(line).rlike(rx),
                        F.regexp_replace(line, rx + r"[\s\S]*", groups)).otherwise(caught)
    # generated, so that the filters below don't catch again
    hit = rows.select("*", F.explode(F.array(caught)).alias("_caught"))

    def group(name: str) -> Column:
        part = F.get(F.split("_caught", GROUP_MARK), fields[3:].index(name))
        return F.when(F.col(name).isNotNull(), part).alias("_" + name)

    matched = hit.where(F.col("_caught").isNotNull()).select(*keep, "format_name", "method", "ts_kind", *[group(f) for f in fields[3:]])
    named = F.when(F.col("_g_host").isNotNull() & F.col("_g_process").isNotNull(),
                   F.concat("_g_host", F.lit(":"), "_g_process", F.when(F.col("_g_pid") != "", F.concat(
                       F.lit("["), F.col("_g_pid"), F.lit("]"))).otherwise(F.lit("")))).otherwise(F.coalesce("_g_host", "_g_process", F.lit("unknown")))
    parsed = matched.select(
        *keep, "format_name", "method", time_of_kind(F.col("ts_kind"), F.col("_g_timestamp"), ref_ts).alias("event_ts"),
        named.alias("source"), F.col("_g_message").alias("_raw"))
    scored = parsed.select(*parsed.columns, *category_inputs(F.col("_raw"), F.col("source")))
    scored = scored.select(*parsed.columns, "_cat_src", *category_score_columns()).select(
        *keep, "format_name", "method", "event_ts", "source", strip(F.col("_raw")).alias("message"), category_from_scores().alias("category"))

    rest = parse_lines(hit.where(F.col("_caught").isNull()).select(*keep), line, ref_ts)
    ok, whole = F.col("valid"), F.col(line)
    cut = F.when(F.length(whole) > UNPARSED_CUT, F.concat(F.left(whole, F.lit(UNPARSED_CUT)), F.lit("..."))).otherwise(whole)
    fallback = rest.select(
        *keep, F.lit(None).cast("string").alias("format_name"),
        F.when(ok, "fallback_parser").otherwise("unparsed").alias("method"),
        F.when(ok, F.col("event_ts")).otherwise(lit_ts(ref_ts)).alias("event_ts"),
        F.when(ok, F.col("source")).otherwise(F.col(source)).alias("source"),
        F.when(ok, F.col("message")).otherwise(cut).alias("message"),
        F.when(ok, F.col("category")).otherwise(F.lit("unknown")).alias("category"))
    return scored.unionByName(fallback)
