"""Log-line parsing as column expressions.

``split_lines`` turns raw log text into numbered lines; ``parse_line`` runs the
format cascade (system, auth, console, generic syslog, then the fallback) on a
line column and returns one struct. Every branch is a plain Catalyst
expression (``regexp_extract``, ``try_make_timestamp_ntz``, ``when``) so the
whole parse stays inside whole-stage code generation; no Python runs per row.

Regex notes: Java's ``\\w \\d \\s \\b`` are ASCII unless ``(?U)`` is given, so
every pattern carries ``(?U)`` to match Unicode text the same way a Python
``re`` pattern would; ``(?d)`` makes ``\\n`` the only line terminator, so
``.`` stops only at ``\\n`` as Python's does.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.categorize import category_from_scores, category_inputs, category_score_columns

FLAGS = "(?Ud)"
WS_STRIP = FLAGS + r"^\s+|\s+$"


def _rx(pattern: str, anchored: bool = True) -> str:
    return FLAGS + ("^(?:" + pattern + ")" if anchored else pattern)


def lit_ts(ts: _dt.datetime | str | Column) -> Column:
    if isinstance(ts, Column):
        return ts
    if isinstance(ts, str):
        ts = _dt.datetime.fromisoformat(ts)
    return F.lit(ts).cast("timestamp_ntz")


def strip(c: Column) -> Column:
    """Python ``str.strip()``: all white space, not only blanks."""
    return F.regexp_replace(c, WS_STRIP, "")


def clean_message(c: Column) -> Column:
    """Remove control characters, then strip."""
    return strip(F.regexp_replace(c, R.CONTROL_CHARS, ""))


# ---------------------------------------------------------------- lines (P-01)
def split_lines(df: DataFrame, content: str = "content", id_col: str = "id", keep: list[str] | None = None) -> DataFrame:
    """Raw log rows -> ``(raw_log_id, line_no, line)``, stripped, non-empty.

    Line numbers count every line of the stripped text from 1, blank ones
    included, as the reference numbers them.
    """
    keep = keep or []
    exploded = df.select(
        F.col(id_col).alias("raw_log_id"), *keep,
        F.posexplode(F.split(strip(F.col(content)), "\n")).alias("pos", "raw_line"),
    )
    return (
        exploded.select("raw_log_id", *keep, (F.col("pos") + 1).alias("line_no"), strip(F.col("raw_line")).alias("line"))
        .where(F.col("line") != "")
    )


# ------------------------------------------------------------ timestamps (F-*)
def _month_map() -> Column:
    return F.create_map(*[x for i, m in enumerate(R.MONTHS) for x in (F.lit(m), F.lit(i + 1))])


def _num(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _make_ts(y, mo, d, h, mi, s, micros=None) -> Column:
    """``datetime(...)`` semantics: NULL for any out-of-range part (Spark would
    roll a 60th second into the next minute, Python rejects it)."""
    if micros is None:
        secs = s.cast("decimal(8,6)")
    else:
        secs = ((s * 1_000_000 + micros).cast("decimal(12,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(8,6)")
    return F.when(s < 60, F.try_make_timestamp_ntz(y, mo, d, h, mi, secs))


def syslog_from_parts(mon: Column, d, h, mi, s, ref_ts) -> Column:
    ref = lit_ts(ref_ts)
    mo = F.try_element_at(_month_map(), mon)
    y = F.year(ref)
    this_year = _make_ts(y, mo, d, h, mi, s)
    rolled = this_year > ref + F.expr(f"INTERVAL {R.SYSLOG_YEAR_ROLLBACK_DAYS} DAYS")
    return F.when(rolled, _make_ts(y - 1, mo, d, h, mi, s)).otherwise(this_year)


def console_from_parts(h, mi, s, us, sign: Column, tzh, tzm, ref_ts) -> Column:
    ref = lit_ts(ref_ts)
    offset_min = F.when(sign == "-", -1).otherwise(1) * (tzh * 60 + tzm)
    local = _make_ts(F.year(ref), F.month(ref), F.dayofmonth(ref), h, mi, s, us)
    utc = local - F.make_dt_interval(F.lit(0), F.lit(0), offset_min)
    limit = ref + F.expr(f"INTERVAL {R.CONSOLE_ROLLBACK_HOURS} HOURS")
    return F.when(utc > limit, utc - F.expr("INTERVAL 1 DAYS")).otherwise(utc)


def syslog_time(ts_str: Column, ref_ts) -> Column:
    """``Mon d HH:MM:SS``; the year is the reference year, or the year before
    when the result would be more than a day after the reference time."""
    rx = _rx(r"(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})")
    g = [F.regexp_extract(ts_str, rx, i) for i in range(1, 6)]
    return syslog_from_parts(g[0], *[_num(x) for x in g[1:]], ref_ts)


def console_time(ts_str: Column, ref_ts) -> Column:
    """``HH:MM:SS.ffffff+hhmm`` on the reference date, moved to UTC; one day
    back when more than two hours after the reference time."""
    rx = _rx(r"(\d{2}):(\d{2}):(\d{2})\.(\d{6})([+-])(\d{2})(\d{2})")
    g = [F.regexp_extract(ts_str, rx, i) for i in range(1, 8)]
    return console_from_parts(*[_num(x) for x in g[:4]], g[4], _num(g[5]), _num(g[6]), ref_ts)


def iso_time(ts_str: Column) -> Column:
    rx = _rx(r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2})")
    y, mo, d, h, mi, s = (_num(F.regexp_extract(ts_str, rx, i)) for i in range(1, 7))
    return _make_ts(y, mo, d, h, mi, s)


def us_time(ts_str: Column) -> Column:
    rx = _rx(r"(\d{2})/(\d{2})/(\d{4})\s+(\d{2}):(\d{2}):(\d{2})")
    mo, d, y, h, mi, s = (_num(F.regexp_extract(ts_str, rx, i)) for i in range(1, 7))
    return _make_ts(y, mo, d, h, mi, s)


def any_time(ts_str: Column, ref_ts) -> Column:
    """Timestamp of a string in any known form (console, syslog, ISO, US)."""
    return (
        F.when(ts_str.rlike(_rx(r"\d{2}:\d{2}:\d{2}\.\d{6}[+-]\d{4}")), console_time(ts_str, ref_ts))
        .when(ts_str.rlike(_rx(R.SYSLOG_TS)), syslog_time(ts_str, ref_ts))
        .when(ts_str.rlike(_rx(r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}")), iso_time(ts_str))
        .otherwise(us_time(ts_str))
    )



# ------------------------------------------------------------- cascade (P-02)
# The cascade patterns with the timestamp split into sub-groups, so one match
# yields every field. Sub-groups do not change what a pattern matches.
_SYSLOG_PARTS = r"((\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2}))"
_CONSOLE_PARTS = r"((\d{2}):(\d{2}):(\d{2})\.(\d{6})([+-])(\d{2})(\d{2}))"
_ISO_PARTS = r"((\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2}))"
_US_PARTS = r"((\d{2})/(\d{2})/(\d{4})\s+(\d{2}):(\d{2}):(\d{2}))"


def _with_parts(pattern: str, plain: str, parts: str) -> str:
    assert plain in pattern
    return pattern.replace(plain, parts, 1)


SYSTEM_RX = _with_parts(R.PATTERN_SYSTEM, R.SYSLOG_TS.join("()"), _SYSLOG_PARTS)      # 10 groups
AUTH_RX = _with_parts(R.PATTERN_AUTH, R.SYSLOG_TS.join("()"), _SYSLOG_PARTS)          # 10 groups
CONSOLE_RX = _with_parts(R.PATTERN_CONSOLE, r"(\d{2}:\d{2}:\d{2}\.\d{6}[+-]\d{4})", _CONSOLE_PARTS)  # 11
GENERIC_RX = _with_parts(R.PATTERN_GENERIC, R.SYSLOG_TS.join("()"), _SYSLOG_PARTS)    # 8 groups
# search forms: lazy prefix keeps the leftmost match (as re.search), tail = rest
ISO_SEARCH = r"(.*?)" + _with_parts(R.FALLBACK_ISO, R.FALLBACK_ISO, _ISO_PARTS) + r"(.*)"        # 9
US_SEARCH = r"(.*?)" + _with_parts(R.FALLBACK_US, R.FALLBACK_US, _US_PARTS) + r"(.*)"            # 9
SYSLOG_SEARCH = r"(.*?)" + _with_parts(R.FALLBACK_SYSLOG, R.FALLBACK_SYSLOG, _SYSLOG_PARTS) + r"(.*)"  # 8

# Group separator. Lines are already split on "\n", and with (?d) no group can
# span one, so "\n" can never occur inside a group.
_SEP = "\n"


def groups(text: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of a start-anchored match of ``pattern`` in one regex
    pass (NULL when no match; empty string for a group that took no part).

    Each pattern here ends in a greedy ``(.+)``/``(.*)``, so a match spans the
    whole line and replacing it by the joined groups leaves only the groups.
    """
    rx = _rx(pattern) + "$"
    repl = _SEP.join(f"${i}" for i in range(1, n + 1))
    return F.when(text.rlike(rx), F.split(F.regexp_replace(text, rx, repl), _SEP))


def _g(arr: str, i: int) -> Column:
    return F.col(arr).getItem(i - 1)


def _gi(arr: str, i: int) -> Column:
    return _num(_g(arr, i))


def _valid(ts: Column, source: Column, message: Column, ref_ts) -> Column:
    limit = lit_ts(ref_ts) + F.expr(f"INTERVAL {R.FUTURE_LIMIT_HOURS} HOURS")
    return (
        F.coalesce(ts <= limit, F.lit(False))
        & (F.length(source) >= 1) & (F.length(source) <= R.MAX_SOURCE_LEN)
        & F.coalesce(message.rlike(FLAGS + r"\S"), F.lit(False))
    )


def _pid_suffix(pid: Column) -> Column:
    return F.when(pid != "", F.concat(F.lit("["), pid, F.lit("]"))).otherwise(F.lit(""))


def _cand(name: str, ts, host, process, pid, source, message, ref_ts) -> Column:
    none = F.lit(None).cast("string")
    st = F.struct(
        F.lit(name).alias("pattern"), ts.alias("ts"), (host if host is not None else none).alias("host"),
        (process if process is not None else none).alias("process"),
        (F.when(pid != "", pid) if pid is not None else none).alias("pid"),
        source.alias("source"), message.alias("raw_message"),
    )
    return st


def parse_lines(lines: DataFrame, line: str = "line", ref_ts=R.REF_TS) -> DataFrame:
    """Run the format cascade on a DataFrame of single lines.

    Adds ``pattern event_ts host process pid source message category valid``.
    Order: system, auth, console, generic syslog, fallback. A pattern counts
    only when its event is valid (real date and time, not more than 6 h after
    the reference time, source of 1..255 characters, non-empty message);
    otherwise the next one is tried. ``valid`` is false for lines that even the
    fallback cannot turn into an event. Category is scored on the raw message,
    the stored message is the cleaned one.

    The work is staged in projections so each regex runs once per line: the
    match arrays, then the candidate structs, then the first valid one.
    """
    L = F.col(line)
    base = lines.columns
    s1 = lines.select(
        *base,
        groups(L, SYSTEM_RX, 10).alias("_gs"),
        groups(L, AUTH_RX, 10).alias("_ga"),
        groups(L, CONSOLE_RX, 11).alias("_gc"),
        groups(L, GENERIC_RX, 8).alias("_gg"),
    )

    def syslog_c(name: str, arr: str):
        ts = syslog_from_parts(_g(arr, 2), _gi(arr, 3), _gi(arr, 4), _gi(arr, 5), _gi(arr, 6), ref_ts)
        src = F.concat(_g(arr, 7), F.lit(":"), _g(arr, 8), _pid_suffix(_g(arr, 9)))
        return _cand(name, ts, _g(arr, 7), _g(arr, 8), _g(arr, 9), src, _g(arr, 10), ref_ts)

    con_ts = console_from_parts(_gi("_gc", 2), _gi("_gc", 3), _gi("_gc", 4), _gi("_gc", 5), _g("_gc", 6),
                                _gi("_gc", 7), _gi("_gc", 8), ref_ts)
    con = _cand("console", con_ts, None, _g("_gc", 9), _g("_gc", 10),
                F.concat(_g("_gc", 9), _pid_suffix(_g("_gc", 10))), _g("_gc", 11), ref_ts)
    gen_ts = syslog_from_parts(_g("_gg", 2), _gi("_gg", 3), _gi("_gg", 4), _gi("_gg", 5), _gi("_gg", 6), ref_ts)
    gen = _cand("generic", gen_ts, _g("_gg", 7), None, None, _g("_gg", 7), _g("_gg", 8), ref_ts)
    s2 = s1.select(*base, *[F.when(F.col(a).isNotNull(), c).alias(n) for a, c, n in (
        ("_gs", syslog_c("system", "_gs"), "_cs"), ("_ga", syslog_c("auth", "_ga"), "_ca"),
        ("_gc", con, "_cc"), ("_gg", gen, "_cg"))])
    s3 = s2.select(*base, *[
        F.when(F.col(c).isNotNull(), _valid(F.col(c + ".ts"), F.col(c + ".source"), F.col(c + ".raw_message"), ref_ts))
        .otherwise(F.lit(False)).alias(c + "_ok") for c in ("_cs", "_ca", "_cc", "_cg")], "_cs", "_ca", "_cc", "_cg")
    chosen = (F.when(F.col("_cs_ok"), F.col("_cs")).when(F.col("_ca_ok"), F.col("_ca"))
              .when(F.col("_cc_ok"), F.col("_cc")).when(F.col("_cg_ok"), F.col("_cg")))
    s4 = s3.select(*base, chosen.alias("_c"))
    # fallback, only for lines no pattern turned into a valid event
    # (a time has a colon, an ISO date a dash and a US date a slash: without
    # them the search needs no regex)
    need = F.col("_c").isNull() & F.contains(L, F.lit(":"))
    s5 = s4.select(*base, "_c",
                   F.when(need & F.contains(L, F.lit("-")), groups(L, ISO_SEARCH, 9)).alias("_fi"),
                   F.when(need & F.contains(L, F.lit("/")), groups(L, US_SEARCH, 9)).alias("_fu"),
                   F.when(need, groups(L, SYSLOG_SEARCH, 8)).alias("_fs"))
    iso_ts = _make_ts(_gi("_fi", 3), _gi("_fi", 4), _gi("_fi", 5), _gi("_fi", 6), _gi("_fi", 7), _gi("_fi", 8))
    us_ts = _make_ts(_gi("_fu", 5), _gi("_fu", 3), _gi("_fu", 4), _gi("_fu", 6), _gi("_fu", 7), _gi("_fu", 8))
    sys_ts = syslog_from_parts(_g("_fs", 3), _gi("_fs", 4), _gi("_fs", 5), _gi("_fs", 6), _gi("_fs", 7), ref_ts)
    s6 = s5.select(*base, "_c", iso_ts.alias("_ti"), _g("_fi", 9).alias("_ri"), us_ts.alias("_tu"),
                   _g("_fu", 9).alias("_ru"), sys_ts.alias("_ty"), _g("_fs", 8).alias("_ry"))
    fts = F.coalesce(F.col("_ti"), F.col("_tu"), F.col("_ty"))
    rest = (F.when(F.col("_ti").isNotNull(), F.col("_ri")).when(F.col("_tu").isNotNull(), F.col("_ru"))
            .when(F.col("_ty").isNotNull(), F.col("_ry")))
    s7 = s6.select(*base, "_c", fts.alias("_ft"), F.coalesce(F.nullif(strip(rest), F.lit("")), L).alias("_rest"))
    R_ = F.col("_rest")
    s8 = s7.select(*base, "_c", "_ft", "_rest",
                   F.when(F.col("_c").isNull(), groups(R_, R.FALLBACK_COLON.lstrip("^"), 2)).alias("_fc"),
                   F.when(F.col("_c").isNull(), groups(R_, R.FALLBACK_SPACE.lstrip("^"), 2)).alias("_fp"))
    fsrc = F.coalesce(_g("_fc", 1), _g("_fp", 1), F.lit("unknown"))
    fmsg = F.coalesce(_g("_fc", 2), _g("_fp", 2), R_)
    fname = F.when(F.col("_ft").isNull(), F.lit("fallback_now")).otherwise(F.lit("fallback_ts"))
    fb = F.struct(fname.alias("pattern"), F.coalesce(F.col("_ft"), lit_ts(ref_ts)).alias("ts"),
                  F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("process"),
                  F.lit(None).cast("string").alias("pid"), fsrc.alias("source"), fmsg.alias("raw_message"))
    s9 = s8.select(*base, F.col("_c").isNotNull().alias("_ok"), F.coalesce(F.col("_c"), fb).alias("_p"))
    s10 = s9.select(
        *base, "_ok", F.col("_p.pattern").alias("_pattern"), F.col("_p.ts").alias("_ts"), F.col("_p.host").alias("_host"),
        F.col("_p.process").alias("_process"), F.col("_p.pid").alias("_pid"), F.col("_p.source").alias("_source"),
        F.col("_p.raw_message").alias("_raw"))
    s11 = s10.select(*base, "_ok", "_pattern", "_ts", "_host", "_process", "_pid", "_source", "_raw",
                     clean_message(F.col("_raw")).alias("_message"),
                     *category_inputs(F.col("_raw"), F.col("_source")))
    keep = ["_ok", "_pattern", "_ts", "_host", "_process", "_pid", "_source", "_raw", "_message", "_cat_src"]
    s12 = s11.select(*base, *keep, *category_score_columns())
    out = F.struct(
        F.col("_pattern").alias("pattern"), F.col("_ts").alias("event_ts"), F.col("_host").alias("host"),
        F.col("_process").alias("process"), F.col("_pid").alias("pid"), F.col("_source").alias("source"),
        F.col("_message").alias("message"),
        category_from_scores().alias("category"),
        (F.col("_ok") | _valid(F.col("_ts"), F.col("_source"), F.col("_raw"), ref_ts)).alias("valid"),
    )
    # Generate as an optimizer barrier: filters on the parsed columns (valid,
    # category, ...) stay above it instead of being pushed down through the
    # staged projections (which would substitute every alias into the filter
    # and evaluate the cascade twice); filters on the pass-through columns
    # still go below it, down to the scan.
    return s12.select(*base, F.inline(F.array(out)))
