"""Event queries: filters, the nested event view, joins with the analysis,
sorting and paging (P-08..P-22, J-01..J-05, O-01..O-06).

Every function takes DataFrames and plain parameters and returns a lazy
DataFrame; argument checks (P-13) raise before any plan is built.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import rules as R
from logweave.functions.parse import lit_ts
from logweave.operators.windows import top_n

SORT_FIELDS = {"timestamp": "timestamp", "severity": "severity_score", "source": "source", "category": "category"}


def check_event_filters(sort_by: str = "timestamp", min_severity: int | None = None, max_severity: int | None = None,
                        start: _dt.datetime | None = None, end: _dt.datetime | None = None,
                        category: str | None = None, per_page: int = 50, page: int = 1) -> None:
    """P-13: argument checks done on the driver before planning."""
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"sort_by must be one of {sorted(SORT_FIELDS)}")
    for s in (min_severity, max_severity):
        if s is not None and not 1 <= s <= 10:
            raise ValueError("severity must be within 1..10")
    if min_severity is not None and max_severity is not None and max_severity < min_severity:
        raise ValueError("max_severity must be greater than or equal to min_severity")
    if start is not None and end is not None and end < start:
        raise ValueError("end_date must be after start_date")
    if category is not None and category not in R.CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    if not 1 <= per_page <= 100 or page < 1:
        raise ValueError("page >= 1 and 1 <= per_page <= 100")


def with_analysis(events: DataFrame, analysis: DataFrame) -> DataFrame:
    """J-01: events LEFT OUTER analysis on the event id. The analysis is 1:1
    with events, so the planner's sort-merge (or broadcast, by size) join
    keeps one row per event."""
    a = analysis.select(F.col("event_id").alias("_aid"), "severity_score", "explanation", "recommendations", "analyzed_at")
    return events.join(a, events["id"] == a["_aid"], "left").drop("_aid")


def nested_view(joined: DataFrame) -> DataFrame:
    """P-08: event + optional analysis struct (NULL when there is none)."""
    st = F.struct("severity_score", "explanation", "recommendations", "analyzed_at")
    return joined.select(
        "id", "raw_log_id", "timestamp", "source", "message", "category",
        F.when(F.col("analyzed_at").isNotNull(), st).alias("ai_analysis"),
    )


def filter_events(df: DataFrame, category: str | None = None, source: str | None = None,
                  start: _dt.datetime | None = None, end: _dt.datetime | None = None,
                  min_severity: int | None = None, max_severity: int | None = None) -> DataFrame:
    """P-12 on the joined view: optional predicates ANDed. A severity bound
    on the right side of the outer join turns it into an inner join
    (Catalyst's EliminateOuterJoin does that rewrite)."""
    check_event_filters(min_severity=min_severity, max_severity=max_severity, start=start, end=end, category=category)
    cond = F.lit(True)
    if category is not None:
        cond = cond & (F.col("category") == category)
    if source is not None:
        cond = cond & F.col("source").ilike(f"%{source}%")
    if start is not None:
        cond = cond & date_bounds(df, low=lit_ts(start)) & (F.col("timestamp") >= lit_ts(start))
    if end is not None:
        cond = cond & date_bounds(df, high=lit_ts(end)) & (F.col("timestamp") <= lit_ts(end))
    if min_severity is not None:
        cond = cond & (F.col("severity_score") >= min_severity)
    if max_severity is not None:
        cond = cond & (F.col("severity_score") <= max_severity)
    return df.where(cond)


def sort_events(df: DataFrame, sort_by: str = "timestamp", order: str = "desc") -> DataFrame:
    """O-01 with ``id`` as tie-break so pages are repeatable."""
    check_event_filters(sort_by=sort_by)
    c = F.col(SORT_FIELDS[sort_by])
    c = c.desc_nulls_last() if order == "desc" else c.asc_nulls_first()
    return df.orderBy(c, F.col("id").asc())


def page(df: DataFrame, page_no: int, per_page: int, sort_by: str = "timestamp", order: str = "desc") -> DataFrame:
    """O-02: one page plus ``total`` and ``total_pages`` columns.

    The page is a top-k (``offset + per_page`` rows, TakeOrderedAndProject
    style) and the total is a separate count joined as a one-row broadcast,
    so no full sort of the result is needed for shallow pages.
    """
    check_event_filters(sort_by=sort_by, per_page=per_page, page=page_no)
    sorted_df = sort_events(df, sort_by, order)
    rows = sorted_df.offset((page_no - 1) * per_page).limit(per_page)
    total = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(per_page)).cast("long").alias("total_pages"))
    return rows.crossJoin(F.broadcast(total))


def page_after(df: DataFrame, per_page: int, after: tuple | None = None, *, sort_by: str = "timestamp",
               order: str = "desc", days: dict | None = None) -> DataFrame:
    """O-02 by position: the ``per_page`` rows after the position ``after``
    (sort value and id of the last row before, as ``last_position`` gives it)
    in the order of ``sort_events``. No row before the page is read again: the
    position is a predicate.

    By time, with ``days`` (events per day of an unfiltered table partitioned by
    day), the days that can hold the page are a predicate on the partition too:
    the position's day and as many after it as it takes to fill the page, so
    any page reads what the first one reads.
    """
    check_event_filters(sort_by=sort_by, per_page=per_page)
    c, desc = F.col(SORT_FIELDS[sort_by]), order == "desc"
    if after is not None:
        value, last_id = after
        same_later = F.col("id") > F.lit(last_id)
        if value is None:  # nulls come last in falling order, first in rising order
            later = c.isNull() & same_later
            df = df.where(later if desc else later | c.isNotNull())
        else:
            v = lit_ts(value) if sort_by == "timestamp" else F.lit(value)
            beyond = ((c < v) | c.isNull()) if desc else c > v
            df = df.where(beyond | ((c == v) & same_later))
    if days is not None and sort_by == "timestamp":
        start = after[0].date() if after is not None and after[0] is not None else None
        ordered = sorted((d for d in days if d is not None), reverse=desc)
        need, reach = per_page, []
        for d in ordered:
            if start is not None and (d > start if desc else d < start):
                continue
            if need <= 0:
                break
            reach.append(d)
            if d != start:  # the position's own day may hold none
                need -= days[d]
        if reach:
            df = df.where((F.col("event_date") >= F.lit(min(reach))) & (F.col("event_date") <= F.lit(max(reach))))
    return sort_events(df, sort_by, order).limit(per_page)


def last_position(page_rows: DataFrame, sort_by: str = "timestamp") -> tuple | None:
    """(sort value, id) of a page's last row; None for an empty page. A page
    has 100 rows at most."""
    rows = page_rows.select(SORT_FIELDS[sort_by], "id").collect()
    return tuple(rows[-1]) if rows else None


def search_events(df: DataFrame, text: str | None = None, min_severity: int | None = None,
                  end_date: _dt.date | None = None) -> DataFrame:
    """P-14: case-insensitive text search over message/source/category,
    missing severity counts as 0, end date includes the whole day."""
    cond = F.lit(True)
    if text:
        t = F.lit(text.lower())
        cond = cond & (F.lower("message").contains(t) | F.lower("source").contains(t) | F.lower("category").contains(t))
    if min_severity is not None:
        cond = cond & (F.coalesce(F.col("severity_score"), F.lit(0)) >= min_severity)
    if end_date is not None:
        cond = cond & date_bounds(df, high=F.lit(end_date)) & (F.col("timestamp") < F.date_add(F.lit(end_date), 1).cast("timestamp_ntz"))
    return df.where(cond)


def event_detail(events: DataFrame, analysis: DataFrame, event_id: str) -> DataFrame:
    """P-15: point lookup with its analysis (the filter reaches both scans)."""
    return with_analysis(events.where(F.col("id") == event_id), analysis.where(F.col("event_id") == event_id))


def original_line(events: DataFrame, lines: DataFrame) -> DataFrame:
    """J-03: the raw line of each event, by exact (raw_log_id, line_no)."""
    return events.join(lines.select("raw_log_id", "line_no", "line"), ["raw_log_id", "line_no"], "inner")


def date_bounds(df: DataFrame, ts: str = "timestamp", low: Column | None = None, high: Column | None = None) -> Column:
    """Bounds on the ``event_date`` partition that follow from bounds on
    ``timestamp``, so that a scan of the stored events reads only those days;
    true for tables without that partition."""
    cond = F.lit(True)
    if ts == "timestamp" and "event_date" in df.columns:
        if low is not None:
            cond = cond & (F.col("event_date") >= F.to_date(low))
        if high is not None:
            cond = cond & (F.col("event_date") <= F.to_date(high))
    return cond


def last_hours(df: DataFrame, hours: int, ref_ts=R.REF_TS, ts: str = "timestamp") -> DataFrame:
    """P-09: rows of the last ``hours`` hours before the reference time."""
    ref = lit_ts(ref_ts)
    low = ref - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.where(date_bounds(df, ts, low, ref) & (F.col(ts) >= low) & (F.col(ts) <= ref))


def security_events(df: DataFrame) -> DataFrame:
    """P-10: message contains a security word (case-sensitive) or the
    process is a security process. Events carry no subsystem, so the
    subsystem branch of the predicate has nothing to test here."""
    cond = F.lit(False)
    for w in R.SECURITY_MESSAGE_WORDS:
        cond = cond | F.col("message").contains(w)
    return df.where(cond | F.col("process").isin(R.SECURITY_PROCESSES))


def process_events(df: DataFrame, process: str) -> DataFrame:
    """P-11."""
    return df.where(F.col("process") == process)


def threat_flag(message: Column) -> Column:
    """P-20: message contains any threat word (lower-case test)."""
    low = F.lower(message)
    cond = F.lit(False)
    for w in R.THREAT_WORDS:
        cond = cond | low.contains(w)
    return cond


def recent_suspicious(df: DataFrame, last_n: int = 10, show: int = 5, partition: str | None = None) -> DataFrame:
    """P-21: among the last ``last_n`` events (per ``partition`` if given),
    the suspicious ones, the most recent ``show`` of them."""
    keys = [partition] if partition else None
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    last = top_n(df, last_n, order, keys, salt_by=["id"])
    return top_n(last.where(threat_flag(F.col("message"))), show, order, keys, salt_by=["id"])


def truncate_text(c: Column, n: int) -> Column:
    """P-07: cut to ``n`` characters and add ``...``."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def analyses_of_old_events(events: DataFrame, analysis: DataFrame, days: int, ref_ts=R.REF_TS) -> DataFrame:
    """J-04: analyses whose event is older than ``days`` (semi join)."""
    limit = lit_ts(ref_ts) - F.make_dt_interval(F.lit(days))
    old = events.where(date_bounds(events, high=limit) & (F.col("timestamp") < limit))
    return analysis.join(old.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def orphans(child: DataFrame, parent: DataFrame, fk: str = "event_id", pk: str = "id") -> DataFrame:
    """J-05: child rows whose parent is missing (anti join, NULL-safe unlike
    ``NOT IN``)."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def notification_history(nh: DataFrame, limit: int = 100, rule: str | None = None, channel: str | None = None,
                         status: str | None = None, event_id=None) -> DataFrame:
    """P-16: history filtered by rule (LIKE %rule%), channel, status, event,
    newest first, at most ``limit`` rows (a top-k, not a full sort)."""
    cond = F.lit(True)
    if rule:
        cond = cond & F.col("notification_type").like(f"%{rule}%")
    if channel:
        cond = cond & (F.col("channel") == channel)
    if status:
        cond = cond & (F.col("status") == status)
    if event_id is not None:
        cond = cond & (F.col("event_id") == event_id)
    return top_n(nh.where(cond), limit, [F.col("sent_at").desc(), F.col("id").desc()])


def metrics_for_source(pm: DataFrame, source: str | None, hours: int, ref_ts=R.REF_TS) -> DataFrame:
    """P-17: metrics of the last ``hours`` whose JSON metadata names the
    source (``$.source_name``); rows without it belong to no source."""
    m = last_hours(pm, hours, ref_ts)
    if source:
        m = m.where(F.get_json_object("metric_metadata", "$.source_name") == source)
    return m


def audit_query(audit: DataFrame, limit: int = 100, offset: int = 0, event_types: list[str] | None = None,
                user: str | None = None, start=None, end=None, severity: str | None = None,
                success: bool | None = None) -> DataFrame:
    """P-18: optional predicates ANDed, newest first, offset/limit."""
    cond = F.lit(True)
    if event_types:
        cond = cond & F.col("event_type").isin(event_types)
    if user:
        cond = cond & (F.col("username") == user)
    if start is not None:
        cond = cond & (F.col("timestamp") >= lit_ts(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= lit_ts(end))
    if severity:
        cond = cond & (F.col("severity") == severity)
    if success is not None:
        cond = cond & (F.col("success") == F.lit(success))
    return audit.where(cond).orderBy(F.col("timestamp").desc(), F.col("id").desc()).offset(offset).limit(limit)
