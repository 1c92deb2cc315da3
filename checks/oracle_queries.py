"""DuckDB oracle SQL per registered query (same names as the catalog)."""

from __future__ import annotations

from checks.oracle import BASE, REF, SCORED, q
from logweave import rules as R

ORACLE: dict[str, str] = {}

def reg(name: str, sql: str, base: bool = True) -> None:
    ORACLE[name] = (BASE + sql) if base else sql


def joined_cols() -> str:
    """The joined view with the analysis columns named as in Spark."""
    return ("(SELECT s.* EXCLUDE (severity_score, explanation, recommendations), "
            "a.severity_score, a.explanation, a.recommendations, a.analyzed_at "
            "FROM scored s LEFT JOIN analysis a ON s.id = a.event_id)")


# relabelled views (FIXTURES.md section 3)
NOTIF = """(SELECT event_id AS id, event_id, 'rule' || CAST(user_id % 4 AS VARCHAR) AS notification_type,
  CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'webhook' ELSE 'slack' END AS channel,
  CASE WHEN event_id % 10 <= 6 THEN 'sent' WHEN event_id % 10 <= 8 THEN 'failed' ELSE 'pending' END AS status,
  ts AS sent_at FROM events)"""
METRICS = """(SELECT event_id AS id, 'src' || CAST(user_id % 5 AS VARCHAR) AS source_name, event_type AS metric_type,
  value AS metric_value, ts AS "timestamp", CASE WHEN event_id % 3 <> 0
  THEN '{"source_name": "src' || CAST(user_id % 5 AS VARCHAR) || '"}' ELSE props END AS metric_metadata FROM events)"""
AUDIT = """(SELECT event_id AS id, event_type,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'user' || CAST(user_id AS VARCHAR) END AS username,
  (['low','medium','high','critical'])[event_id % 4 + 1] AS severity, event_type <> 'error' AS success, ts AS "timestamp"
  FROM events)"""
ACCESS = """(SELECT event_id AS id, user_id % 20 AS client, event_type AS endpoint, value AS duration,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, ts FROM events)"""
SESSIONS = """(SELECT event_id AS session_id, 'user' || CAST(user_id AS VARCHAR) AS username,
  (['admin','analyst','viewer','operator'])[user_id % 4 + 1] AS role, ts AS created_at, ts + INTERVAL 1 HOUR AS expires_at
  FROM events WHERE event_type = 'signup')"""


def last_hours(col: str, hours: int) -> str:
    return f"{col} >= {REF} - INTERVAL {hours} HOUR AND {col} <= {REF}"


# ------------------------------------------------------------------ parsing
reg("parse_syslog", "SELECT id, \"timestamp\", host, process, pid, source, message, category FROM scored WHERE pattern IN ('system','auth')")
reg("parse_console", "SELECT id, \"timestamp\", process, pid, source, message, category FROM scored WHERE pattern = 'console'")
reg("parse_fallback", "SELECT id, pattern, \"timestamp\", source, message, category FROM scored WHERE starts_with(pattern, 'fallback')")
reg("parse_stats", "SELECT raw_log_id, count(*) AS total_lines, count_if(valid) AS parsed_events, count_if(NOT valid) AS failed_lines, "
    + ", ".join(f"count_if(valid AND category = '{c}') AS n_{c}" for c in R.CATEGORIES) + " FROM cat GROUP BY raw_log_id")
reg("parse_rejects", "SELECT raw_log_id, line_no, line FROM cat WHERE NOT valid")
reg("categorize_events", "SELECT pattern, category, count(*) AS n FROM scored GROUP BY pattern, category")
reg("severity_score", "SELECT id, category, keyword_hits, severity_score FROM scored")
reg("explanation", "SELECT id, explanation FROM scored")
reg("recommendations", "SELECT id, array_to_string(recommendations, ' | ') AS recommendations_text, "
    "CAST(len(recommendations) AS INTEGER) AS n_recommendations FROM scored")

# ------------------------------------------------------------ event queries
reg("events_with_analysis", f"SELECT id, category, severity_score, analyzed_at IS NOT NULL AS has_analysis FROM {joined_cols()} j")
reg("events_page", f"""SELECT id, "timestamp", source, category, severity_score, total, total_pages FROM (
  SELECT * FROM {joined_cols()} j WHERE category = 'auth' AND source ILIKE '%sshd%'
  ORDER BY severity_score DESC NULLS LAST, id ASC LIMIT 50 OFFSET 50) p
CROSS JOIN (SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM {joined_cols()} j
  WHERE category = 'auth' AND source ILIKE '%sshd%') t""")
reg("events_keyset", f"""SELECT id, "timestamp", category, severity_score FROM {joined_cols()} j
ORDER BY "timestamp" DESC, id ASC LIMIT 50 OFFSET 100""")
reg("events_keyset_severity", f"""SELECT id, "timestamp", category, severity_score FROM {joined_cols()} j WHERE category = 'auth'
ORDER BY severity_score DESC NULLS LAST, id ASC LIMIT 50 OFFSET 50""")
reg("events_search", f"""SELECT id, message, severity_score FROM {joined_cols()} j
WHERE (contains(lower(message), 'failed') OR contains(lower(source), 'failed') OR contains(lower(category), 'failed'))
  AND coalesce(severity_score, 0) >= 5 AND "timestamp" < TIMESTAMP '2024-01-21 00:00:00'""")
reg("events_min_severity", f"SELECT id, category, severity_score FROM {joined_cols()} j WHERE severity_score >= 7")
reg("event_detail", f"SELECT id, message, category, severity_score, explanation FROM {joined_cols()} j WHERE id = 'rl_5:5'")
reg("original_line", "SELECT s.id, l.line FROM scored s JOIN lines l ON s.raw_log_id = l.raw_log_id AND s.line_no = l.line_no")
reg("recent_export", f"SELECT id, \"timestamp\", source FROM scored WHERE {last_hours('\"timestamp\"', 48)}")
reg("security_export", "SELECT id, process, message FROM scored WHERE " + last_hours('"timestamp"', 720) + " AND ("
    + " OR ".join(f"contains(message, {q(w)})" for w in R.SECURITY_MESSAGE_WORDS)
    + " OR process IN (" + ", ".join(q(p) for p in R.SECURITY_PROCESSES) + "))")
reg("process_export", "SELECT id, message FROM scored WHERE process = 'sshd'")
_THREAT = "(" + " OR ".join(f"contains(lower(message), {q(w)})" for w in R.THREAT_WORDS) + ")"
reg("threat_summary", f"SELECT category, count_if({_THREAT}) AS potential_threat, count_if(NOT {_THREAT}) AS normal FROM scored GROUP BY category")
reg("recent_suspicious", f"""SELECT source_name, id, "timestamp",
  CASE WHEN length(message) > 100 THEN left(message, 100) || '...' ELSE message END AS message_short
FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY "timestamp" DESC, id DESC) AS k FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY "timestamp" DESC, id DESC) AS r FROM scored) x
  WHERE r <= 10 AND {_THREAT}) y) z WHERE k <= 5""")
reg("old_event_analyses", f"""SELECT analysis_id, event_id FROM analysis WHERE event_id IN (
  SELECT id FROM scored WHERE "timestamp" < {REF} - INTERVAL 20 DAY)""")
reg("orphan_analysis", "SELECT analysis_id, event_id FROM analysis WHERE event_id NOT IN (SELECT s.id FROM scored s WHERE s.event_id % 50 <> 0)")
reg("latest_per_category", """SELECT category, rank, id, "timestamp" FROM (
  SELECT category, id, "timestamp", CAST(row_number() OVER (PARTITION BY category ORDER BY "timestamp" DESC, id ASC) AS INTEGER) AS rank
  FROM scored) x WHERE rank <= 3""")

# ------------------------------------------------------------ aggregations
reg("ingestion_stats", "SELECT count(*) AS total_entries, sum(length(line)) AS total_chars, count(DISTINCT source_name) AS unique_sources FROM lines")
reg("top_sources", "SELECT source_name, count(*) AS n FROM lines GROUP BY source_name ORDER BY n DESC, source_name LIMIT 10")
reg("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
              "pages", "benchmark", "labels", "conversations"]), base=False)
reg("coverage", """SELECT count(*) AS total_events, count(a.event_id) AS analyzed_events,
  CASE WHEN count(*) > 0 THEN round(CAST(count(a.event_id) AS DOUBLE) * 100.0 / count(*), 6) ELSE 0.0 END AS coverage_pct
FROM scored s LEFT JOIN analysis a ON s.id = a.event_id""")
reg("realtime_stats", f"""SELECT count(*) AS total_events, count_if({last_hours('"timestamp"', 24)}) AS events_last_24h,
  round(count_if({last_hours('"timestamp"', 24)}) / 24.0, 6) AS events_per_hour, round(avg(value), 6) AS avg_processing_time FROM scored""")
reg("daily_summary", f"""SELECT j.d AS event_date, count(*) AS total_events, count(severity_score) AS analyzed_events, round(avg(severity_score), 6) AS avg_severity,
  count_if(severity_score >= 7) AS high_severity_events, any_value(t.top_category) AS top_category
FROM (SELECT *, CAST("timestamp" AS DATE) AS d FROM {joined_cols()} x) j
JOIN (SELECT d, category AS top_category FROM (
        SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, category ASC) AS r FROM (
          SELECT CAST("timestamp" AS DATE) AS d, category, count(*) AS n FROM scored GROUP BY 1, 2) c0) c1 WHERE r = 1) t
  ON j.d = t.d GROUP BY j.d""")
reg("severity_histogram", """SELECT CAST(b.i AS INTEGER) AS severity_score, coalesce(c.n, 0) AS n FROM range(1, 11) b(i)
LEFT JOIN (SELECT severity_score, count(*) AS n FROM analysis GROUP BY severity_score) c ON b.i = c.severity_score""")
reg("category_counts", "SELECT category, count(*) AS n FROM scored GROUP BY category")
reg("high_severity_count", "SELECT count_if(severity_score >= 7) AS high_severity, count(*) AS analyzed FROM analysis")
reg("top20_report", f"""SELECT id, "timestamp", severity_score, category FROM {joined_cols()} j
WHERE CAST("timestamp" AS DATE) = DATE '2024-01-15' ORDER BY coalesce(severity_score, 0) DESC, "timestamp" ASC, id ASC LIMIT 20""")
reg("top_recommendations", """SELECT recommendation, count(*) AS n FROM (SELECT unnest(recommendations) AS recommendation FROM analysis)
GROUP BY recommendation ORDER BY n DESC, recommendation ASC LIMIT 10""")


def gsets(src: str, dims: list[str], where: str = "TRUE", measure: str | None = None) -> str:
    dim = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims) + " ELSE 'total' END"
    val = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN CAST({d} AS VARCHAR)" for d in dims) + " END"
    m = f", CAST(sum({measure}) AS BIGINT) AS measure" if measure else ""
    sets = ", ".join([f"({d})" for d in dims] + ["()"])
    return f"SELECT {dim} AS dimension, {val} AS value, count(*) AS n{m} FROM {src} x WHERE {where} GROUP BY GROUPING SETS ({sets})"


reg("notification_metrics", gsets(NOTIF, ["status", "channel", "notification_type"], last_hours("sent_at", 720)), base=False)
reg("channel_stats", f"""SELECT channel, count_if(status = 'sent') AS sent, count_if(status = 'failed') AS failed,
  round(count_if(status = 'sent') / greatest(count_if(status = 'sent') + count_if(status = 'failed'), 1), 6) AS success_rate
FROM {NOTIF} x GROUP BY channel""", base=False)
reg("metric_summary", gsets(METRICS, ["source_name", "metric_type"], last_hours('"timestamp"', 168)), base=False)
reg("audit_stats", "SELECT dimension, value, n, measure AS failed, round((n - measure) / n, 6) AS success_rate FROM ("
    + gsets(AUDIT, ["event_type", "severity"], measure="CASE WHEN NOT success THEN 1 ELSE 0 END") + ")", base=False)
reg("audit_top_users", f"SELECT username, count(*) AS n FROM {AUDIT} x WHERE username IS NOT NULL GROUP BY username ORDER BY n DESC, username LIMIT 10", base=False)
reg("endpoint_metrics", f"""SELECT endpoint, count(*) AS requests, count_if(status >= 500) AS errors, round(sum(duration), 6) AS total_time,
  round(avg(duration), 6) AS avg_time FROM {ACCESS} x GROUP BY endpoint""", base=False)
reg("session_roles", f"""SELECT role, count(*) AS active_sessions FROM {SESSIONS} x
WHERE expires_at >= TIMESTAMP '2024-01-15 12:00:00' AND created_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY role""", base=False)
reg("processing_time_stats", f"""SELECT metric_type, count(metric_value) AS n, round(avg(metric_value), 6) AS avg_value,
  min(metric_value) AS min_value, max(metric_value) AS max_value,
  list_sort(list(metric_value))[count(metric_value) // 2 + 1] AS median_value FROM {METRICS} x GROUP BY metric_type""", base=False)
reg("category_severity", "SELECT category, severity_score, count(*) AS n FROM scored GROUP BY category, severity_score")

# ------------------------------------------------------------ alerts
from logweave.plans.catalog import ALERT_RULES, CHANNELS, RESULT_SECONDS, TYPE_SECONDS  # noqa: E402
from logweave.sources.files import ODD_FILES  # noqa: E402


def _rules_sql() -> str:
    def arr(xs):
        return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"
    rows = ", ".join(f"({q(n)}, {str(e).upper()}, {lo}, {hi}, {arr(c)}, {arr(s)}, {arr(ch)}, {t})"
                     for n, e, lo, hi, c, s, ch, t in ALERT_RULES)
    return (f"(SELECT * FROM (VALUES {rows}) r(rule_name, enabled, min_severity, max_severity, categories, sources, "
            "channels, throttle_minutes))")


MATCHES = f"""(SELECT j.*, r.rule_name, r.channels, r.throttle_minutes FROM {joined_cols()} j JOIN {_rules_sql()} r
  ON r.enabled AND r.min_severity <= coalesce(j.severity_score, 5) AND coalesce(j.severity_score, 5) <= r.max_severity
  AND (len(r.categories) = 0 OR list_contains(r.categories, j.category))
  AND (len(r.sources) = 0 OR list_contains(r.sources, j.source)))"""
reg("rule_match", f"SELECT id, rule_name FROM {MATCHES} m")
reg("rule_match_semi", f"SELECT id, category FROM {joined_cols()} j WHERE id IN (SELECT id FROM {MATCHES} m)")
_CH = "(SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {str(e).upper()})" for c, e in CHANNELS) + ") c(channel, enabled))"
reg("channel_fanout", f"""SELECT id, rule_name, channel FROM (SELECT id, rule_name, unnest(channels) AS channel FROM {MATCHES} m) x
WHERE channel IN (SELECT channel FROM {_CH} c WHERE enabled)""")
_LABEL = "CASE WHEN s <= 2 THEN 'Low' WHEN s <= 4 THEN 'Medium' WHEN s <= 6 THEN 'High' WHEN s <= 8 THEN 'Critical' ELSE 'Very Critical' END"
reg("alert_text", f"""SELECT id, 'Security Alert: ' || label || ' - ' || upper(category) AS subject,
  concat_ws(chr(10), 'Security Event Detected', '', 'Timestamp: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' UTC',
    'Source: ' || source, 'Category: ' || upper(category), 'Message: ' || message,
    CASE WHEN severity_score IS NOT NULL THEN concat_ws(chr(10), '', 'AI Analysis:',
      'Severity Score: ' || CAST(severity_score AS VARCHAR) || '/10 (' || label || ')', 'Explanation: ' || explanation, '',
      'Recommendations:', array_to_string(list_transform(recommendations, lambda r, i: CAST(i AS VARCHAR) || '. ' || r), chr(10))) END,
    '', 'Event ID: ' || id, 'Generated by real-time monitoring') AS body
FROM (SELECT *, {_LABEL.replace('s <=', 'coalesce(severity_score, 5) <=')} AS label FROM {MATCHES} m WHERE rule_name = 'kernel_watch') x""")

# ------------------------------------------------------------ detections


def sliding(src: str, key: str, ts: str, window_s: int) -> str:
    """count of same-key rows with time in (t - window, t] (self join oracle)."""
    return f"""(SELECT a.*, (SELECT count(*) FROM {src} b WHERE b.{key} = a.{key}
      AND b.{ts} > a.{ts} - INTERVAL {window_s} SECOND AND b.{ts} <= a.{ts}) AS cnt FROM {src} a)"""


FAILED = """(SELECT *, regexp_extract(message, 'for (\\S+) from', 1) AS account FROM scored WHERE starts_with(message, 'Failed password'))"""
reg("failed_login_window", f"SELECT id, account, cnt AS attempts_in_window, cnt > 1 AS rate_limited FROM {sliding(FAILED, 'account', chr(34) + 'timestamp' + chr(34), 300)} x")
reg("rapid_fire", f"SELECT id, client, cnt AS requests_5m, cnt > 50 AS rapid_fire FROM {sliding(ACCESS, 'client', 'ts', 300)} x", base=False)
ERRS = f"(SELECT *, 0 AS k, severity_score >= 9 AS crit FROM {joined_cols()} j WHERE category IN ('kernel', 'security'))"
reg("error_spike", f"""SELECT id, errors_5m, errors_5m > 20 AS spike, coalesce(critical_5m, 0) AS critical_5m,
  coalesce(critical_5m, 0) > 3 AS critical_spike FROM (
  SELECT a.id, (SELECT count(*) FROM {ERRS} b WHERE b."timestamp" > a."timestamp" - INTERVAL 300 SECOND AND b."timestamp" <= a."timestamp") AS errors_5m,
    CASE WHEN a.crit THEN (SELECT count(*) FROM {ERRS} b WHERE b.crit AND b."timestamp" > a."timestamp" - INTERVAL 300 SECOND
      AND b."timestamp" <= a."timestamp") END AS critical_5m
  FROM {ERRS} a) x""")
reg("error_patterns", """SELECT category || ':' || left(message, 50) AS pattern, count(*) AS occurrences, count(*) >= 5 AS frequent
FROM scored GROUP BY 1 HAVING count(*) >= 3""")

_ERR_TYPES = ["DatabaseError", "ConnectionError", "TimeoutError", "OSError", "ValueError", "RuntimeError", "DatabaseError", "PermissionError"]
_ERR_MSGS = ["database connection lost", "websocket client disconnected", "analysis engine timeout", "network unreachable",
             "config value missing", "none of the handlers answered", "critical database failure", "file permission denied"]
ERRREC = f"""(SELECT event_id AS id, user_id, ([{', '.join(q(x) for x in _ERR_TYPES)}])[event_id % 8 + 1] AS error_type,
  ([{', '.join(q(x) for x in _ERR_MSGS)}])[event_id % 8 + 1] AS message, ts FROM events WHERE event_type = 'error')"""
_C = "lower(message)"
CLASSIFIED = f"""(SELECT *, CASE
    WHEN error_class = 'system_error' OR contains({_C}, 'critical') OR contains({_C}, 'fatal') THEN 'critical'
    WHEN error_class IN ('database_error', 'configuration_error') OR contains({_C}, 'security') OR contains({_C}, 'breach') THEN 'high'
    WHEN error_class IN ('parsing_error', 'analysis_error') OR contains({_C}, 'warning') THEN 'medium'
    WHEN error_class IN ('websocket_error', 'network_error') THEN 'low' ELSE 'medium' END AS error_severity,
  CASE error_class WHEN 'parsing_error' THEN 'fallback' WHEN 'validation_error' THEN 'quarantine' WHEN 'database_error' THEN 'retry'
    WHEN 'websocket_error' THEN 'retry' WHEN 'analysis_error' THEN 'skip' WHEN 'system_error' THEN 'escalate' ELSE 'retry' END AS recovery_action
FROM (SELECT *, CASE WHEN error_type = 'ValidationError' THEN 'validation_error' WHEN error_type = 'ProcessingError' THEN 'parsing_error'
    WHEN error_type = 'BroadcastError' THEN 'websocket_error'
    WHEN contains({_C}, 'database') OR contains({_C}, 'sql') THEN 'database_error'
    WHEN contains({_C}, 'websocket') OR contains({_C}, 'connection') THEN 'websocket_error'
    WHEN contains({_C}, 'analysis') OR contains({_C}, 'ai') THEN 'analysis_error'
    WHEN contains({_C}, 'network') OR contains({_C}, 'timeout') THEN 'network_error'
    WHEN contains({_C}, 'config') OR contains({_C}, 'setting') THEN 'configuration_error' ELSE 'system_error' END AS error_class
  FROM {ERRREC} e) c)"""
reg("error_classify", f"SELECT id, error_class, error_severity, recovery_action FROM {CLASSIFIED} x", base=False)
reg("dominant_error", f"""SELECT day, error_class AS dominant_class, n AS dominant_class_count FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, error_class ASC) AS r FROM (
    SELECT CAST(ts AS DATE) AS day, error_class, count(*) AS n FROM {CLASSIFIED} x GROUP BY 1, 2) a) b WHERE r = 1""", base=False)
reg("error_stats", gsets(CLASSIFIED, ["error_severity", "error_class"]), base=False)

# ------------------------------------------------------------ text
from logweave.functions.sanitize import SANITIZE_PASSES, SUSPICIOUS_PATTERNS  # noqa: E402


def _sanitize_sql(x: str) -> str:
    for pat, fl in SANITIZE_PASSES:
        x = f"regexp_replace({x}, {q(pat)}, '', 'g{fl}')"
    x = f"regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: "
            f"regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '[ \\t]+', ' ', 'g')), lambda l: l <> ''), chr(10))")


reg("sanitize_text", f"SELECT doc_id, length(s) AS sanitized_chars, md5(s) AS sanitized_md5 FROM (SELECT doc_id, {_sanitize_sql('text')} AS s FROM documents) d", base=False)
_REASON = """CASE WHEN text IS NULL OR text = '' THEN 'Log content must be a non-empty string'
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'Log content too short to be meaningful'
  WHEN length(text) > 1000000 THEN 'Log content exceeds maximum size limit (1MB)'
  WHEN contains(text, chr(0)) THEN 'Log content contains null bytes'
  WHEN length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) > length(text) * 0.1
    THEN 'Log content contains excessive control characters' END"""
reg("validate_text", f"SELECT conv_id, turn, reason IS NULL AS is_valid, reason FROM (SELECT conv_id, turn, {_REASON} AS reason FROM conversations) c", base=False)


def _re2(p: str) -> str:
    """Python (?i) prefix -> RE2 inline flag (same syntax)."""
    return p


_SUS = " OR ".join(f"regexp_matches(html, {q(_re2(p))})" for p in SUSPICIOUS_PATTERNS)
reg("entry_verdict", f"""SELECT verdict, count(*) AS n FROM (SELECT CASE
  WHEN html IS NULL OR html = '' OR length(html) > 1048576 THEN 'invalid'
  WHEN list_bool_or(list_transform(string_split(html, chr(10)), lambda l: length(l) > 32768))
    OR regexp_matches(html, '[^\\x20-\\x7E\\t\\n\\r]') THEN 'requires_sanitization'
  WHEN {_SUS} THEN 'suspicious' ELSE 'valid' END AS verdict FROM pages) p GROUP BY verdict""", base=False)

# ------------------------------------------------------------ health, retention
COMP = """(SELECT event_id AS id, 'c' || CAST(user_id % 6 AS VARCHAR) AS component, value AS latency, ts FROM events)"""
LAST10 = f"""(SELECT *, CAST(n - r AS DOUBLE) AS x FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, id DESC) AS r,
  least(count(*) OVER (PARTITION BY component), 10) AS n FROM {COMP} c) a WHERE r <= 10)"""
reg("trend_slope", f"""SELECT component, samples, round(slope, 6) AS slope, CASE WHEN samples < 2 OR slope IS NULL THEN 'stable'
  WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT component, regr_slope(latency, x) AS slope, count(*) AS samples FROM {LAST10} l GROUP BY component) g""", base=False)
reg("trend_half", f"""SELECT component, samples, round(first_avg, 6) AS first_avg, round(second_avg, 6) AS second_avg,
  CASE WHEN samples < 2 OR first_avg = 0 THEN 'stable' WHEN (second_avg - first_avg) / first_avg > 0.05 THEN 'increasing'
  WHEN (second_avg - first_avg) / first_avg < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT component, avg(CASE WHEN x < floor(n / 2) THEN latency END) AS first_avg,
  avg(CASE WHEN x >= floor(n / 2) THEN latency END) AS second_avg, count(*) AS samples FROM {LAST10} l GROUP BY component) g""", base=False)
reg("component_rate", f"""SELECT component, date_trunc('minute', ts) AS minute, count(*) AS events, round(count(*) / 60.0, 6) AS rate_per_s,
  round(avg(latency), 6) AS avg_latency FROM {COMP} c GROUP BY 1, 2""", base=False)
_R = "TIMESTAMP '2024-02-15 00:00:00'"
reg("retention_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count_if(NOT coalesce({c} < {_R} - INTERVAL {d} DAY, false)) AS kept, "
    f"count_if(coalesce({c} < {_R} - INTERVAL {d} DAY, false)) AS deleted FROM {src} x"
    for n, src, c, d in [("processing_metrics", METRICS, '"timestamp"', 30), ("notification_history", NOTIF, "sent_at", 90),
                         ("events", "scored", '"timestamp"', 365)]))
reg("upsert_latest", """SELECT analysis_id, event_id, CASE WHEN event_id IN (SELECT id FROM scored WHERE category = 'kernel')
  THEN analyzed_at + INTERVAL 1 DAY ELSE analyzed_at END AS analyzed_at FROM analysis""")
_ODD_KERNEL = "category = 'kernel' AND event_id % 3 = 0 AND day(event_date) <= 12"
_AS_SECURITY = SCORED.replace("FROM cat WHERE valid", f"FROM (SELECT * REPLACE ('security' AS category) FROM cat WHERE valid AND category = 'kernel' "
                              "AND event_id % 3 = 0 AND day(CAST(event_ts AS DATE)) <= 12) c")
for _a, _b in (("ev AS", "ev2 AS"), ("FROM ev)", "FROM ev2)"), ("h AS (", "h2 AS ("), ("FROM h)", "FROM h2)"), ("s1 AS", "r1 AS"),
               ("FROM s1)", "FROM r1)"), ("s2 AS", "r2 AS"), ("FROM s2", "FROM r2"), ("scored AS", "scored2 AS"),
               ("analysis AS", "analysis2 AS"), ("FROM scored WHERE", "FROM scored2 WHERE")):
    _AS_SECURITY = _AS_SECURITY.replace(_a, _b)
ORACLE["reanalysis"] = BASE + "," + _AS_SECURITY + f"""
SELECT event_id, severity_score, explanation, analyzed_at FROM analysis WHERE event_id NOT IN (SELECT id FROM scored2)
UNION ALL SELECT id, severity_score, explanation, {REF} + INTERVAL 1 DAY FROM scored2"""
reg("reanalysis_found", f"SELECT id, TRUE AS found FROM scored WHERE {_ODD_KERNEL} UNION ALL SELECT 'rl_none:1', FALSE")
reg("report_keep30", """SELECT report_date FROM (SELECT DISTINCT event_date AS report_date FROM scored) r
WHERE report_date NOT IN (SELECT DISTINCT event_date FROM scored ORDER BY 1 DESC LIMIT 30)""")

# ------------------------------------------------------------ streaming
reg("stream_parse", "SELECT category, severity_score, count(*) AS n FROM scored GROUP BY category, severity_score")
reg("stream_spike", """SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS errors, count(*) > 20 AS spike
FROM (SELECT date_trunc('minute', "timestamp") - to_minutes(k) AS window_start, "timestamp" FROM scored, range(0, 5) r(k)
      WHERE category IN ('kernel', 'security')) w
GROUP BY window_start""")
reg("document_lines", """SELECT doc_id, count(*) AS n_lines, max(line_no) AS last_line_no, sum(length(line)) AS chars FROM (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no, regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS parts FROM documents) d) x
WHERE line <> '' GROUP BY doc_id""", base=False)

# ------------------------------------------------------------ throttle (recursive CTE)
ORACLE["alert_throttle"] = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tm AS (SELECT id, rule_name, "timestamp", throttle_minutes, rule_name || '|' || id AS match_id,
        rule_name || ':' || source || ':' || category AS tkey FROM {MATCHES} x),
tg AS (SELECT * FROM tm WHERE throttle_minutes > 0),
tnx AS (SELECT a.match_id, (SELECT b.match_id FROM tg b WHERE b.tkey = a.tkey
         AND b."timestamp" >= a."timestamp" + to_minutes(a.throttle_minutes) ORDER BY b."timestamp", b.match_id LIMIT 1) AS nxt FROM tg a),
troots AS (SELECT match_id FROM (SELECT match_id, row_number() OVER (PARTITION BY tkey ORDER BY "timestamp", match_id) AS r FROM tg) WHERE r = 1),
tchain(match_id) AS (SELECT match_id FROM troots UNION ALL SELECT n.nxt FROM tchain c JOIN tnx n ON n.match_id = c.match_id WHERE n.nxt IS NOT NULL)
SELECT id, rule_name FROM tm WHERE throttle_minutes <= 0 OR match_id IN (SELECT match_id FROM tchain)"""



def throttled_sql(rows: str, out: str) -> str:
    """Sequential throttle over ``rows`` (id, tkey, ts, seconds, free, ...)."""
    return BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tm AS MATERIALIZED ({rows}), tg AS MATERIALIZED (SELECT * FROM tm WHERE NOT free),
tnx AS MATERIALIZED (SELECT a.id, (SELECT b.id FROM tg b WHERE b.tkey = a.tkey AND b.ts >= a.ts + to_seconds(a.seconds)
        ORDER BY b.ts, b.id LIMIT 1) AS nxt FROM tg a),
troots AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY tkey ORDER BY ts, id) AS r FROM tg) WHERE r = 1),
tchain(id) AS (SELECT id FROM troots UNION ALL SELECT n.nxt FROM tchain c JOIN tnx n ON n.id = c.id WHERE n.nxt IS NOT NULL)
SELECT {out} FROM tm WHERE free OR id IN (SELECT id FROM tchain)"""


_SECONDS = "CASE rtype " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in RESULT_SECONDS.items()) + " ELSE 0 END"
_RESULTS = f"""SELECT id, source_name || '_' || rtype AS tkey, "timestamp" AS ts, {_SECONDS} AS seconds, rtype,
  rtype IN ('failure', 'partial_success') AS free FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'failure'
  WHEN event_id % 7 = 0 THEN 'partial_success' WHEN event_id % 5 = 0 THEN 'warning' ELSE 'success' END AS rtype FROM scored) x"""
ORACLE["result_throttle"] = throttled_sql(_RESULTS, "id, rtype AS result_type")
ORACLE["stream_result_throttle"] = throttled_sql(_RESULTS, "id")
_TYPE_S = "CASE category " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in TYPE_SECONDS.items()) + " ELSE 0 END"
ORACLE["type_throttle"] = throttled_sql(
    f'SELECT id, category AS tkey, category, "timestamp" AS ts, {_TYPE_S} AS seconds, {_TYPE_S} = 0 AS free FROM scored', "id, category")
ORACLE["stream_alert_throttle"] = ORACLE["alert_throttle"]
reg("stream_sinks", f"""SELECT 'events' AS table_name, count(*) AS n, count(DISTINCT id) AS ids FROM scored
UNION ALL SELECT 'analysis', count(*), count(DISTINCT id) FROM scored
UNION ALL SELECT 'rule_matches', count(*), count(DISTINCT s.id) FROM scored s JOIN {_rules_sql()} r
  ON r.enabled AND r.min_severity <= s.severity_score AND s.severity_score <= r.max_severity
  AND (len(r.categories) = 0 OR list_contains(r.categories, s.category)) AND (len(r.sources) = 0 OR list_contains(r.sources, s.source))""")

# ------------------------------------------------------------ format detection
from logweave.operators.formats import DELIMITERS, TIMESTAMP_KINDS  # noqa: E402

SAMPLE = "lines"
_KCOLS = ", ".join(f"CAST(sum(len(regexp_extract_all(line, {q(rx)}))) AS BIGINT) AS {k}" for k, rx in TIMESTAMP_KINDS)
_BEST = "greatest(" + ", ".join(k for k, _ in TIMESTAMP_KINDS) + ")"
_BESTNAME = "CASE " + " ".join(f"WHEN {k} = {_BEST} THEN '{k}'" for k, _ in TIMESTAMP_KINDS) + " END"
reg("detect_timestamp", f"""SELECT source_name, sample_lines, CASE WHEN {_BEST} > 0 THEN {_BESTNAME} END AS best_pattern, {_BEST} AS matches,
  CASE WHEN {_BEST} > sample_lines * 0.8 THEN 'high' WHEN {_BEST} > sample_lines * 0.5 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT source_name, count(*) AS sample_lines, {_KCOLS} FROM {SAMPLE} s GROUP BY source_name) g""")
_DN = {d: f"d{i}" for i, d in enumerate(DELIMITERS)}
_DCOLS = ", ".join(f"CAST(sum(length(line) - length(replace(line, {q(d) if d != chr(9) else 'chr(9)'}, ''))) AS BIGINT) AS {_DN[d]}" for d in DELIMITERS)
_NB = [d for d in DELIMITERS if d != " "]
_TOP = "greatest(" + ", ".join(_DN[d] for d in _NB) + ")"
_PRIM = "CASE " + " ".join(f"WHEN {_DN[d]} = {_TOP} THEN {q(d) if d != chr(9) else 'chr(9)'}" for d in _NB) + " END"
reg("detect_delimiter", f"""SELECT source_name, sample_lines, {_PRIM} AS primary_delimiter, {_TOP} AS primary_count,
  {_TOP} > sample_lines * 2 AS structured, {_DN[' ']} AS blank_count
FROM (SELECT source_name, count(*) AS sample_lines, {_DCOLS} FROM {SAMPLE} s GROUP BY source_name) g""")

# ------------------------------------------------------------ queue order
reg("queue_batches", """SELECT entry_id, source_name, priority, queue_rank, CAST(floor((queue_rank - 1) / 100) AS BIGINT) AS batch_no FROM (
  SELECT *, row_number() OVER (ORDER BY priority, "timestamp", entry_id) AS queue_rank FROM (
    SELECT source_name, ts AS "timestamp",
      CASE WHEN user_id % 10 + 1 >= 8 THEN 1 WHEN user_id % 10 + 1 >= 6 THEN 2 WHEN user_id % 10 + 1 >= 4 THEN 3
           WHEN user_id % 10 + 1 >= 2 THEN 4 ELSE 5 END AS priority,
      source_name || '_' || strftime(ts, '%Y%m%d_%H%M%S_%f') || '_' || CAST(line_no AS VARCHAR) AS entry_id FROM lines) e) r""")

# ------------------------------------------------------------ log files
from checks.oracle import CATEGORIZED, PARSED  # noqa: E402

DOC_LINES = """(SELECT doc_id, doc_id % 8 AS bucket, idx, line FROM (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS idx FROM (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b)"""
_ODD = ", ".join(f"({100 + i}, {q(n)})" for i, n in enumerate(ODD_FILES))
# the text a stand-in file holds for a document
_ODD_TEXT = "CASE WHEN name = 'latin.txt' THEN regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') ELSE text END"
_ODD_DOCS = f"""(SELECT bucket, name, doc_id, {_ODD_TEXT} AS text FROM documents JOIN (VALUES {_ODD}) o(bucket, name) ON doc_id % 8 = bucket - 100
  WHERE name <> 'empty.log')"""
reg("file_admission", f"""WITH f AS (SELECT doc_id % 8 AS bucket, 'part.txt' AS name, sum(strlen(text) + 1) AS size_bytes, '' AS head FROM documents GROUP BY 1
  UNION ALL SELECT o.bucket, o.name, coalesce(max(s.size_bytes), 0) + CASE WHEN o.name = 'packed.log' THEN 5 ELSE 0 END,
    CASE WHEN o.name = 'packed.log' THEN '504b0304' ELSE '' END FROM (VALUES {_ODD}) o(bucket, name)
    LEFT JOIN (SELECT bucket, sum(CASE WHEN name = 'latin.txt' THEN length(text) ELSE strlen(text) END + 1) AS size_bytes FROM {_ODD_DOCS} d GROUP BY 1) s
    ON s.bucket = o.bucket GROUP BY o.bucket, o.name),
x AS (SELECT *, CASE WHEN contains(name, '.') THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END AS ext FROM f),
r AS (SELECT *, CASE WHEN size_bytes = 0 THEN 'File is empty' WHEN ext IN ('.exe') THEN 'File type not allowed: ' || ext
  WHEN ext NOT IN ('.log', '.txt', '.out', '.csv', '.json') THEN 'File type not supported'
  WHEN head = '504b0304' THEN 'Binary or compressed files are not allowed' END AS reason FROM x)
SELECT CAST(bucket AS INTEGER) AS bucket, CAST(size_bytes AS BIGINT) AS size_bytes, reason IS NULL AS is_valid, reason FROM r""", base=False)
reg("file_lines", f"""WITH t AS (SELECT bucket, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM {_ODD_DOCS} d
  WHERE name IN ('plain.log', 'latin.txt', 'UPPER.TXT') GROUP BY 1),
p AS (SELECT bucket, string_split(regexp_replace(text, '^[\\s\\x{{85}}\\x{{A0}}]+', ''), chr(10)) AS parts FROM t),
l AS (SELECT bucket, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no, regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') AS line FROM p)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n_lines, max(line_no) AS last_line_no, CAST(sum(length(line)) AS BIGINT) AS chars,
  CAST(sum(CAST('0x' || md5(line)[1:8] AS BIGINT)) AS BIGINT) AS digest FROM l WHERE line <> '' GROUP BY bucket""", base=False)
reg("file_inventory", f"""SELECT CAST(s.bucket AS INTEGER) AS bucket, s.size_bytes, c.line_count, p.preview FROM
  (SELECT doc_id % 8 AS bucket, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1) s
  JOIN (SELECT bucket, count(*) AS line_count FROM {DOC_LINES} d WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1) c ON s.bucket = c.bucket
  JOIN (SELECT bucket, string_agg(line, ' | ' ORDER BY doc_id, idx) AS preview FROM (
          SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, idx) AS k FROM {DOC_LINES} d
          WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '') x WHERE k <= 3 GROUP BY 1) p ON s.bucket = p.bucket""", base=False)
_DLINES = f"""dlines AS (SELECT NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, NULL::VARCHAR AS event_type, NULL::DOUBLE AS value,
  NULL::TIMESTAMP AS ts, CAST(bucket AS VARCHAR) AS raw_log_id, idx AS line_no, NULL::VARCHAR AS source_name, NULL::TIMESTAMP AS ingested_at,
  regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, bucket FROM {DOC_LINES} d WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '')"""
reg("file_ingest", "WITH " + _DLINES + "," + PARSED.replace("FROM lines l", "FROM dlines l") + """
SELECT CAST(raw_log_id AS INTEGER) AS bucket, pattern, valid, count(*) AS n FROM p2 GROUP BY 1, 2, 3""", base=False)

# ------------------------------------------------------------ danger classes
from logweave.functions.sanitize import BOT_WORDS, DANGER_CLASSES, SCRIPT_PATTERNS  # noqa: E402


def _cls(col: str, pats) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({col}), {q(p)}, 'i')" for p in pats) + ")"


_SCRIPT = lambda col: "(" + " OR ".join(f"regexp_matches(lower({col}), {q(p)}, 'is')" for p in SCRIPT_PATTERNS) + ")"
reg("danger_classes", "SELECT role, count(*) AS turns, " + ", ".join(f"count_if({_cls('text', p)}) AS {k}" for k, p in DANGER_CLASSES.items())
    + f", count_if({_SCRIPT('text')}) AS script FROM conversations GROUP BY role", base=False)
reg("page_scripts", f"SELECT page_id, {_SCRIPT('html')} AS script, ("
    + " OR ".join(f"contains(lower(url), {q(w)})" for w in BOT_WORDS) + ") AS bot_like, "
    + ", ".join(f"{_cls('html', p)} AS {k}" for k, p in DANGER_CLASSES.items()) + " FROM pages", base=False)

# ------------------------------------------------------------ fan-out, cascade, expiry
from logweave.plans.catalog import CLIENT_FILTERS  # noqa: E402


def _lst_sql(xs):
    return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"


_CF = "(SELECT * FROM (VALUES " + ", ".join(
    f"({q(c)}, {_lst_sql(t)}, {'NULL' if lo is None else lo}::INTEGER, {'NULL' if hi is None else hi}::INTEGER, {_lst_sql(cs)}, {_lst_sql(ss)})"
    for c, t, lo, hi, cs, ss in CLIENT_FILTERS) + ") f(client_id, event_types, min_priority, max_priority, categories, sources))"
reg("client_fanout", f"""SELECT f.client_id, count(*) AS deliveries FROM
  (SELECT id, category, source, 'security_event' AS event_type, coalesce(severity_score, 5) AS priority FROM {joined_cols()} j) u
  JOIN {_CF} f ON (len(f.event_types) = 0 OR list_contains(f.event_types, u.event_type))
   AND (coalesce(f.min_priority, 0) = 0 OR u.priority >= f.min_priority)
   AND (coalesce(f.max_priority, 0) = 0 OR u.priority <= f.max_priority)
   AND (len(f.categories) = 0 OR list_contains(f.categories, u.category))
   AND (len(f.sources) = 0 OR list_contains(f.sources, u.source))
GROUP BY f.client_id""")
reg("cascade_keep", """SELECT 'events' AS table_name, count(*) AS kept FROM scored WHERE raw_log_id <> 'rl_5'
UNION ALL SELECT 'ai_analysis', count(*) FROM analysis WHERE event_id NOT IN (SELECT id FROM scored WHERE raw_log_id = 'rl_5')""")
reg("session_expiry", f"""SELECT role, count_if(TIMESTAMP '2024-01-15 12:00:00' > expires_at) AS expired,
  count_if(TIMESTAMP '2024-01-15 12:00:00' <= expires_at) AS kept FROM {SESSIONS} s GROUP BY role""", base=False)

# ------------------------------------------------------------ health grade
HOST = """(SELECT event_id AS id, 'c' || CAST(user_id % 6 AS VARCHAR) AS component, ts, least(value / 5.0::DOUBLE, 100.0::DOUBLE) AS cpu_usage,
  least(value / 400.0::DOUBLE, 1.0::DOUBLE) AS memory_usage, CAST(event_id % 100 AS DOUBLE) / 100.0::DOUBLE AS cache_hit_rate,
  CASE WHEN event_type = 'view' THEN user_id * 10 END AS queue_size, CASE WHEN event_type <> 'error' THEN value * 3.0::DOUBLE END AS processing_rate,
  CASE WHEN event_type = 'signup' THEN NULL ELSE event_type IN ('click', 'purchase') END AS batch_enabled FROM events)"""
_SCORE = """least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - cpu_usage / 100.0::DOUBLE) * 0.2::DOUBLE
  + greatest(0.0::DOUBLE, 1.0::DOUBLE - memory_usage) * 0.2::DOUBLE
  + cache_hit_rate * 0.15::DOUBLE + coalesce(greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(queue_size AS DOUBLE) / 10000.0::DOUBLE), 0.8::DOUBLE) * 0.15::DOUBLE
  + coalesce(least(1.0::DOUBLE, processing_rate / 1000.0::DOUBLE), 0.8::DOUBLE) * 0.15::DOUBLE
  + coalesce(CASE WHEN batch_enabled THEN 1.0::DOUBLE WHEN NOT batch_enabled THEN 0.7::DOUBLE END, 0.8::DOUBLE) * 0.15::DOUBLE))"""
reg("health_grade", f"""SELECT id, component, s AS health_score, CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B'
  WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT id, component, CAST({_SCORE} AS DOUBLE) AS s FROM {HOST} h) x""", base=False)
reg("host_averages", f"""SELECT component, count(*) AS samples, round(avg(cpu_usage), 6) AS avg_cpu, round(avg(memory_usage), 6) AS avg_memory,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 6) AS span_minutes FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, id DESC) AS r FROM {HOST} h) x WHERE r <= 10 GROUP BY component""", base=False)

# ------------------------------------------------------------ history / metrics / audit filters
reg("notification_history", f"""SELECT id, notification_type, channel, status, sent_at FROM {NOTIF} x
WHERE notification_type LIKE '%rule1%' AND channel = 'email' AND status = 'failed' ORDER BY sent_at DESC, id DESC LIMIT 100""", base=False)
reg("metrics_for_source", f"""SELECT id, metric_type, metric_value FROM {METRICS} x WHERE {last_hours('"timestamp"', 72)}
  AND json_extract_string(metric_metadata, '$.source_name') = 'src3'""", base=False)
reg("audit_query", f"""SELECT id, event_type, username, "timestamp" FROM {AUDIT} x WHERE event_type IN ('error', 'click')
  AND "timestamp" >= TIMESTAMP '2024-01-08 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-15 00:00:00' AND severity = 'high'
ORDER BY "timestamp" DESC, id DESC LIMIT 20 OFFSET 20""", base=False)

# ------------------------------------------------------------ character / file-name sanitizing
_BAD = "[^\\x20-\\x7E\\t\\n\\r]"
_CHARS = f"regexp_replace(regexp_replace(text, '({_BAD}{{10}}){_BAD}+', '\\1', 'g'), '{_BAD}', '?', 'g')"
_CUT = (f"array_to_string(list_transform(string_split({_CHARS}, chr(10)), lambda l: CASE WHEN length(l) > 32768 "
        "THEN left(l, 32768) || ' [TRUNCATED]' ELSE l END), chr(10))")
reg("char_sanitize", f"SELECT doc_id, length(s) AS sanitized_chars, md5(s) AS sanitized_md5, s <> text AS modified FROM (SELECT doc_id, text, {_CUT} AS s FROM documents) d", base=False)
reg("filename_sanitize", """SELECT page_id, left(CASE WHEN s IN ('', '.', '..') THEN 'sanitized_file' ELSE s END, 255) AS safe_name FROM (
  SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(url, '..', ''), '/', ''), '\\', ''), '[\\x00-\\x1F\\x7F]', '', 'g'),
    '[^a-zA-Z0-9._-]', '_', 'g') AS s FROM pages) p""", base=False)

# ------------------------------------------------------------ event validation
_BLANK = lambda c: f"({c} IS NULL OR regexp_replace({c}, '^\\s+|\\s+$', '', 'g') = '')"
reg("event_validation", f"""SELECT errors, count(*) AS n FROM (SELECT array_to_string(list_filter([
  CASE WHEN {_BLANK('id')} THEN 'Event ID must be a non-empty string' END,
  CASE WHEN {_BLANK('raw_log_id')} THEN 'Raw log ID must be a non-empty string' END,
  CASE WHEN "timestamp" > {REF} + INTERVAL 1 HOUR THEN 'Invalid timestamp: Event timestamp is too far in the future'
       WHEN "timestamp" < {REF} - INTERVAL 3650 DAY THEN 'Invalid timestamp: Event timestamp is too far in the past' END,
  CASE WHEN {_BLANK('source')} THEN 'Invalid source: Source cannot be empty'
       WHEN length(source) > 255 THEN 'Invalid source: Source identifier too long (maximum 255 characters)'
       WHEN NOT regexp_full_match(source, '[a-zA-Z0-9_\\-\\.:]+') THEN
         'Invalid source: Source must contain only alphanumeric characters, underscores, hyphens, dots, and colons' END,
  CASE WHEN {_BLANK('message')} THEN 'Event message must be a non-empty string'
       WHEN length(message) > 10000 THEN 'Event message too long (maximum 10000 characters)' END,
  CASE WHEN lower(category) NOT IN ({', '.join(q(c) for c in R.CATEGORIES)}) THEN
       'Invalid category: Invalid category. Must be one of: {', '.join(R.CATEGORIES)}' END], lambda x: x IS NOT NULL), ' | ') AS errors
  FROM scored) e GROUP BY errors""")
reg("analysis_methods", "SELECT 'rules' AS analysis_method, count(*) AS n FROM scored")

# ------------------------------------------------------------ component / overall status
SNAP = f"""(SELECT component, arg_max(queue_size, {{'t': ts, 'i': id}}) FILTER (WHERE queue_size IS NOT NULL) AS queue_size,
  count_if(processing_rate IS NOT NULL) AS processed, count_if(processing_rate IS NULL) AS errors FROM {HOST} h GROUP BY component)"""
STAT = f"""(SELECT *, queue_size / 1000.0::DOUBLE * 100.0::DOUBLE AS queue_utilization,
  CASE WHEN queue_size / 1000.0::DOUBLE * 100.0::DOUBLE > 90 THEN 'critical' WHEN queue_size / 1000.0::DOUBLE * 100.0::DOUBLE > 70 THEN 'warning'
       WHEN errors > processed * 0.1::DOUBLE THEN 'warning' ELSE 'healthy' END AS status FROM {SNAP} s)"""
reg("component_status", f"SELECT component, queue_size, processed, errors, queue_utilization, status FROM {STAT} x", base=False)
reg("overall_status", f"""SELECT CASE WHEN count(*) = 0 THEN 'unknown' WHEN bool_or(status = 'critical') THEN 'critical'
  WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'unknown' END AS overall_status,
  count(*) AS components FROM {STAT} x""", base=False)
reg("stream_rule_match", f"""SELECT r.rule_name, count(*) AS n FROM scored s JOIN {_rules_sql()} r
  ON r.enabled AND r.min_severity <= s.severity_score AND s.severity_score <= r.max_severity
  AND (len(r.categories) = 0 OR list_contains(r.categories, s.category)) AND (len(r.sources) = 0 OR list_contains(r.sources, s.source))
GROUP BY r.rule_name""")
reg("stream_tail", f"""SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS lines, sum(length(c)) AS chars FROM (
  SELECT bucket, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS c FROM {DOC_LINES} d WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '') x GROUP BY bucket""", base=False)

# ------------------------------------------------------------ recovery recommendations and small reports
from logweave.operators.detect import CLASS_RECOMMENDATIONS  # noqa: E402

_RECENT = f"(SELECT *, event_id_mod3 <> 0 AS recovery_successful FROM (SELECT c.*, c.id % 3 AS event_id_mod3 FROM {CLASSIFIED} c) z ORDER BY ts DESC, id DESC LIMIT 50)"
_RECMAP = "CASE error_class " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CLASS_RECOMMENDATIONS.items()) + " END"
reg("recovery_recommendations", f"""WITH r AS {_RECENT},
t AS (SELECT count(*) AS n, count_if(NOT recovery_successful) AS failed, count_if(error_severity = 'critical') AS critical FROM r),
c AS (SELECT error_class, count(*) AS cnt, min(ts) AS first_ts, arg_min(id, ts) AS first_id FROM r GROUP BY error_class),
cr AS (SELECT list({_RECMAP} ORDER BY first_ts, first_id) AS recs FROM c, t WHERE cnt > n * 0.3 AND {_RECMAP} IS NOT NULL)
SELECT n, array_to_string(CASE WHEN n = 0 THEN ['No recent errors - system appears stable']
  WHEN len(all_recs) = 0 THEN ['System error patterns appear normal'] ELSE all_recs END, ' | ') AS recommendations FROM (
  SELECT n, list_concat(coalesce(recs, []::VARCHAR[]), list_filter([
    CASE WHEN failed > n * 0.4 THEN 'High recovery failure rate - review recovery strategies and system stability' END,
    CASE WHEN critical > 0 THEN 'Critical errors detected - immediate investigation and resolution required' END], lambda x: x IS NOT NULL)) AS all_recs
  FROM t, cr) x""", base=False)
_GRADE = f"CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END"
reg("grade_changes", f"""SELECT component, count(DISTINCT g) AS distinct_grades FROM (
  SELECT component, {_GRADE} AS g, row_number() OVER (PARTITION BY component ORDER BY ts DESC, id DESC) AS r FROM (
    SELECT id, component, ts, CAST({_SCORE} AS DOUBLE) AS s FROM {HOST} h) a) b WHERE r <= 5 GROUP BY component""", base=False)
reg("format_confidence", f"""SELECT confidence, count(*) AS sources FROM (
  SELECT CASE WHEN {_BEST} > sample_lines * 0.8 THEN 'high' WHEN {_BEST} > sample_lines * 0.5 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT source_name, count(*) AS sample_lines, {_KCOLS} FROM {SAMPLE} s GROUP BY source_name) g) x GROUP BY confidence""")
_SUS_T = " OR ".join(f"regexp_matches(text, {q(p)})" for p in SUSPICIOUS_PATTERNS)
reg("validation_outcomes", f"""SELECT verdict, count(*) AS n FROM (SELECT CASE
  WHEN text IS NULL OR text = '' OR length(text) > 1048576 THEN 'invalid'
  WHEN list_bool_or(list_transform(string_split(text, chr(10)), lambda l: length(l) > 32768))
    OR regexp_matches(text, '[^\\x20-\\x7E\\t\\n\\r]') THEN 'requires_sanitization'
  WHEN {_SUS_T} THEN 'suspicious' ELSE 'valid' END AS verdict FROM documents) d GROUP BY verdict""", base=False)
reg("client_queue", f"""SELECT client_id, count(*) AS queued, min("timestamp") AS oldest FROM (
  SELECT f.client_id, u.id, u."timestamp", row_number() OVER (PARTITION BY f.client_id ORDER BY u."timestamp" DESC, u.id DESC) AS r FROM
  (SELECT id, "timestamp", category, source, 'security_event' AS event_type, coalesce(severity_score, 5) AS priority FROM {joined_cols()} j
   WHERE "timestamp" > TIMESTAMP '2024-01-30 11:00:00' AND "timestamp" <= TIMESTAMP '2024-01-30 12:00:00') u
  JOIN {_CF} f ON (len(f.event_types) = 0 OR list_contains(f.event_types, u.event_type))
   AND (coalesce(f.min_priority, 0) = 0 OR u.priority >= f.min_priority) AND (coalesce(f.max_priority, 0) = 0 OR u.priority <= f.max_priority)
   AND (len(f.categories) = 0 OR list_contains(f.categories, u.category)) AND (len(f.sources) = 0 OR list_contains(f.sources, u.source))) x
WHERE r <= 100 GROUP BY client_id""")
reg("notification_events", f"""SELECT s.category, n.status, count(*) AS n FROM {NOTIF} n JOIN scored s ON n.event_id = s.event_id
GROUP BY s.category, n.status""")
_SUS_L = " OR ".join(f"regexp_matches(line, {q(p)})" for p in SUSPICIOUS_PATTERNS)
_VERDICT_L = f"""CASE WHEN line IS NULL OR line = '' OR length(line) > 1048576 THEN 'invalid'
  WHEN length(line) > 32768 OR regexp_matches(line, '[^\\x20-\\x7E\\t\\n\\r]') THEN 'requires_sanitization'
  WHEN {_SUS_L} THEN 'suspicious' ELSE 'valid' END"""
reg("result_types", "WITH " + _DLINES + "," + PARSED.replace("FROM lines l", "FROM dlines l") + f""",
res AS (SELECT *, CASE WHEN NOT valid THEN 'failure' WHEN verdict = 'requires_sanitization' THEN 'warning' ELSE 'success' END AS result_type
        FROM (SELECT valid, {_VERDICT_L} AS verdict FROM p2) a),
res2 AS (SELECT *, CASE WHEN result_type = 'failure' THEN 'high' WHEN result_type IN ('partial_success', 'warning') THEN 'medium'
                        WHEN verdict = 'suspicious' THEN 'medium' ELSE 'low' END AS priority FROM res)
""" + gsets("res2", ["result_type", "priority"]).replace("FROM res2 x", "FROM res2"), base=False)
reg("stream_component_rate", f"""SELECT component, date_trunc('minute', ts) AS minute, count(*) AS events, round(sum(latency) / count(*), 6) AS avg_latency
FROM {COMP} c GROUP BY 1, 2""", base=False)
reg("data_health", f"""SELECT success_rate, size_bytes, inactive, events_per_hour, array_to_string(recs, ' | ') AS recommendations,
  CASE WHEN len(recs) = 0 THEN 'excellent' WHEN len(recs) <= 2 THEN 'good' ELSE 'fair' END AS overall_health FROM (
  SELECT *, list_filter([
    CASE WHEN coalesce(success_rate, 1.0) < 0.9 THEN 'Notification success rate is below 90%. Check notification configuration.' END,
    CASE WHEN size_bytes / 1048576.0 > 1000 THEN 'Database size is ' || printf('%.1f', size_bytes / 1048576.0) || 'MB. Consider running cleanup operations.' END,
    CASE WHEN inactive > 0 THEN 'Found ' || CAST(inactive AS VARCHAR) || ' inactive log sources. Review configuration.' END,
    CASE WHEN events_per_hour > 1000 THEN 'High processing rate detected. Monitor system resources.' END], lambda x: x IS NOT NULL) AS recs
  FROM (SELECT round(count_if(status = 'sent') / count(*), 6) AS success_rate FROM {NOTIF} n WHERE {last_hours('sent_at', 720)}) a,
       (SELECT sum(strlen(line)) AS size_bytes FROM lines) b,
       (SELECT CAST(0 AS BIGINT) AS inactive) c,
       (SELECT round(count_if({last_hours('"timestamp"', 24)}) / 24.0, 6) AS events_per_hour FROM scored) d) x""")
reg("stream_failed_logins", f"""SELECT account, window_start, count(*) AS attempts FROM (
  SELECT account, date_trunc('minute', "timestamp") - to_minutes(k) AS window_start FROM {FAILED} f, range(0, 5) r(k)) w
GROUP BY account, window_start""")


# ------------------------------------------------------------ format registry
from logweave.operators.registry import FIELD_PATTERNS  # noqa: E402

_MSG = "event_type || ' by user' || CAST(user_id AS VARCHAR)"
_APP = "'app' || CAST(user_id % 5 AS VARCHAR)"
_PROC = f"{_APP} || '[' || CAST(user_id + 100 AS VARCHAR) || ']: ' || {_MSG}"
_TAIL = f"' host' || CAST(user_id % 7 AS VARCHAR) || ' ' || {_PROC}"
FLINES = f"""flines AS (SELECT event_id, user_id, event_type, value, ts, 'x' AS raw_log_id, event_id AS line_no,
  'fmt' || CAST(user_id % 40 AS VARCHAR) AS source_name, ts AS ingested_at, CASE user_id % 8
    WHEN 0 THEN strftime(ts, '%b %d %H:%M:%S') || {_TAIL}
    WHEN 1 THEN CASE WHEN event_id % 10 = 0 THEN repeat('x', 300) || ': ' || repeat('tail ', 200) || {_MSG}
                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S ') || {_APP} || ': ' || {_MSG} END
    WHEN 2 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') || {_TAIL}
    WHEN 3 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) || {_TAIL}
    WHEN 4 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) || {_TAIL}
    WHEN 5 THEN strftime(ts, '[%d/%b/%Y:%H:%M:%S +0200] ') || {_PROC}
    WHEN 6 THEN event_type || '|' || {_APP} || '|' || CAST(user_id AS VARCHAR) || '|' || {_MSG}
    ELSE {_MSG} END AS line FROM events)"""
_TS_BODY = {"apache_common": r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})\]"}
_TS_CASE = "CASE best_pattern " + " ".join(f"WHEN {q(k)} THEN {q(_TS_BODY.get(k, rx.replace(chr(92) + 'b', '')))}" for k, rx in TIMESTAMP_KINDS) + " END"


def _fields_sql(src: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT source_name, {q(f)} AS field, line, regexp_extract_all(line, {q(rx)}) AS hits, "
        f"string_split_regex(line, {q(rx)}) AS gaps FROM {src}" for f, rx in FIELD_PATTERNS)
    return f"""(SELECT f.source_name, field, matches, spread, matches >= n * 0.3 AS present,
      matches >= n * 0.3 AND spread < 50 AS consistent FROM (
      SELECT source_name, field, CAST(sum(len(hits)) AS BIGINT) AS matches,
        CAST(max(length(line) - length(gaps[-1]) - length(hits[-1])) - min(length(gaps[1])) AS INTEGER) AS spread
      FROM ({parts}) a WHERE len(hits) > 0 GROUP BY 1, 2) f
      JOIN (SELECT source_name, count(*) AS n FROM {src} GROUP BY 1) t ON f.source_name = t.source_name)"""


def _registry_sql(src: str) -> str:
    quote = "chr(92) || primary_delimiter"
    cell = f"'([^' || {quote} || ']*)'"
    fields = "least(6, length(first_line) - length(replace(first_line, primary_delimiter, '')) + 1)"
    return f"""(WITH k AS (SELECT source_name, count(*) AS sample_lines, {_KCOLS}, {_DCOLS}, arg_min(line, line_no) AS first_line FROM {src} GROUP BY 1),
      fl AS (SELECT source_name, bool_or(field = 'hostname' AND consistent) AS host, bool_or(field = 'process_name' AND present) AS process,
        bool_or(field = 'pid' AND present) AS pid, count_if(present) AS n_present FROM {_fields_sql(src)} x GROUP BY 1),
      d AS (SELECT k.source_name, sample_lines, first_line, CASE WHEN {_BEST} > 0 THEN {_BESTNAME} END AS best_pattern,
        {_BEST} > sample_lines * 0.5 AND {_BEST} <= sample_lines * 0.8 AS ts_medium, {_PRIM} AS primary_delimiter,
        {_TOP} > sample_lines * 2 AS structured, coalesce(host, FALSE) AS host, coalesce(process, FALSE) AS process,
        coalesce(pid, FALSE) AS pid, coalesce(n_present, 0) AS n_present FROM k LEFT JOIN fl ON k.source_name = fl.source_name)
      SELECT source_name, 'detected_' || best_pattern AS format_name, ({_TS_CASE}) || CASE WHEN host THEN '\\s+(\\S+)' ELSE '' END
          || CASE WHEN process THEN '\\s+([^:\\[\\s]+)' ELSE '' END || CASE WHEN pid THEN '(?:\\[(\\d+)\\])?' ELSE '' END || '\\s*:\\s*(.+)' AS regex_pattern,
        best_pattern AS ts_kind, 1 AS g_timestamp, CASE WHEN host THEN 2 END AS g_host, CASE WHEN process THEN 2 + host::INT END AS g_process,
        CASE WHEN pid THEN 2 + host::INT + process::INT END AS g_pid, 2 + host::INT + process::INT + pid::INT AS g_message,
        CASE WHEN ts_medium THEN 'medium' WHEN n_present < 2 THEN 'low' ELSE 'high' END AS confidence, sample_lines AS frequency, 1 AS place
      FROM d WHERE best_pattern IS NOT NULL
      UNION ALL SELECT source_name, 'delimited_' || primary_delimiter, {cell} || repeat({quote} || {cell}, CAST({fields} - 1 AS INT)),
        NULL, NULL, NULL, NULL, NULL, CAST({fields} AS INT), 'medium', sample_lines, 2 FROM d WHERE structured
      UNION ALL SELECT source_name, 'generic_fallback', '(.+)', NULL, NULL, NULL, NULL, NULL, 1, 'low', sample_lines, 3
      FROM d WHERE best_pattern IS NULL AND NOT structured)"""


def _best_sql(src: str, min_lines: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY
      CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, frequency DESC, place) AS r
      FROM {_registry_sql(src)} g WHERE frequency >= {min_lines}) b WHERE r = 1)"""


reg("format_fields", f"WITH {FLINES} SELECT source_name, field, matches, spread, present, consistent FROM {_fields_sql('flines')} x", base=False)
reg("format_registry", f"""WITH {FLINES} SELECT source_name, format_name, regex_pattern, g_timestamp, g_host, g_process, g_pid, g_message,
  confidence, frequency FROM {_registry_sql('flines')} x""", base=False)
reg("top_formats", f"""WITH {FLINES} SELECT format_name, regex_pattern, CAST(sum(frequency) AS BIGINT) AS frequency,
  max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rank FROM {_registry_sql('flines')} x
GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 5""", base=False)


def _grp(g: str) -> str:
    return "CASE " + " ".join(f"WHEN {g} = {i} THEN regexp_extract(line, rx, {i})" for i in range(1, 7)) + " END"


_KIND_TS = f"""CASE ts_kind
  WHEN 'syslog' THEN try_strptime('{REF[11:15]} ' || t, '%Y %b %d %H:%M:%S')
  WHEN 'iso_datetime' THEN try_strptime(t, '%Y-%m-%d %H:%M:%S') WHEN 'us_datetime' THEN try_strptime(t, '%m/%d/%Y %H:%M:%S')
  WHEN 'epoch_seconds' THEN make_timestamp(CAST(t AS BIGINT) * 1000000) WHEN 'epoch_milliseconds' THEN make_timestamp(CAST(t AS BIGINT) * 1000)
  WHEN 'apache_common' THEN try_strptime(left(t, 20), '%d/%b/%Y:%H:%M:%S') - to_minutes(CAST(substr(t, 22, 1) || '1' AS INT)
    * (CAST(substr(t, 23, 2) AS INT) * 60 + CAST(substr(t, 25, 2) AS INT))) END"""
reg("parse_detected", "WITH " + FLINES + "," + PARSED.replace("FROM lines l", "FROM flines l") + f""",
firstday AS (SELECT * FROM flines WHERE ts < TIMESTAMP '2024-01-02'),
lrn AS (SELECT * FROM {_best_sql('firstday', 10)} l), det AS (SELECT * FROM {_best_sql('flines', 1)} l),
fmts AS (SELECT *, 'learned_pattern' AS method FROM lrn
  UNION ALL SELECT *, 'auto_detection' FROM det WHERE source_name NOT IN (SELECT source_name FROM lrn)),
j AS (SELECT p.event_id, p.line, p.source_name, p.valid, p.event_ts AS p_ts, p.source AS p_source, p.message AS p_message, f.*  EXCLUDE (source_name),
  '^(?:' || f.regex_pattern || ')' AS rx FROM p2 p LEFT JOIN fmts f ON p.source_name = f.source_name),
h AS (SELECT *, coalesce(regexp_matches(line, rx), FALSE) AS hit FROM j),
g AS (SELECT *, {_grp('g_timestamp')} AS t, {_grp('g_host')} AS gh, {_grp('g_process')} AS gp, {_grp('g_pid')} AS gi, {_grp('g_message')} AS gm
  FROM h WHERE hit)
SELECT event_id, format_name, method, coalesce({_KIND_TS}, {REF}) AS event_ts,
  CASE WHEN gh IS NOT NULL AND gp IS NOT NULL THEN gh || ':' || gp || CASE WHEN coalesce(gi, '') <> '' THEN '[' || gi || ']' ELSE '' END
    ELSE coalesce(gh, gp, 'unknown') END AS source, trim(gm) AS message FROM g
UNION ALL SELECT event_id, NULL, CASE WHEN valid THEN 'fallback_parser' ELSE 'unparsed' END, CASE WHEN valid THEN p_ts ELSE {REF} END,
  CASE WHEN valid THEN p_source ELSE source_name END,
  CASE WHEN valid THEN p_message WHEN length(line) > 1000 THEN left(line, 1000) || '...' ELSE line END FROM h WHERE NOT hit""", base=False)

import checks.oracle_status  # noqa: E402, F401
