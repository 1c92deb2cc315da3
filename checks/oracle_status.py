"""DuckDB oracle SQL of the status queries."""

from __future__ import annotations

from checks.oracle import q
from checks.oracle_queries import ACCESS, CLASSIFIED, COMP, METRICS, NOTIF, ORACLE, SESSIONS, joined_cols, reg, sliding
from logweave import rules as R
from logweave.functions.sanitize import SOURCE_WORDS
from logweave.operators import status as ST


def _rates(src: str, flags: dict[str, str]) -> str:
    return ("SELECT count(*) AS total, " + ", ".join(
        f"count_if({c}) AS n_{n}, CASE WHEN count(*) > 0 THEN round(count_if({c}) / count(*), 6) ELSE 0.0 END AS {n}_rate"
        for n, c in flags.items()) + f" FROM {src} x")


reg("processing_state", """SELECT count(*) AS total_events, count_if(done) AS realtime_processed, count_if(done AND event_type = 'error') AS pending_notifications,
  round(count_if(done AND ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR) / 24.0, 6) AS processing_rate,
  round(coalesce(avg(CASE WHEN done AND event_id % 7 <> 0 THEN value END), 0.0), 6) AS avg_processing_time
FROM (SELECT *, event_id % 5 <> 0 AS done FROM events) e""", base=False)
reg("notification_rates", _rates(NOTIF, {k: f"status = '{k}'" for k in ("sent", "failed", "pending")}), base=False)
reg("latest_metrics", f"""SELECT id, source_name, metric_type, metric_value, "timestamp" FROM {METRICS} m ORDER BY "timestamp" DESC, id DESC LIMIT 10""", base=False)
_BAD = "event_type = 'error'"
reg("run_outcomes", _rates("events", {"success": f"NOT {_BAD}", "failure": _BAD, "validation_failure": f"{_BAD} AND event_id % 2 = 0",
                                      "sanitization": "event_id % 6 = 0"}), base=False)
reg("request_errors", _rates(ACCESS, {"error": "status >= 500"}), base=False)
reg("error_rates", f"""SELECT *, CASE WHEN attempts > 0 THEN round(recovered / attempts, 6) ELSE 0.0 END AS recovery_success_rate,
  CASE WHEN total > 0 THEN round(critical / total, 6) ELSE 0.0 END AS critical_error_rate FROM (
  SELECT count(*) AS total, count(*) AS attempts, count_if(id % 3 <> 0) AS recovered, count_if(error_severity = 'critical') AS critical
  FROM {CLASSIFIED} c) x""", base=False)
_CLASSES = ["database_error", "websocket_error", "analysis_error", "network_error", "configuration_error", "system_error"]
reg("spike_classes", f"""WITH e AS (SELECT *, list_position({_CLASSES}, error_class) AS k FROM {CLASSIFIED} c),
w AS (SELECT a.id, b.error_class, any_value(b.k) AS k, count(*) AS n FROM e a JOIN e b ON b.ts > a.ts - INTERVAL 43200 SECOND AND b.ts <= a.ts GROUP BY 1, 2)
SELECT id, errors_in_window, error_class AS dominant_class, n AS dominant_count FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY id) AS BIGINT) AS errors_in_window, row_number() OVER (PARTITION BY id ORDER BY n DESC, k) AS r FROM w) x
WHERE r = 1 AND errors_in_window > 5""", base=False)
reg("general_recommendations", f"""SELECT 'Immediate attention required: ' || CAST(count_if(severity_score >= 7) AS VARCHAR) || ' high-severity events detected.' AS recommendation
FROM scored HAVING count_if(severity_score >= 7) > 0 UNION ALL SELECT {q(ST.MANY_EVENTS_LINE)} FROM scored HAVING count(*) > 50""")
reg("delivery_outcomes", f"""SELECT notification_type || '|' || strftime(sent_at, '%Y-%m-%d') AS event_id,
  coalesce(string_agg(DISTINCT CASE WHEN status = 'sent' THEN channel END, ',' ORDER BY CASE WHEN status = 'sent' THEN channel END), '') AS successful_channels,
  coalesce(string_agg(DISTINCT CASE WHEN status = 'failed' THEN channel END, ',' ORDER BY CASE WHEN status = 'failed' THEN channel END), '') AS failed_channels
FROM {NOTIF} n WHERE status <> 'pending' GROUP BY 1""", base=False)
reg("entry_status", f"""SELECT 'entry_' || CAST(user_id AS VARCHAR) AS entry_id, count(*) AS processing_attempts,
  arg_max(NOT {_BAD}, (ts, event_id)) AS last_result, CAST(sum(CASE WHEN {_BAD} THEN event_id % 3 + 1 ELSE 0 END) AS BIGINT) AS total_errors
FROM events GROUP BY 1""", base=False)
reg("diagnostic_history", """SELECT event_id AS run_id, ts, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN 'critical'
    WHEN event_id % 3 = 0 OR event_id % 2 = 0 OR event_id % 4 = 0 THEN 'warning' ELSE 'healthy' END AS overall_status,
  3 AS component_count, CAST(event_id % 4 AS INTEGER) AS recommendations_count,
  concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'parser' END, CASE WHEN event_id % 5 = 0 THEN 'queue' END, CASE WHEN event_id % 11 = 0 THEN 'store' END) AS failed_components
FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""", base=False)
_CE = COMP.replace("FROM events", ", event_type FROM events")
reg("component_metrics", f"""WITH c AS (SELECT * FROM {_CE} c), s AS (SELECT max(ts) AS t1, min(ts) AS t0 FROM c),
l AS (SELECT component, round(avg(latency), 6) AS average_latency FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, id DESC) AS r FROM c WHERE latency IS NOT NULL) x WHERE r <= 100 GROUP BY 1)
SELECT c.component, round(count_if(c.ts > t1 - INTERVAL 60 SECOND) / 60.0, 6) AS processing_rate, any_value(average_latency) AS average_latency,
  round(count_if(event_type = 'error') / greatest(1.0, any_value((epoch_us(t1) - epoch_us(t0)) // 1000000) / 60.0), 6) AS error_rate
FROM c CROSS JOIN s JOIN l ON c.component = l.component GROUP BY 1""", base=False)
reg("violation_steps", f"SELECT id, cnt AS requests_10m, cnt > 5 AS suspicious, cnt > 20 AS blocked FROM {sliding(ACCESS, 'client', 'ts', 600)} x", base=False)
_HOST = """(SELECT event_id AS id, 'c' || CAST(user_id % 6 AS VARCHAR) AS component, ts, least(value / 5, 100.0) AS cpu_usage,
  least(value / 400, 1.0) AS memory_usage, (event_id % 100) / 100.0 AS cache_hit_rate, CASE WHEN event_type = 'view' THEN user_id * 10 END AS queue_size,
  CASE WHEN event_type <> 'error' THEN value * 3 END AS processing_rate,
  CASE WHEN event_type <> 'signup' THEN event_type IN ('click', 'purchase') END AS batch_enabled FROM events)"""


def _trend(v: str) -> str:
    return f"CASE WHEN count(*) < 2 OR regr_slope({v}, -r) IS NULL THEN 'stable' WHEN regr_slope({v}, -r) > 0.1 THEN 'increasing' WHEN regr_slope({v}, -r) < -0.1 THEN 'decreasing' ELSE 'stable' END"


reg("host_trends", f"""SELECT component, {_trend('cpu_usage')} AS cpu_usage_trend, {_trend('memory_usage')} AS memory_usage_trend FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, id DESC) AS r FROM {_HOST} h) x WHERE r <= 10 GROUP BY 1""", base=False)
reg("component_checks", f"""SELECT *, CASE WHEN 'critical' IN (sources, connections, pipeline) THEN 'critical'
  WHEN 'warning' IN (sources, connections, pipeline) THEN 'warning' ELSE 'healthy' END AS worst FROM (
  SELECT component, CASE WHEN hot = 0 THEN 'healthy' WHEN hot < total THEN 'warning' ELSE 'critical' END AS sources,
    CASE WHEN hot > total * 0.1 OR lost > total * 0.2 THEN 'warning' ELSE 'healthy' END AS connections,
    CASE WHEN 100.0 * (total - lost) / total < 80 THEN 'critical' WHEN 100.0 * (total - lost) / total < 95 THEN 'warning'
      WHEN ms > 5000 THEN 'warning' WHEN hot > 100 THEN 'warning' ELSE 'healthy' END AS pipeline FROM (
    SELECT component, count(*) AS total, count_if(cpu_usage > 30) AS hot, count_if(processing_rate IS NULL) AS lost, avg(processing_rate) AS ms
    FROM {_HOST} h GROUP BY 1) a) b""", base=False)
_ADV = [(ST.ADVICE_CPU, "cpu_usage > 80"), (ST.ADVICE_MEMORY, "memory_usage > 0.8"), (ST.ADVICE_CACHE, "cache_hit_rate < 0.7"),
        (ST.ADVICE_BACKPRESSURE, "queue_size > 1400"), (ST.ADVICE_BATCHING, "NOT batch_enabled"), (ST.ADVICE_HANDLES, "memory_usage > 0.9"),
        (ST.ADVICE_BATCH_OPS, "NOT batch_enabled"), (ST.ADVICE_POOL, "cpu_usage / 100 > 0.9")]
_ADV.append((ST.ADVICE_NONE, "NOT (" + " OR ".join(f"coalesce({c}, FALSE)" for _, c in _ADV) + ")"))
reg("performance_advice", " UNION ALL ".join(f"SELECT {q(t)} AS advice, count(*) AS n FROM {_HOST} h WHERE {c} HAVING count(*) > 0" for t, c in _ADV), base=False)
_ISSUE_IF = {"high_memory_usage": "memory_usage * 100", "high_cpu_usage": "cpu_usage", "disk_space_low": "cache_hit_rate * 100"}
reg("resource_issues", " UNION ALL ".join(
    f"SELECT component, {q(n)} AS issue, count(*) AS n, {q('; '.join(r))} AS advice FROM {_HOST} h WHERE {_ISSUE_IF[n]} > {lim} GROUP BY 1"
    for n, lim, r in ST.RESOURCE_ISSUES), base=False)

_SRC = """(SELECT user_id AS source_id, CASE WHEN user_id % 13 = 0 THEN 'source: ' ELSE 'source ' END || CAST(user_id % 120 AS VARCHAR) AS source_name,
  CASE WHEN user_id % 3 = 0 THEN 'file' ELSE 'directory' END AS source_type,
  '/logs/b' || CAST(user_id % 8 AS VARCHAR) || CASE WHEN user_id % 3 = 0 THEN '/x' || CAST(user_id % 5 AS VARCHAR) || '/d' || CAST(user_id AS VARCHAR) || '.log' ELSE '' END AS path,
  CASE WHEN user_id % 15 = 0 THEN '../*' WHEN user_id % 3 = 1 THEN 'd*' || CAST(user_id % 10 AS VARCHAR) || '.[lt]??' END AS file_pattern,
  user_id % 2 = 0 AS recursive, user_id % 6 <> 0 AS enabled,
  CASE user_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'paused' ELSE 'active' END AS status FROM (SELECT DISTINCT user_id FROM events) u)"""
reg("source_errors", f"""SELECT source_id, concat_ws('; ',
  CASE WHEN source_id % 13 = 0 THEN 'Source name can only contain letters, numbers, spaces, hyphens, and underscores' END,
  CASE WHEN contains(file_pattern, '..') OR contains(file_pattern, '/') THEN 'File pattern cannot contain ''..'' or ''/''' END,
  CASE WHEN source_id % 17 = 0 THEN 'Tags can only contain letters, numbers, hyphens, and underscores' END,
  CASE WHEN source_type = 'file' AND file_pattern IS NOT NULL THEN 'File pattern can only be specified for directory sources' END,
  CASE WHEN source_type = 'file' AND recursive THEN 'Recursive monitoring can only be enabled for directory sources' END) AS errors,
  'prod,web,t' || CASE WHEN source_id % 17 = 0 THEN '#' ELSE '-' END || CAST(source_id % 4 AS VARCHAR) AS tags FROM {_SRC} s""", base=False)
reg("source_repeats", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c} AS value, {q(t)} AS issue, count(*) AS n FROM {_SRC} s GROUP BY {c} HAVING count(*) > 1"
    for c, t in (("source_name", "Duplicate log source names found"), ("path", "Duplicate log source paths found"))), base=False)
reg("source_rollup", f"""SELECT count(*) AS total_sources, count_if(status = 'active') AS active_sources, count_if(status = 'error') AS error_sources,
  count_if(status = 'paused') AS inactive_sources FROM {_SRC} s WHERE enabled""", base=False)
reg("sources_by_name", f"SELECT source_name, source_id, path, enabled, status FROM {_SRC} s ORDER BY 1, 2", base=False)
reg("file_sources", f"""WITH f AS (SELECT '/logs/b' || CAST(doc_id % 8 AS VARCHAR) || '/x' || CAST(doc_id % 5 AS VARCHAR) || '/d' || CAST(doc_id AS VARCHAR)
    || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.log' END AS path FROM documents)
SELECT DISTINCT f.path, s.source_name FROM f JOIN {_SRC} s ON (s.source_type = 'file' AND s.path = f.path)
  OR (s.source_type = 'directory' AND starts_with(f.path, s.path || '/') AND (s.file_pattern IS NULL OR string_split(f.path, '/')[-1] GLOB s.file_pattern))""", base=False)
_SAN = "regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), '[<>\"'';\\\\]', '', 'g')"
for _w in SOURCE_WORDS:
    _SAN = f"regexp_replace({_SAN}, '\\b{_w}\\b', '', 'gi')"
_SAN = f"regexp_replace(regexp_replace({_SAN}, '--.*$', '', 'g'), '/\\*.*?\\*/', '', 'gs')"
_SAN = f"trim(regexp_replace(left({_SAN}, 255), '\\s+', ' ', 'g'))"
reg("source_sanitize", f"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'unknown_source' WHEN s = '' THEN 'sanitized_source' ELSE s END AS source
FROM (SELECT conv_id, turn, text, {_SAN} AS s FROM conversations) c""", base=False)
_TR = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_RT = _TR.format("r")
reg("analysis_validation", f"""SELECT conv_id, turn, concat_ws('; ', CASE WHEN turn % 5 = 4 THEN 'Analysis ID must be a non-empty string' END,
  CASE WHEN (conv_id + turn) % 13 NOT BETWEEN 1 AND 10 THEN 'Invalid severity score: Severity score must be between 1 and 10' END,
  CASE WHEN coalesce({_TR.format('text')}, '') = '' THEN 'Explanation cannot be empty' WHEN length({_TR.format('text')}) < 10 THEN 'Explanation too short (minimum 10 characters)'
    WHEN length(text) > 5000 THEN 'Explanation too long (maximum 5000 characters)' END,
  'Invalid recommendations: ' || CASE WHEN recs IS NULL THEN 'At least one recommendation is required' WHEN len(recs) > 10 THEN 'Too many recommendations (maximum 10)'
    ELSE list_filter(list_transform(recs, lambda r, i: 'Recommendation ' || CAST(i AS VARCHAR) || CASE WHEN {_RT} = '' THEN ' cannot be empty'
      WHEN length({_RT}) < 5 THEN ' is too short (minimum 5 characters)' WHEN length(r) > 500 THEN ' is too long (maximum 500 characters)' END), lambda x: x IS NOT NULL)[1] END) AS errors
FROM (SELECT *, string_split(text, '. ') AS recs FROM conversations) c""", base=False)
reg("orphan_notifications", f"""SELECT id, event_id, channel FROM {NOTIF} n WHERE event_id NOT IN (SELECT event_id FROM scored WHERE category <> 'kernel')""")
reg("nested_events", f"""SELECT id, analyzed_at IS NOT NULL AS analyzed, severity_score, CAST(len(recommendations) AS INTEGER) AS n_recommendations
FROM {joined_cols()} j""")

reg("raw_log_store", """SELECT source, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 7 AS INTEGER)) AS DATE) AS created_date, count(*) AS n,
  count(*) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2""", base=False)
reg("outcome_log", f"""SELECT CAST(sent_at AS DATE) AS row_date, count(*) AS outcomes, count_if(status = 'failed') AS failed, count(*) AS audit_rows
FROM {NOTIF} n GROUP BY 1""", base=False)
ORACLE["security_export_files"] = ORACLE["security_export"].replace("SELECT id, process, message FROM scored", "SELECT id, process, message, CAST(length(id || ' ' || message) AS INTEGER) AS line_chars FROM scored")


def _left(name: str, src: str, ts: str, days: int) -> str:
    return (f"SELECT '{name}' AS table_name, count(*) AS kept, count(DISTINCT CAST({ts} AS DATE)) AS days_left FROM {src} x "
            f"WHERE NOT ({ts} < TIMESTAMP '2024-01-31' - INTERVAL {days} DAY - INTERVAL 5 HOUR)")


reg("retention_apply", " UNION ALL ".join([
    _left("processing_metrics", METRICS, '"timestamp"', 20), _left("notification_history", NOTIF, "sent_at", 25),
    _left("events", "scored", '"timestamp"', 28),
    _left("ai_analysis", '(SELECT s."timestamp" FROM scored s JOIN analysis a ON s.id = a.event_id)', '"timestamp"', 28)]))
reg("cascade_apply", """SELECT 'events' AS table_name, raw_log_id, count(*) AS n FROM scored WHERE raw_log_id <> 'rl_5' GROUP BY 2
UNION ALL SELECT 'ai_analysis', split_part(event_id, ':', 1), count(*) FROM analysis WHERE split_part(event_id, ':', 1) <> 'rl_5' GROUP BY 2""")
reg("session_cleanup", f"""SELECT role, count(*) AS sessions, min(created_at) AS oldest FROM {SESSIONS} s
WHERE expires_at >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""", base=False)

reg("stream_side_outputs", f"SELECT id, error_class, error_severity, recovery_action FROM {CLASSIFIED} x", base=False)
reg("stream_unique_entries", """SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d %H') AS entry_id,
  max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1""", base=False)
reg("stream_late_rows", """SELECT CAST(ts AS DATE) AS day, day(ts) BETWEEN 11 AND 20
  AND ts < (SELECT max(ts) FROM events WHERE day(ts) > 20) - INTERVAL 10 MINUTE AS late, count(*) AS n FROM events GROUP BY 1, 2""", base=False)

reg("scorer_prompts", f"""SELECT id, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5 FROM (
  SELECT id, {q(R.PROMPT_HEAD)} || '- Timestamp: ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime("timestamp", '%f') <> '000000'
    THEN strftime("timestamp", '.%f') ELSE '' END || chr(10) || '- Source: ' || source || chr(10) || '- Category: ' || category || chr(10)
    || '- Message: ' || message || {q(R.PROMPT_TAIL)} AS p FROM scored) x""")

_N = "CAST(split_part(id, ':', -1) AS BIGINT)"
reg("scored_outside", f"""SELECT id, CASE WHEN n % 5 IN (0, 1) THEN 'scorer' ELSE 'rules' END AS analysis_method,
  CAST(CASE WHEN n % 5 > 1 THEN severity_score WHEN n % 13 BETWEEN 1 AND 10 THEN n % 13 ELSE 5 END AS INTEGER) AS severity_score,
  CASE n % 5 WHEN 0 THEN 'scored outside by number' WHEN 1 THEN 'AI analysis completed for ' || category || ' event' ELSE explanation END AS explanation,
  CAST(CASE WHEN n % 5 IN (0, 1) THEN 2 ELSE len(recommendations) END AS INTEGER) AS n_recommendations
FROM (SELECT *, {_N} AS n FROM scored) x""")

# ------------------------------------------------------------ upkeep
from checks.oracle_queries import _ODD_DOCS  # noqa: E402
from logweave.plans.upkeep_queries import OWN_STRATEGIES, SAMPLE_LABELS  # noqa: E402

_WS = "'^\\s+|\\s+$', '', 'g'"
reg("pasted_texts", f"""WITH t AS (SELECT DISTINCT role, text FROM conversations),
l AS (SELECT role, text, regexp_replace(unnest(string_split(regexp_replace(text, {_WS}), chr(10))), {_WS}) AS line FROM t)
SELECT role AS source_label, count(DISTINCT text) AS raw_logs, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars
FROM l WHERE line <> '' GROUP BY role""", base=False)
_LABELS = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in SAMPLE_LABELS)
reg("sample_logs", f"""SELECT l.*, CAST(s.size_bytes AS BIGINT) AS size_bytes, s.name IS NOT NULL AS found FROM (VALUES {_LABELS}) l(file_name, source, description)
LEFT JOIN (SELECT name, sum(CASE WHEN name = 'latin.txt' THEN length(text) ELSE strlen(text) END + 1) AS size_bytes FROM {_ODD_DOCS} d
  GROUP BY 1) s ON s.name = l.file_name""", base=False)
reg("error_recovery_custom", "SELECT id, error_class, CASE error_class " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in OWN_STRATEGIES)
    + f" ELSE recovery_action END AS recovery_action FROM {CLASSIFIED} c", base=False)
reg("run_times", f"""SELECT 'entry_' || CAST(user_id AS VARCHAR) AS entry_id, count(*) AS runs, round(avg(value), 6) AS avg_seconds,
  min(value) AS min_seconds, max(value) AS max_seconds, round(count_if(NOT {_BAD}) / count(*), 6) AS success_rate,
  CASE WHEN count_if(NOT {_BAD}) > 0 THEN round(count_if(NOT {_BAD} AND event_id % 6 <> 0) / count_if(NOT {_BAD}), 6) END AS push_rate
FROM events GROUP BY 1""", base=False)
reg("cascade_all", """SELECT 'events' AS table_name, count(*) AS kept FROM scored WHERE raw_log_id <> 'rl_5'
UNION ALL SELECT 'ai_analysis', count(*) FROM analysis WHERE split_part(event_id, ':', 1) <> 'rl_5'
UNION ALL SELECT 'raw_logs', count(DISTINCT event_id % 97) FROM events WHERE event_id % 97 <> 5""")
reg("entry_cleanup", f"""SELECT status, count(*) AS n, min(ts) AS oldest FROM (
  SELECT ts, CASE WHEN event_id % 9 = 0 THEN 'failed' WHEN event_id % 4 = 0 THEN 'pending' ELSE 'completed' END AS status,
    ts + to_minutes(event_id % 120) AS done FROM events) e
WHERE status = 'pending' OR done >= TIMESTAMP '2024-01-19 00:00:00' GROUP BY 1
UNION ALL SELECT 'history', count(*), min(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'""", base=False)
reg("line_times", 'SELECT event_id, "timestamp" AS found FROM scored')
reg("severity_labels", """SELECT CASE WHEN severity_score >= 9 THEN 'Critical' WHEN severity_score >= 7 THEN 'High' WHEN severity_score >= 5 THEN 'Medium'
  WHEN severity_score >= 3 THEN 'Low' ELSE 'Info' END AS label, count(*) AS n, min(severity_score) AS low, max(severity_score) AS high FROM scored GROUP BY 1""")
reg("decoded_recommendations", """SELECT id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE len(recommendations) END AS INTEGER) AS n,
  recommendations[1] AS first FROM scored""")
reg("changed_keys", """SELECT event_id, CASE WHEN event_id % 3 <> event_id % 2 THEN 'level,' ELSE '' END || 'user,zone' AS changed FROM events""", base=False)
