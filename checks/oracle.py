"""DuckDB SQL oracles for the registered queries.

The driver tables are pre-registered as views. These builders write the same
log-line rendering, parse cascade, category and rule scoring as plain DuckDB
SQL (RE2 regexes, ``regexp_matches`` for whole words, ``try_cast`` for
calendar checks) so every query can be checked against an independent
formulation. Only the fixed values (patterns, keyword lists, texts) are
shared with the library, through ``logweave.rules``.
"""

from __future__ import annotations

from logweave import rules as R

REF = "TIMESTAMP '2024-01-31 00:00:00'"
REF_YEAR = R.REF_TS.year
MONTHS_LIST = "[" + ", ".join(f"'{m}'" for m in R.MONTHS) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ lines
LINES = f"""
lines AS (
  SELECT event_id, user_id, event_type, value, ts,
         'rl_' || CAST(event_id % 97 AS VARCHAR) AS raw_log_id,
         event_id AS line_no,
         'src' || CAST(user_id % 5 AS VARCHAR) AS source_name,
         ts AS ingested_at,
         CASE
           WHEN event_type = 'signup' AND value >= 100 THEN
             strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 7 AS VARCHAR) || ' sshd[' || CAST(user_id + 1000 AS VARCHAR)
             || ']: Failed password for user' || CAST(user_id AS VARCHAR) || ' from 10.0.' || CAST(event_id % 256 AS VARCHAR) || '.'
             || CAST(user_id % 256 AS VARCHAR) || ' port 22 ssh2'
           WHEN event_type = 'signup' THEN
             strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 7 AS VARCHAR) || ' sshd[' || CAST(user_id + 1000 AS VARCHAR)
             || ']: Accepted publickey for user' || CAST(user_id AS VARCHAR) || ' from 10.0.' || CAST(event_id % 256 AS VARCHAR) || '.'
             || CAST(user_id % 256 AS VARCHAR)
           WHEN event_type = 'error' AND event_id % 2 = 0 THEN
             strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 7 AS VARCHAR) || ' kernel[0]: Memory pressure warning panic'
           WHEN event_type = 'error' THEN
             strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 7 AS VARCHAR) || ' securityd[' || CAST(user_id + 1000 AS VARCHAR)
             || ']: Malware attack signature detected'
           WHEN event_type = 'click' THEN
             strftime(ts, '%H:%M:%S.%f') || '+0200 loginwindow[' || CAST(user_id + 1000 AS VARCHAR) || '] User session started'
           WHEN event_type = 'view' AND event_id % 10 = 0 THEN
             strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 7 AS VARCHAR) || ' link state changed'
           WHEN event_type = 'view' THEN
             strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 7 AS VARCHAR) || ' networkd[' || CAST(user_id + 1000 AS VARCHAR)
             || ']: Firewall blocked connection from 10.0.' || CAST(event_id % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR)
           ELSE
             strftime(ts, '%Y-%m-%d %H:%M:%S') || ' app' || CAST(user_id % 5 AS VARCHAR) || ': ERROR database connection timeout exception'
         END AS line
  FROM events
)"""


# ------------------------------------------------------------------ parse
def _ts_parts(y, mo, d, h, mi, s) -> str:
    return (f"CASE WHEN CAST({s} AS INTEGER) < 60 THEN try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', "
            f"CAST({y} AS INTEGER), CAST({mo} AS INTEGER), CAST({d} AS INTEGER), CAST({h} AS INTEGER), "
            f"CAST({mi} AS INTEGER), CAST({s} AS INTEGER)) AS TIMESTAMP) END")


def _syslog_ts(st: str) -> str:
    mo = f"list_position({MONTHS_LIST}, {st}.mon)"
    this_year = _ts_parts(REF_YEAR, mo, f"{st}.d", f"{st}.h", f"{st}.mi", f"{st}.s")
    prev_year = _ts_parts(REF_YEAR - 1, mo, f"{st}.d", f"{st}.h", f"{st}.mi", f"{st}.s")
    return f"(CASE WHEN {this_year} > {REF} + INTERVAL 1 DAY THEN {prev_year} ELSE {this_year} END)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _valid(ts: str, src: str, msg: str) -> str:
    return (f"(coalesce({ts} <= {REF} + INTERVAL 6 HOUR, false) AND length({src}) BETWEEN 1 AND 255 "
            f"AND coalesce({_strip(msg)} <> '', false))")


_SYS = "((\\w{3})\\s+(\\d{1,2})\\s+(\\d{2}):(\\d{2}):(\\d{2}))"
SYS_NAMES = "['ts','mon','d','h','mi','s','host','proc','pid','msg']"
RX_SYSTEM = "^" + _SYS + "\\s+(\\S+)\\s+([^:]+?)(?:\\[(\\d+)\\])?\\s*:\\s*(.+)$"
RX_AUTH = "^" + _SYS + "\\s+(\\S+)\\s+(\\w+)(?:\\[(\\d+)\\])?\\s*:\\s*(.+)$"
RX_CONSOLE = "^((\\d{2}):(\\d{2}):(\\d{2})\\.(\\d{6})([+-])(\\d{2})(\\d{2}))\\s+(\\w+)(?:\\[(\\d+)\\])?\\s*(.+)$"
CON_NAMES = "['ts','h','mi','s','us','sign','tzh','tzm','proc','pid','msg']"
RX_GENERIC = "^" + _SYS + "\\s+(\\S+)\\s+(.+)$"
GEN_NAMES = "['ts','mon','d','h','mi','s','host','msg']"
RX_ISO = "^(.*?)((\\d{4})-(\\d{2})-(\\d{2})\\s+(\\d{2}):(\\d{2}):(\\d{2}))(.*)$"
ISO_NAMES = "['pre','hit','y','mo','d','h','mi','s','rest']"
RX_US = "^(.*?)((\\d{2})/(\\d{2})/(\\d{4})\\s+(\\d{2}):(\\d{2}):(\\d{2}))(.*)$"
US_NAMES = "['pre','hit','mo','d','y','h','mi','s','rest']"
RX_SYS_SEARCH = "^(.*?)" + _SYS + "(.*)$"
SYSS_NAMES = "['pre','hit','mon','d','h','mi','s','rest']"


def _con_ts(st: str) -> str:
    local = (f"(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d.%06d', {REF_YEAR}, {R.REF_TS.month}, {R.REF_TS.day}, "
             f"CAST({st}.h AS INTEGER), CAST({st}.mi AS INTEGER), CAST({st}.s AS INTEGER), CAST({st}.us AS INTEGER)) AS TIMESTAMP))")
    local = f"(CASE WHEN CAST({st}.s AS INTEGER) < 60 THEN {local} END)"
    off = f"((CASE WHEN {st}.sign = '-' THEN -1 ELSE 1 END) * (CAST({st}.tzh AS INTEGER) * 60 + CAST({st}.tzm AS INTEGER)))"
    utc = f"({local} - to_minutes({off}))"
    return f"(CASE WHEN {utc} > {REF} + INTERVAL 2 HOUR THEN {utc} - INTERVAL 1 DAY ELSE {utc} END)"


PARSED = f"""
m AS (
  SELECT l.*,
    CASE WHEN regexp_full_match(line, '{RX_SYSTEM}') THEN regexp_extract(line, '{RX_SYSTEM}', {SYS_NAMES}) END AS gs,
    CASE WHEN regexp_full_match(line, '{RX_AUTH}') THEN regexp_extract(line, '{RX_AUTH}', {SYS_NAMES}) END AS ga,
    CASE WHEN regexp_full_match(line, '{RX_CONSOLE}') THEN regexp_extract(line, '{RX_CONSOLE}', {CON_NAMES}) END AS gc,
    CASE WHEN regexp_full_match(line, '{RX_GENERIC}') THEN regexp_extract(line, '{RX_GENERIC}', {GEN_NAMES}) END AS gg,
    CASE WHEN regexp_full_match(line, '{RX_ISO}') THEN regexp_extract(line, '{RX_ISO}', {ISO_NAMES}) END AS fi,
    CASE WHEN regexp_full_match(line, '{RX_US}') THEN regexp_extract(line, '{RX_US}', {US_NAMES}) END AS fu,
    CASE WHEN regexp_full_match(line, '{RX_SYS_SEARCH}') THEN regexp_extract(line, '{RX_SYS_SEARCH}', {SYSS_NAMES}) END AS fs
  FROM lines l
),
c AS (
  SELECT *,
    {_syslog_ts('gs')} AS ts_s, gs.host || ':' || gs.proc || CASE WHEN gs.pid <> '' THEN '[' || gs.pid || ']' ELSE '' END AS src_s,
    {_syslog_ts('ga')} AS ts_a, ga.host || ':' || ga.proc || CASE WHEN ga.pid <> '' THEN '[' || ga.pid || ']' ELSE '' END AS src_a,
    {_con_ts('gc')} AS ts_c, gc.proc || CASE WHEN gc.pid <> '' THEN '[' || gc.pid || ']' ELSE '' END AS src_c,
    {_syslog_ts('gg')} AS ts_g,
    {_ts_parts('fi.y', 'fi.mo', 'fi.d', 'fi.h', 'fi.mi', 'fi.s')} AS ts_fi,
    {_ts_parts('fu.y', 'fu.mo', 'fu.d', 'fu.h', 'fu.mi', 'fu.s')} AS ts_fu,
    {_syslog_ts('fs')} AS ts_fs
  FROM m
),
v AS (
  SELECT *,
    gs IS NOT NULL AND {_valid('ts_s', 'src_s', 'gs.msg')} AS ok_s,
    ga IS NOT NULL AND {_valid('ts_a', 'src_a', 'ga.msg')} AS ok_a,
    gc IS NOT NULL AND {_valid('ts_c', 'src_c', 'gc.msg')} AS ok_c,
    gg IS NOT NULL AND {_valid('ts_g', 'gg.host', 'gg.msg')} AS ok_g,
    coalesce(ts_fi, ts_fu, ts_fs) AS ts_f,
    CASE WHEN ts_fi IS NOT NULL THEN fi.rest WHEN ts_fu IS NOT NULL THEN fu.rest WHEN ts_fs IS NOT NULL THEN fs.rest END AS rest0
  FROM c
),
f AS (
  SELECT *, coalesce(nullif({_strip('rest0')}, ''), line) AS rest FROM v
),
f2 AS (
  SELECT *,
    CASE WHEN regexp_full_match(rest, '^(\\S+):\\s*(.+)$') THEN regexp_extract(rest, '^(\\S+):\\s*(.+)$', ['src','msg']) END AS fc,
    CASE WHEN regexp_full_match(rest, '^(\\S+)\\s+(.+)$') THEN regexp_extract(rest, '^(\\S+)\\s+(.+)$', ['src','msg']) END AS fp
  FROM f
),
p AS (
  SELECT event_id, user_id, event_type, value, ts, raw_log_id, line_no, source_name, ingested_at, line,
    CASE WHEN ok_s THEN 'system' WHEN ok_a THEN 'auth' WHEN ok_c THEN 'console' WHEN ok_g THEN 'generic'
         WHEN ts_f IS NULL THEN 'fallback_now' ELSE 'fallback_ts' END AS pattern,
    CASE WHEN ok_s THEN ts_s WHEN ok_a THEN ts_a WHEN ok_c THEN ts_c WHEN ok_g THEN ts_g ELSE coalesce(ts_f, {REF}) END AS event_ts,
    CASE WHEN ok_s THEN src_s WHEN ok_a THEN src_a WHEN ok_c THEN src_c WHEN ok_g THEN gg.host
         ELSE coalesce(fc.src, fp.src, 'unknown') END AS source,
    CASE WHEN ok_s THEN gs.msg WHEN ok_a THEN ga.msg WHEN ok_c THEN gc.msg WHEN ok_g THEN gg.msg
         ELSE coalesce(fc.msg, fp.msg, rest) END AS raw_message,
    CASE WHEN ok_s THEN gs.host WHEN ok_a THEN ga.host WHEN ok_g THEN gg.host END AS host,
    CASE WHEN ok_s THEN gs.proc WHEN ok_a THEN ga.proc WHEN ok_c THEN gc.proc END AS process,
    nullif(CASE WHEN ok_s THEN gs.pid WHEN ok_a THEN ga.pid WHEN ok_c THEN gc.pid END, '') AS pid,
    ok_s OR ok_a OR ok_c OR ok_g AS ok_pattern
  FROM f2
),
p2 AS (
  SELECT *,
    {_strip("regexp_replace(raw_message, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')")} AS message,
    ok_pattern OR {_valid('event_ts', 'source', 'raw_message')} AS valid,
    lower(source) AS src_l,
    lower(raw_message) || ' ' || lower(source) AS cat_text
  FROM p
)"""


def _cat_score(cat: str) -> str:
    terms = []
    for kw in R.CATEGORY_KEYWORDS[cat]:
        terms.append(
            f"(length(cat_text) - length(replace(cat_text, '{kw}', ''))) // {len(kw)}"
            f" + CASE WHEN regexp_matches(cat_text, '\\b{kw}\\b') THEN {R.WORD_BONUS} ELSE 0 END"
            f" + CASE WHEN contains(src_l, '{kw}') THEN {R.SOURCE_BONUS} ELSE 0 END")
    return "(" + "\n      + ".join(terms) + ")"


_CATS = list(R.CATEGORY_KEYWORDS)
CATEGORIZED = (
    "\ncs AS (\n  SELECT *,\n    "
    + ",\n    ".join(f"{_cat_score(c)} AS sc_{c}" for c in _CATS)
    + "\n  FROM p2\n),\ncat AS (\n  SELECT *, CASE WHEN contains(src_l, 'kernel') AND contains(src_l, '[0]') THEN 'kernel'"
    + f" WHEN greatest({', '.join('sc_' + c for c in _CATS)}) <= 0 THEN 'unknown' "
    + " ".join(f"WHEN sc_{c} = greatest({', '.join('sc_' + x for x in _CATS)}) THEN '{c}'" for c in _CATS)
    + " ELSE 'unknown' END AS category\n  FROM cs\n)"
)


def _hits() -> str:
    parts = []
    for cat, (kws, _b, _m) in R.SEVERITY_RULES.items():
        if not kws:
            continue
        s = " + ".join(f"CASE WHEN contains(lower(message), '{k}') THEN 1 ELSE 0 END" for k in kws)
        parts.append(f"WHEN category = '{cat}' THEN {s}")
    return "CASE " + " ".join(parts) + " ELSE 0 END"


def _severity() -> str:
    parts = []
    for cat, (_k, base, mult) in R.SEVERITY_RULES.items():
        parts.append(
            f"WHEN category = '{cat}' THEN CASE WHEN hits = 0 THEN {base} ELSE "
            f"least(10, CAST(trunc(CAST({base} AS DOUBLE) * CAST({mult} AS DOUBLE) * (1.0::DOUBLE + hits * 0.1::DOUBLE)) AS INTEGER)) END")
    return "greatest(1, least(10, CASE " + " ".join(parts) + " END))"


def _explanation() -> str:
    risk = "CASE " + " ".join(f"WHEN severity_score >= {lo} THEN {q(t)}" for lo, t in R.RISK_TIERS) + f" ELSE {q(R.RISK_DEFAULT)} END"
    ctx = "CASE " + " ".join(f"WHEN category = '{c}' THEN {q(t)}" for c, t in R.CATEGORY_CONTEXT.items()) + f" ELSE {q(R.CONTEXT_DEFAULT)} END"
    return (f"upper(left(category, 1)) || substr(category, 2) || ' event classified as ' || {risk} || ' (severity ' "
            f"|| CAST(severity_score AS VARCHAR) || '/10). ' || CASE WHEN hits > 0 THEN 'Contains ' || CAST(hits AS VARCHAR) "
            f"|| ' security-relevant keyword(s). ' ELSE '' END || {ctx}")


def _lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


def _recommendations() -> str:
    by_sev = "CASE " + " ".join(f"WHEN severity_score >= {lo} THEN {_lst(it)}" for lo, it in R.SEVERITY_RECOMMENDATIONS) + \
        f" ELSE {_lst(R.SEVERITY_RECOMMENDATIONS_DEFAULT)} END"
    parts = []
    for c, it in R.CATEGORY_RECOMMENDATIONS.items():
        if c == "auth":
            parts.append(f"WHEN category = 'auth' THEN CASE WHEN contains(lower(message), 'failed') THEN "
                         f"{_lst(it + [R.AUTH_FAILED_RECOMMENDATION])} ELSE {_lst(it)} END")
        else:
            parts.append(f"WHEN category = '{c}' THEN {_lst(it)}")
    by_cat = "CASE " + " ".join(parts) + " ELSE []::VARCHAR[] END"
    return f"list_concat({by_sev}, {by_cat})"


SCORED = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, ts, raw_log_id, line_no, source_name, ingested_at, line,
         raw_log_id || ':' || CAST(line_no AS VARCHAR) AS id, pattern, event_ts AS "timestamp", host, process, pid,
         source, message, category, CAST(event_ts AS DATE) AS event_date
  FROM cat WHERE valid
),
h AS (SELECT *, {_hits()} AS hits FROM ev),
s1 AS (SELECT *, {_severity()} AS severity_score FROM h),
s2 AS (SELECT *, {_explanation()} AS explanation, {_recommendations()} AS recs0 FROM s1),
scored AS (
  SELECT * EXCLUDE (recs0),
    list_slice(CASE WHEN len(recs0) < {R.MIN_RECOMMENDATIONS} THEN list_concat(recs0, {_lst(R.PAD_RECOMMENDATIONS)}) ELSE recs0 END,
               1, {R.MAX_RECOMMENDATIONS}) AS recommendations,
    hits AS keyword_hits
  FROM s2
),
analysis AS (
  SELECT 'an_' || id AS analysis_id, id AS event_id, severity_score, explanation, recommendations, {REF} AS analyzed_at
  FROM scored WHERE event_id % 4 <> 0
)"""

BASE = "WITH " + ",".join([LINES, PARSED, CATEGORIZED, SCORED]) + "\n"
PARSE_ONLY = "WITH " + ",".join([LINES, PARSED, CATEGORIZED]) + "\n"


def with_base(sql: str) -> str:
    """Prefix a query over ``lines / cat / ev / scored / analysis``."""
    return BASE + sql
