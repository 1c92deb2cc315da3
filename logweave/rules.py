"""Fixed values of the log-analysis rules.

Everything in this module is a constant that the results must agree on:
keyword lists, score parameters, thresholds and text templates. They are
kept here plainly, in their natural order, so the column functions in
``logweave.functions`` and the SQL checks read from one place.
"""

from __future__ import annotations

import datetime as _dt

# --------------------------------------------------------------------------
# Reference time. Every "now" of the rules is an explicit argument; this is
# the default used for the driver tables (events span 2024-01-01..30).
# --------------------------------------------------------------------------
REF_TS = _dt.datetime(2024, 1, 31, 0, 0, 0)

# --------------------------------------------------------------------------
# FIXED VALUES: line formats of the parser cascade (tried in this order).
# --------------------------------------------------------------------------
SYSLOG_TS = r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
PATTERN_SYSTEM = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+?)(?:\[(\d+)\])?\s*:\s*(.+)"
PATTERN_AUTH = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\w+)(?:\[(\d+)\])?\s*:\s*(.+)"
PATTERN_CONSOLE = r"(\d{2}:\d{2}:\d{2}\.\d{6}[+-]\d{4})\s+(\w+)(?:\[(\d+)\])?\s*(.+)"
PATTERN_GENERIC = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.+)"
# fallback: timestamp searched anywhere in the line, first valid kind wins
FALLBACK_ISO = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
FALLBACK_US = r"(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})"
FALLBACK_SYSLOG = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
FALLBACK_COLON = r"^(\S+):\s*(.+)"
FALLBACK_SPACE = r"^(\S+)\s+(.+)"
# message clean-up: control characters except tab, newline and carriage return
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# validity window of parsed event times, relative to the reference time
FUTURE_LIMIT_HOURS = 6
SYSLOG_YEAR_ROLLBACK_DAYS = 1  # syslog time > now + 1 day -> previous year
CONSOLE_ROLLBACK_HOURS = 2  # console time > now + 2 h -> previous day
MAX_SOURCE_LEN = 255

# --------------------------------------------------------------------------
# FIXED VALUES: category keywords, in category order (ties go to the first).
# --------------------------------------------------------------------------
CATEGORY_KEYWORDS = {
    "auth": [
        "login", "logout", "authentication", "password", "sudo", "su",
        "ssh", "failed", "success", "user", "session", "pam", "auth",
        "credential", "token", "certificate", "kerberos", "ldap",
    ],
    "kernel": [
        "kernel", "panic", "oops", "segfault", "core", "dump",
        "interrupt", "irq", "dma", "pci", "usb", "acpi",
    ],
    "system": [
        "boot", "shutdown", "restart", "mount", "unmount",
        "disk", "memory", "cpu", "process", "service", "daemon",
        "system", "hardware", "driver", "module", "loginwindow",
        "started", "application",
    ],
    "network": [
        "network", "tcp", "udp", "ip", "dns", "dhcp", "firewall",
        "connection", "socket", "port", "interface", "ethernet",
        "wifi", "vpn", "proxy", "routing", "packet",
    ],
    "security": [
        "security", "threat", "malware", "virus", "attack", "intrusion",
        "breach", "vulnerability", "exploit", "suspicious", "blocked",
        "denied", "quarantine", "alert", "warning", "violation",
    ],
    "application": [
        "application", "app", "software", "program", "crash", "error",
        "exception", "debug", "info", "warning", "fatal", "trace",
    ],
}
CATEGORIES = ["auth", "system", "network", "security", "application", "kernel", "unknown"]
# scoring weights: per substring occurrence, whole-word bonus, in-source bonus
WORD_BONUS = 2
SOURCE_BONUS = 3

# --------------------------------------------------------------------------
# FIXED VALUES: rule-based severity (keywords, base score, multiplier).
# --------------------------------------------------------------------------
SEVERITY_RULES = {
    "security": (["attack", "breach", "malware", "virus", "intrusion", "exploit", "vulnerability"], 8, 1.2),
    "auth": (["failed", "denied", "unauthorized", "invalid", "blocked"], 6, 1.1),
    "network": (["blocked", "denied", "suspicious", "anomaly", "flood"], 5, 1.0),
    "system": (["error", "failure", "crash", "panic", "critical"], 4, 0.9),
    "application": (["error", "exception", "crash", "fatal"], 3, 0.8),
    "kernel": (["panic", "oops", "fault", "error"], 7, 1.1),
    "unknown": ([], 2, 0.7),
}
KEYWORD_STEP = 0.1  # severity = base * mult * (1 + hits * 0.1), truncated

# --------------------------------------------------------------------------
# FIXED VALUES: explanation and recommendation texts.
# --------------------------------------------------------------------------
RISK_TIERS = [(8, "high risk"), (6, "medium risk"), (4, "low risk")]
RISK_DEFAULT = "informational"
CATEGORY_CONTEXT = {
    "auth": "Authentication events require monitoring for potential unauthorized access attempts.",
    "security": "Security events indicate potential threats that need immediate attention.",
    "network": "Network events may indicate connectivity issues or potential intrusion attempts.",
    "system": "System events may indicate operational issues or potential system compromise.",
    "kernel": "Kernel events may indicate serious system stability or security issues.",
}
CONTEXT_DEFAULT = "Event requires review to determine appropriate response."
SEVERITY_RECOMMENDATIONS = [
    (8, ["Investigate immediately", "Review related system logs", "Consider isolating affected systems"]),
    (6, ["Review within 24 hours", "Monitor for similar events", "Check system status"]),
    (4, ["Review during next maintenance window", "Document for trend analysis"]),
]
SEVERITY_RECOMMENDATIONS_DEFAULT = ["Log for informational purposes"]
CATEGORY_RECOMMENDATIONS = {
    "auth": ["Review user account activity"],
    "security": ["Run security scans", "Update security policies"],
    "network": ["Check network configuration"],
    "system": ["Verify system health"],
    "kernel": ["Check system stability", "Review hardware status"],
}
AUTH_FAILED_RECOMMENDATION = "Consider account lockout policies"
PAD_RECOMMENDATIONS = ["Monitor for recurring patterns", "Document in security log"]
MIN_RECOMMENDATIONS = 2
MAX_RECOMMENDATIONS = 4

# UI severity label (>= 9, 7, 5, 3) and alert severity label (<= 2, 4, 6, 8)
UI_SEVERITY_LABELS = [(9, "Critical"), (7, "High"), (5, "Medium"), (3, "Low")]
UI_SEVERITY_DEFAULT = "Info"
ALERT_SEVERITY_LABELS = [(2, "Low"), (4, "Medium"), (6, "High"), (8, "Critical")]
ALERT_SEVERITY_DEFAULT = "Very Critical"
HIGH_SEVERITY = 7
DEFAULT_RULE_SEVERITY = 5  # alert rules treat a missing analysis as severity 5

# --------------------------------------------------------------------------
# FIXED VALUES: detection thresholds.
# --------------------------------------------------------------------------
FAILED_LOGIN_WINDOW_S = 300
RAPID_FIRE_WINDOW_S = 300
RAPID_FIRE_MAX = 50
VIOLATION_WINDOW_S = 600
VIOLATIONS_SUSPICIOUS = 5
VIOLATIONS_BLOCKED = 20
ERROR_SPIKE_WINDOW_S = 300
ERROR_SPIKE_MAX = 20
CRITICAL_SPIKE_MAX = 3
ERROR_PATTERN_KEEP = 3
ERROR_PATTERN_FLAG = 5
ERROR_PATTERN_PREFIX = 50
TOKEN_BUCKET_PER_MIN = 60
BURST_LIMIT = 10
BURST_WINDOW_S = 10
API_LIMIT_PER_MIN = 60
API_BURST = 10
API_BLOCK_AT = [(5, 600), (3, 300)]  # violations -> block seconds

# console threat words (lower-case substring test on the message)
THREAT_WORDS = ["failed", "denied", "error", "attack", "suspicious", "blocked"]
# security export predicate: message contains any word (case-sensitive),
# or the process is one of these
SECURITY_MESSAGE_WORDS = [
    "authentication", "login", "password", "sudo", "ssh", "failed",
    "denied", "blocked", "security", "violation",
]
SECURITY_PROCESSES = ["sshd", "sudo", "loginwindow"]
SECURITY_SUBSYSTEM = "com.apple.security"

# size limits
LIMITS = {
    "upload_bytes": 50 * 1024 * 1024,
    "text_bytes": 10 * 1024 * 1024,
    "file_check_bytes": 10 * 1024 * 1024,
    "content_chars": 1_000_000,
    "content_min_chars": 10,
    "entry_bytes": 1024 * 1024,
    "line_chars": 32768,
    "message_chars": 10_000,
}

# FIXED VALUES: prompt of the external scorer, around the event's details
PROMPT_HEAD = """Analyze this security log event and provide a JSON response with severity assessment:

Event Details:
"""
PROMPT_TAIL = """

Please analyze this event and respond with a JSON object containing:
1. "severity_score": Integer from 1-10 (1=informational, 10=critical)
2. "explanation": Brief explanation of why this event has this severity level
3. "recommendations": Array of 2-4 specific actionable recommendations

Consider:
- Authentication failures, system errors, network anomalies
- Potential security implications
- Context from source and message content
- Urgency of response needed

Respond only with valid JSON."""
