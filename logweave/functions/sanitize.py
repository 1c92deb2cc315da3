"""Text sanitising and validation as column expressions (F-15..F-20).

``sanitize_log_text`` applies the fixed replacement passes in order, then
normalises each line (strip, collapse blanks and tabs, drop empty lines).
``validate_log_text`` returns ``(is_valid, reason)``; ``entry_verdict``
returns valid / invalid / requires_sanitization / suspicious. All run as
JVM regex expressions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import rules as R

# FIXED VALUES: sanitising passes, applied in this order (pattern, flags)
SANITIZE_PASSES = [
    (r"\x00", ""),
    (r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    (r"<[^>]*>", ""),
    (r"javascript:", "i"),
    (r"on\w+\s*=", "i"),
    (r"(\b(union|select|insert|update|delete|drop|create|alter|exec|execute)\b)", "i"),
    (r"(--|#|/\*|\*/)", "i"),
    (r"(\bor\b\s+\d+\s*=\s*\d+)", "i"),
    (r"(\band\b\s+\d+\s*=\s*\d+)", "i"),
    (r"[;&|`$(){}\[\]\\]", ""),
    (r"\$\([^)]*\)", ""),
    (r"`[^`]*`", ""),
]
# FIXED VALUES: suspicious-content patterns of the entry validator
SUSPICIOUS_PATTERNS = [
    r"(?i)(union\s+select|drop\s+table|delete\s+from|insert\s+into)",
    r"(?i)(or\s+1\s*=\s*1|and\s+1\s*=\s*1)",
    r"(?i)(<script|javascript:|on\w+\s*=)",
    r"(?i)(alert\s*\(|confirm\s*\(|prompt\s*\()",
    r"\.\.[\\/]",
    r"(?i)(etc[\\/]passwd|windows[\\/]system32)",
    r"(?i)(\|\s*\w+|\&\&\s*\w+|\;\s*\w+)",
    r"(?i)(curl\s+|wget\s+|nc\s+|netcat\s+)",
    r"%[0-9a-fA-F]{2}",
    r"\\x[0-9a-fA-F]{2}",
]
# literals of which a text that holds the pattern of this number holds one
SUSPICIOUS_NEEDS = {1: ["="], 2: ["<", ":", "="], 3: ["("], 4: [".."], 5: ["/", "\\"], 6: ["|", "&&", ";"], 8: ["%"], 9: ["\\"]}
ENTRY_MAX_CHARS = 1024 * 1024
ENTRY_MAX_LINE = 32768


def _flags(f: str) -> str:
    return "(?U" + ("i" if "i" in f else "") + ")"


def sanitize_log_text(text: Column) -> Column:
    """F-15: the replacement passes, CR/CRLF -> LF, then per line: strip,
    collapse runs of blanks/tabs to one blank, drop empty lines."""
    out = text
    for pat, fl in SANITIZE_PASSES:
        out = F.regexp_replace(out, _flags(fl) + pat, "")
    out = F.regexp_replace(out, r"\r\n|\r", "\n")
    lines = F.transform(F.split(out, "\n"), lambda l: F.regexp_replace(
        F.regexp_replace(l, r"(?U)^\s+|\s+$", ""), r"[ \t]+", " "))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def control_char_count(text: Column) -> Column:
    """Characters below 32 other than tab, LF and CR."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def validate_log_text(text: Column) -> Column:
    """F-18: struct(is_valid, reason) for raw log content."""
    reason = (
        F.when(text.isNull() | (text == ""), F.lit("Log content must be a non-empty string"))
        .when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < R.LIMITS["content_min_chars"],
              F.lit("Log content too short to be meaningful"))
        .when(F.length(text) > R.LIMITS["content_chars"], F.lit("Log content exceeds maximum size limit (1MB)"))
        .when(F.instr(text, "\x00") > 0, F.lit("Log content contains null bytes"))
        .when(control_char_count(text) > F.length(text) * 0.1, F.lit("Log content contains excessive control characters"))
    )
    return F.struct(reason.isNull().alias("is_valid"), reason.alias("reason"))


def gated(match: Column, text: Column, needs: list[str] | None) -> Column:
    """``match`` of a pattern that only texts with one of ``needs`` can hold: a
    search for a literal costs far less than the regex."""
    if not needs:
        return match
    found = F.contains(text, F.lit(needs[0]))
    for x in needs[1:]:
        found = found | F.contains(text, F.lit(x))
    return found & match


def entry_verdict(text: Column) -> Column:
    """F-20: valid / invalid / requires_sanitization / suspicious, checked in
    this order: empty or too long -> invalid; a line over 32768 characters or
    a character outside printable ASCII + tab/LF/CR -> requires_sanitization;
    any suspicious pattern -> suspicious."""
    long_line = F.exists(F.split(text, "\n"), lambda l: F.length(l) > ENTRY_MAX_LINE)
    bad_char = text.rlike(r"[^\x20-\x7E\t\n\r]")
    sus = F.lit(False)
    for i, p in enumerate(SUSPICIOUS_PATTERNS):
        sus = sus | gated(text.rlike(p), text, SUSPICIOUS_NEEDS.get(i))
    return (F.when(text.isNull() | (text == "") | (F.length(text) > ENTRY_MAX_CHARS), F.lit("invalid"))
            .when(long_line | bad_char, F.lit("requires_sanitization"))
            .when(sus, F.lit("suspicious")).otherwise(F.lit("valid")))


# FIXED VALUES: suspicious-input classes (search on the lower-cased text,
# case-insensitive). The reference's path list lacks a comma after its second
# entry, so that entry is the two patterns joined; kept as it acts.
DANGER_CLASSES = {
    "path_traversal": [r"\.\./", r"\.\.\\\.\.%2f", r"\.\.%5c", r"%2e%2e%2f", r"%2e%2e%5c"],
    "command_injection": [r"[;&|`$]", r"\$\(", r"`[^`]*`", r"\|\s*\w+", r";\s*\w+", r"&&\s*\w+", r"\|\|\s*\w+"],
    "script_injection": [r"<script[^>]*>", r"javascript:", r"vbscript:", r"on\w+\s*=", r"expression\s*\(", r"@import",
                         r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>"],
    "sql_injection": [r"union\s+select", r"drop\s+table", r"delete\s+from", r"insert\s+into", r"update\s+\w+\s+set",
                      r"exec\s*\(", r"sp_\w+", r"xp_\w+"],
}
# FIXED VALUES: request-text script patterns (case-insensitive, dot matches newline)
SCRIPT_PATTERNS = [r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"on\w+\s*=", r"expression\s*\(",
                   r"@import", r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>"]
BOT_WORDS = ["bot", "crawler", "spider", "scraper", "curl", "wget"]


def danger_classes(text: Column) -> Column:
    """F-21: map class -> whether any of its patterns occurs."""
    low = F.lower(text)
    pairs = []
    for cls, pats in DANGER_CLASSES.items():
        hit = F.lit(False)
        for p in pats:
            hit = hit | low.rlike("(?Ui)" + p)
        pairs += [F.lit(cls), hit]
    return F.create_map(*pairs)


def has_script(text: Column) -> Column:
    """F-22."""
    low = F.lower(text)
    hit = F.lit(False)
    for p in SCRIPT_PATTERNS:
        hit = hit | low.rlike("(?Uis)" + p)
    return hit


def is_bot_agent(agent: Column) -> Column:
    """F-23: user agent contains a bot word."""
    low = F.lower(agent)
    hit = F.lit(False)
    for w in BOT_WORDS:
        hit = hit | low.contains(w)
    return hit


# FIXED VALUES: entry character clean-up
REPLACEMENT_CHAR = "?"
MAX_CONSECUTIVE_REPLACEMENTS = 10
BAD_CHAR = r"[^\x20-\x7E\t\n\r]"
TRUNCATED_MARK = " [TRUNCATED]"


def replace_bad_chars(text: Column) -> Column:
    """F-17: characters outside printable ASCII + tab/LF/CR become '?', at
    most 10 in a row (longer runs are cut first)."""
    capped = F.regexp_replace(text, f"({BAD_CHAR}{{{MAX_CONSECUTIVE_REPLACEMENTS}}}){BAD_CHAR}+", "$1")
    return F.regexp_replace(capped, BAD_CHAR, REPLACEMENT_CHAR)


def cut_long_lines(text: Column, max_len: int = ENTRY_MAX_LINE) -> Column:
    """F-17: lines longer than ``max_len`` are cut and marked."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda l: F.when(
        F.length(l) > max_len, F.concat(F.substring(l, 1, max_len), F.lit(TRUNCATED_MARK))).otherwise(l)), "\n")


def sanitize_filename(name: Column) -> Column:
    """F-16: drop '..', '/', '\\' and control characters, map anything but
    [A-Za-z0-9._-] to '_', name empty/'.'/'..' -> 'sanitized_file', cut to 255."""
    s = F.replace(F.replace(F.replace(name, F.lit(".."), F.lit("")), F.lit("/"), F.lit("")), F.lit("\\"), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1F\x7F]", ""), r"[^a-zA-Z0-9._-]", "_")
    s = F.when(s.isin("", ".", ".."), F.lit("sanitized_file")).otherwise(s)
    return F.substring(s, 1, 255)


SOURCE_ID_PATTERN = r"^[a-zA-Z0-9_\-\.:]+$"


def event_errors(id_: Column, raw_log_id: Column, ts: Column, source: Column, message: Column, category: Column,
                 ref_ts) -> Column:
    """F-19: validation errors of an event row, in check order (empty array
    when valid): ids, time within [ref - 3650 d, ref + 1 h], source format,
    message presence and length, category set."""
    from logweave.functions.parse import lit_ts

    ref = lit_ts(ref_ts)
    blank = lambda c: c.isNull() | (F.regexp_replace(c, r"(?U)^\s+|\s+$", "") == "")
    cats = ", ".join(R.CATEGORIES)
    src_err = (F.when(blank(source), F.lit("Invalid source: Source cannot be empty"))
               .when(F.length(source) > 255, F.lit("Invalid source: Source identifier too long (maximum 255 characters)"))
               .when(~source.rlike(SOURCE_ID_PATTERN), F.lit(
                   "Invalid source: Source must contain only alphanumeric characters, underscores, hyphens, dots, and colons")))
    ts_err = (F.when(ts > ref + F.expr("INTERVAL 1 HOURS"), F.lit("Invalid timestamp: Event timestamp is too far in the future"))
              .when(ts < ref - F.expr("INTERVAL 3650 DAYS"), F.lit("Invalid timestamp: Event timestamp is too far in the past")))
    msg_err = (F.when(blank(message), F.lit("Event message must be a non-empty string"))
               .when(F.length(message) > R.LIMITS["message_chars"], F.lit("Event message too long (maximum 10000 characters)")))
    cat_err = F.when(~F.lower(category).isin(R.CATEGORIES),
                     F.lit(f"Invalid category: Invalid category. Must be one of: {cats}"))
    return F.array_compact(F.array(
        F.when(blank(id_), F.lit("Event ID must be a non-empty string")),
        F.when(blank(raw_log_id), F.lit("Raw log ID must be a non-empty string")),
        ts_err, src_err, msg_err, cat_err))


# FIXED VALUES: words taken out of source identifiers
SOURCE_WORDS = ["DROP", "TABLE", "SELECT", "INSERT", "UPDATE", "DELETE", "UNION", "WHERE", "FROM", "INTO",
                "VALUES", "CREATE", "ALTER", "EXEC", "EXECUTE"]


def sanitize_source(source: Column, max_len: int = 255) -> Column:
    """F-16: control characters, quotes and brackets, SQL words and comments
    out, cut to ``max_len``, white space runs to one blank; 'unknown_source'
    for null, 'sanitized_source' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(source, r"[\x00-\x1F\x7F]", ""), r"[<>\"';\\]", "")
    for word in SOURCE_WORDS:
        s = F.regexp_replace(s, rf"(?iU)\b{word}\b", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?md)--.*$", ""), r"(?s)/\*.*?\*/", "")
    s = F.regexp_replace(F.regexp_replace(F.substring(s, 1, max_len), r"(?U)\s+", " "), "^ | $", "")
    return F.when(source.isNull(), F.lit("unknown_source")).when(s == "", F.lit("sanitized_source")).otherwise(s)


def analysis_errors(id_: Column, event_id: Column, severity: Column, explanation: Column, recommendations: Column) -> Column:
    """F-19: validation errors of an analysis row, in check order (empty array
    when valid); of the recommendations the first fault counts."""
    text = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    stripped = text(explanation)
    named = lambda i, what: F.concat(F.lit("Recommendation "), (i + 1).cast("string"), F.lit(what))
    faults = F.array_compact(F.transform(recommendations, lambda r, i: F.when(text(r) == "", named(i, " cannot be empty"))
                                         .when(F.length(text(r)) < 5, named(i, " is too short (minimum 5 characters)"))
                                         .when(F.length(r) > 500, named(i, " is too long (maximum 500 characters)"))))
    rec = (F.when(F.coalesce(F.size(recommendations), F.lit(0)) <= 0, F.lit("At least one recommendation is required"))
           .when(F.size(recommendations) > 10, F.lit("Too many recommendations (maximum 10)"))
           .otherwise(F.try_element_at(faults, F.lit(1))))
    return F.array_compact(F.array(
        F.when(text(id_) == "", F.lit("Analysis ID must be a non-empty string")),
        F.when(text(event_id) == "", F.lit("Event ID must be a non-empty string")),
        F.when(~F.coalesce(severity.between(1, 10), F.lit(False)), F.lit("Invalid severity score: Severity score must be between 1 and 10")),
        F.when(stripped == "", F.lit("Explanation cannot be empty"))
        .when(F.length(stripped) < 10, F.lit("Explanation too short (minimum 10 characters)"))
        .when(F.length(explanation) > 5000, F.lit("Explanation too long (maximum 5000 characters)")),
        F.when(rec.isNotNull(), F.concat(F.lit("Invalid recommendations: "), rec))))
