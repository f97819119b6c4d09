"""Columns over strings: keys, classes, truncation, redaction, line endings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionweave.functions.content import utf16

#: fixed values: (class, pattern) in order; the first that the lower-cased error text holds wins
EDIT_ERRORS = (
    ("file_not_found", "file not found"),
    ("not_found_exact_text", "could not find the exact text"),
    ("multiple_occurrences", r"found multiple occurrences|(?m)^found \d+ occurrences"),
    ("no_changes_made", "no changes made"),
    ("invalid_input", "input is invalid"),
    ("overlapping_edits", "must not overlap"),
    ("aborted", "aborted"),
)
#: fixed values: likewise for failed model calls
CALL_ERRORS = (
    ("authentication", r"\b401\b|\b403\b|auth|api.?key|credential|unauthori[sz]ed|forbidden"),
    ("rate_limit", r"\b429\b|rate.?limit|quota"),
    ("timeout", "timeout|timed out"),
    ("context_limit", "context|token.*limit|too long|maximum.*length"),
    ("network", "network|socket|connection|fetch"),
    ("provider_unavailable", r"\b5\d\d\b|overload|unavailable"),
)
#: fixed values: families of model and provider names, first substring wins
MODELS = ("claude", "gpt", "o1", "o3", "o4", "gemini", "glm", "kimi", "qwen", "deepseek", "llama", "mistral")
PROVIDERS = ("anthropic", "openai", "google", "prime", "openrouter", "bedrock", "vertex", "mistral", "groq", "xai")


#: fixed values: (class, pattern of a provider's error type, statuses) of broken-off streams, the first that fits wins
STREAM_FAILURES = (
    ("refusal", "^refusal$", ()),
    ("safety", "sensitive|safety|prohibited_content|blocklist|spii|recitation|content.?filter|guardrail|flagged", ()),
    ("overloaded", "overloaded", (529,)),
    ("rate_limit", "rate_limit|throttl", (429,)),
    ("auth", "authentication|permission|unauthorized", (401, 403)),
    ("invalid_request", "invalid_request|not_found_error", (400, 404)),
    ("malformed_response", "malformed", ()),
)


def first_of(text: Column, classes: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F
    for name, pattern in classes:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(otherwise)


def edit_error(text: Column, is_error: Column, matched: Column) -> Column:
    return F.when(~matched, "missing_result").when(is_error, first_of(text, EDIT_ERRORS, "other"))


def call_error(text: Column) -> Column:
    return first_of(text, CALL_ERRORS, "other")


def stream_failure(kind: Column, status: Column) -> Column:
    """Class of a stream that broke off, by the provider's error type and the HTTP status; either may be null."""
    low, out = F.lower(F.coalesce(kind, F.lit(""))), F
    for name, pattern, statuses in STREAM_FAILURES:
        out = out.when(low.rlike(pattern) | F.coalesce(status.isin(*statuses) if statuses else F.lit(False), F.lit(False)), name)
    return out.when(low.rlike("api_error|server_error|unavailable") | F.coalesce(status >= 500, F.lit(False)), "server_error").otherwise("unknown")


def model_family(name: Column) -> Column:
    return first_of(name, tuple((m, m) for m in MODELS), "custom")


def provider_family(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(first_of(name, tuple((p, p) for p in PROVIDERS), "custom"))


def command_key(command: Column) -> Column:
    """Program, and its first argument unless it is an option, of the first command of a line."""
    first = F.trim(F.element_at(F.split(command, r"\n|&&|\|\||;|\|", 2), 1))
    pattern = r"^(?:\w+=\S+\s+)*(?:sudo\s+)?([^\s]+)(?:\s+([^\s]+))?"
    program, argument = F.regexp_extract(first, pattern, 1), F.regexp_extract(first, pattern, 2)
    return F.when(program == "", "unknown").when((argument != "") & ~argument.startswith("-"), F.concat_ws(" ", program, argument)).otherwise(program)


def path_extension(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    extension = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "[unknown]")
        .when(extension != "", F.lower(extension))
        .when(base.startswith(".") & ~F.substring(base, 2, 1 << 20).contains("."), F.lower(base))
        .otherwise("[no_ext]")
    )


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_key(text: Column) -> Column:
    return F.lower(collapse(text))


def model_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def units(text: Column, most: int) -> Column:
    """The first `most` UTF-16 units; a pair that the cut would part goes whole."""
    raw = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(raw, 2 * most - 1, 1)) if most else F.lit("")
    kept = F.substring(raw, F.lit(1), F.when(last.between("D8", "DB"), 2 * most - 2).otherwise(2 * most))
    return F.when(utf16(text) == F.length(text), F.substring(text, 1, most)).otherwise(F.decode(kept, "UTF-16BE"))


def label(text: Column, most: int = 80) -> Column:
    """One line of at most `most` UTF-16 units, the last an ellipsis where it was cut."""
    flat = collapse(text)
    return F.when(utf16(flat) <= most, flat).otherwise(F.concat(F.rtrim(units(flat, most - 1)), F.lit("…")))


def clamp(text: Column, most: int) -> Column:
    return units(collapse(text), most)


def cut_line(line: Column, most: int = 500) -> Column:
    return F.when(utf16(line) <= most, line).otherwise(F.concat(units(line, most), F.lit("... [truncated]")))


def cut_summary(text: Column, most: int = 2000) -> Column:
    gone = (utf16(text) - most).cast("string")
    return F.when(utf16(text) <= most, text).otherwise(F.concat(units(text, most), F.lit("\n\n[... "), gone, F.lit(" more characters truncated]")))


def size_label(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024), F.lit("KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit("MB")))


def line_ending(text: Column) -> Column:
    crlf, lf = F.instr(text, "\r\n"), F.instr(text, "\n")
    return F.when((crlf > 0) & (crlf < lf), "\r\n").otherwise("\n")


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def from_lf(text: Column, ending: Column) -> Column:
    return F.when(ending == "\r\n", F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-?]*[ -/]*[@-~]", "")


def redacted(text: Column) -> Column:
    """Long blobs, key=value secrets, authorisation headers and quoted keys replaced by marks."""
    #: fixed values: patterns and what stands in for them, in order
    rules = (
        (r"[A-Za-z0-9+/]{80,}={0,2}", "<blob>"),
        (r"(?i)\b((?=\w*(?:token|key|secret|password))[A-Za-z_]\w*)\s*=\s*([\"'])[^\"']*\2", "$1=<redacted>"),
        (r"(?i)\b((?=\w*(?:token|key|secret|password))[A-Za-z_]\w*)\s*=\s*(?!<redacted>)(?![\"'])\S+", "$1=<redacted>"),
        (r"(?i)\b(authorization:\s*(?:bearer\s+)?)[^\s\"']+", "$1<redacted>"),
        (r"([\"'])sk-[^\"']+\1", "$1<redacted>$1"),
        (r"([\"']).{160,}\1", "$1…$1"),
    )
    for pattern, mark in rules:
        text = F.regexp_replace(text, pattern, mark)
    return text


def command_parts(command: Column) -> Column:
    """Commands of all lines without comments, shell options, exports and sourced files."""
    pieces = F.transform(F.split(command, r"\n|&&|;"), lambda p: F.trim(F.regexp_replace(p, r"^\s*!", "")))
    return F.filter(pieces, lambda p: (p != "") & ~p.rlike(r"^#|^set\s+[-+][A-Za-z]*(?:\s+[-+]?\w+)*$|^(?:export\s+\w+=|source\s+\S+|\.\s+\S+)"))


def directory_key(path: Column) -> Column:
    """A path as one folder name."""
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\:]", "-"), F.lit("--"))


def front_matter(text: Column) -> Column:
    """Struct of the header between --- lines (null where there is none) and the body."""
    pattern = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
    head = F.regexp_extract(text, pattern, 1)
    has = text.rlike(pattern)
    return F.struct(F.when(has, head).alias("header"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def is_alias(model: Column) -> Column:
    """A model name without a date at its end."""
    return ~model.rlike(r"-\d{8}$")


def glob(pattern: str) -> str:
    """A name pattern with * and ? as a regular expression."""
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def timing(line: Column) -> Column:
    """Struct of label and milliseconds of a line `label: 12ms`."""
    pattern = r"^\s*(.+?):\s*(\d+(?:\.\d+)?)ms\s*$"
    return F.struct(F.regexp_extract(line, pattern, 1).alias("label"), F.try_to_number(F.regexp_extract(line, pattern, 2), F.lit("999999999.999")).cast("double").alias("ms"))


def process_ids(line: Column, name: str) -> Column:
    """Process id of a `pid command` line whose command has the name."""
    return F.when(line.contains(name), F.try_element_at(F.regexp_extract_all(line, F.lit(r"^\s*(\d+)\s"), 1), F.lit(1)).cast("long"))


def elapsed(line: Column) -> Column:
    """Struct of pid and seconds of a `pid seconds` line."""
    pattern = r"^\s*(\d+)\s+(\d+)\s*$"
    return F.struct(F.regexp_extract(line, pattern, 1).try_cast("long").alias("pid"), F.regexp_extract(line, pattern, 2).try_cast("long").alias("seconds"))
