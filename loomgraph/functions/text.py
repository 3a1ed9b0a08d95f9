"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: classes of secrets and the mark that replaces them
SECRET_PATTERNS = (
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    ("\\bsk-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    ("\\bgh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]"),
    ("\\bAKIA[0-9A-Z]{16}\\b", "[REDACTED]"),
    ("([Bb]earer\\s+)[A-Za-z0-9._~+/=-]{12,}", "$1[REDACTED]"),
    ("(?i)\\b([A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)\\s*=\\s*)\"?[A-Za-z0-9_./+=-]{8,}\"?", "$1[REDACTED]"),
)


def redact(text: Column) -> Column:
    """Secrets replaced by a mark; a chain of built-in replacements."""
    for pattern, mark in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more; camelCase, dots, slashes
    and dashes separate."""
    spaced = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    parts = F.split(F.regexp_replace(spaced, "[^a-z0-9_#]+", " "), " ")
    return F.filter(parts, lambda t: F.length(t) >= 2)


def name_key(text: Column) -> Column:
    """A file or test name without case, dashes and underscores."""
    return F.regexp_replace(F.lower(text), "[-_]", "")


def normal_form(text: Column) -> Column:
    """Text for structural comparison: lower case, digits as #, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), "\\s+", " "))


def clip(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last of a clipped text an ellipsis."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def content_id(prefix: Column, kind: Column, detail: Column) -> Column:
    """The first 8 hex digits of a finding's content hash."""
    return F.substring(F.sha2(F.concat_ws(":", prefix, kind, detail), 256), 1, 8)


def bar(share: Column, width: int = 10) -> Column:
    """A bar of ``width`` glyphs."""
    full = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def budget_minutes(text: Column) -> Column:
    """Minutes of a duration such as 2h, 90m or 1.5h; null if it is none."""
    number = F.regexp_extract(text, "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([hm]?)\\s*$", 1)
    unit = F.regexp_extract(text, "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([hm]?)\\s*$", 2)
    return F.when(number != "", number.cast("double") * F.when(unit == "h", 60).otherwise(1))


def newer_version(a: Column, b: Column) -> Column:
    """Whether version a.b.c is above another."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v|[-+].*$", ""), "\\."), lambda x: x.cast("int"))
    return parts(a) > parts(b)
