"""Text helpers: names, secret masking, fingerprints and level words, all as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a secret, as an event level, and as a log failure.
SECRET_PAIR = r"(?i)(password|passwd|pwd|token|secret|api[_-]?key)\s*[:=]\s*['\"]?([^'\"\s]+)"
SECRET_URL = r"postgresql://[^:\s]+:[^@\s]+@"
ERROR_WORDS = ("traceback", "exception", "modulenotfounderror", "error:", " failed", "timeout")
WARNING_WORDS = ("warning", "warn", "deprecated", "retry")
OK_WORDS = ("success", "passed", "no issues identified", "all checks passed")
LOG_PATTERNS = {
    "traceback": r"(?i)Traceback \(most recent call last\)",
    "module_missing": r"(?i)ModuleNotFoundError|ImportError",
    "db_auth": r"(?i)fe_sendauth|password supplied|authentication failed|no password",
    "timeout": r"(?i)timed?\s*out|TimeoutError|not ready",
    "exception": r"(?i)\bException\b|OperationalError|RuntimeError|ValueError",
}
LOG_TOP_LINE = r"(?i)Traceback|ERROR|Exception|OperationalError|ModuleNotFoundError|timeout|not ready|failed"


def feature_name(name: str) -> str:
    """Snake-case column name; ``%`` becomes ``pct``."""
    text = (name or "").strip().lower().replace("%", "pct")
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_") or "feature"


def feature_name_column(c: Column) -> Column:
    text = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("%"), F.lit("pct")), "[^a-z0-9]+", "_")
    text = F.regexp_replace(text, "^_+|_+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("feature")).otherwise(text)


def mask_secrets(c: Column) -> Column:
    """Hide passwords, tokens, keys and database credentials. Works on plain text and on JSON text alike."""
    return F.regexp_replace(F.regexp_replace(c, SECRET_PAIR, "$1=***"), SECRET_URL, "postgresql://***:***@")


def _any_word(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def event_level(message: Column, source: Column | None = None, default: str = "INFO") -> Column:
    """ERROR before WARNING before OK before the default, by the words in source and message."""
    source = F.lit("") if source is None else F.coalesce(source, F.lit(""))
    text = F.lower(F.concat(source, F.lit("\n"), F.coalesce(message, F.lit(""))))
    return (
        F.when(_any_word(text, ERROR_WORDS), "ERROR")
        .when(_any_word(text, WARNING_WORDS), "WARNING")
        .when(_any_word(text, OK_WORDS), "OK")
        .otherwise(F.lit(default))
    )


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _first(text: Column, longest: int | None) -> Column:
    return text if longest is None else F.substr(text, F.lit(1), F.lit(longest))


def stable_fingerprint(df: DataFrame, longest: int | None = None) -> Column:
    """16 hex digits of the SHA-256 of the event's identifying fields as sorted JSON.

    The whole message counts; ``longest`` compares with fingerprints that were made of its first characters.
    """
    fields = {
        "category": _text(df, "category"),
        "exception_type": _text(df, "exception_type"),
        "level": _text(df, "level"),
        "message": _first(_text(df, "message"), longest),
        "path": _text(df, "path"),
        "source": _text(df, "source"),
    }
    # One small object per field joined by ", ", so the text has the spacing of a default JSON dump.
    pieces = []
    for name, value in fields.items():
        pair = F.to_json(F.struct(value.alias("v")))
        pieces.append(F.concat(F.lit(f'"{name}": '), F.substr(pair, F.lit(6), F.length(pair) - 6)))
    raw = F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))
    return F.substr(F.sha2(raw, 256), F.lit(1), F.lit(16))


def normalized_fingerprint(*parts: Column, longest: int | None = None) -> Column:
    """The event's non-empty parts in lower case with every number as ``<n>``; on demand its first characters only."""
    cleaned = []
    for p in parts:
        text = F.coalesce(p.cast("string"), F.lit(""))
        cleaned.append(F.when(text != "", F.regexp_replace(F.lower(F.trim(text)), r"\d+", "<n>")))
    joined = _first(F.concat_ws("|", *cleaned), longest)
    return F.when(joined == "", "unknown").otherwise(joined)


def log_pattern_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """How often each failure pattern occurs in the log lines."""
    c = F.col(column)
    return lines.agg(
        *[F.coalesce(F.sum(F.regexp_count(c, F.lit(p))), F.lit(0)).cast("long").alias(n) for n, p in LOG_PATTERNS.items()]
    )


def log_top_lines(lines: DataFrame, order: str, column: str = "value", n: int = 20) -> DataFrame:
    """The last ``n`` lines that look like failures."""
    hit = lines.where(F.col(column).rlike(LOG_TOP_LINE))
    return hit.orderBy(F.col(order).desc()).limit(n)
