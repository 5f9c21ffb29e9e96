"""Names and human-readable values."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_name(topic: str) -> str:
    """Leading slashes go; slashes, dashes and dots become underscores."""
    return topic.lstrip("/").replace("/", "_").replace("-", "_").replace(".", "_")


def table_name_column(topic: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(topic, "^/+", ""), "[/.-]", "_")


def topic_name(table: str) -> str:
    """The inverse, as far as there is one."""
    return "/" + table.removeprefix("_").replace("_", "/")


def size_text(size: int) -> str:
    value, units = float(size), ["B", "KB", "MB", "GB", "TB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{size} B" if units[0] == "B" else f"{value:.1f} {units[0]}"


def duration_text(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1000:.0f}ms"
    return f"{seconds:.2f}s" if seconds < 60 else f"{int(seconds // 60)}m {seconds % 60:.0f}s"


def time_text(nanoseconds: int) -> str:
    """Seconds and as many of 0, 3, 6 or 9 decimals as needed; also before 1970."""
    seconds, rest = divmod(nanoseconds, 1_000_000_000)
    for digits, unit in ((0, 1_000_000_000), (3, 1_000_000), (6, 1000), (9, 1)):
        if rest % unit == 0:
            return f"{seconds}.{rest // unit:0{digits}d}" if digits else str(seconds)
    return str(seconds)


def cell_text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, (bytes, bytearray)):
        return "\\x" + bytes(value).hex() if len(value) <= 16 else f"<{len(value)} bytes>"
    if isinstance(value, datetime):
        since = value.replace(tzinfo=value.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return time_text((since.days * 86400 + since.seconds) * 1_000_000_000 + since.microseconds * 1000)
    return "{...}" if isinstance(value, (dict, list, tuple)) else str(value)
