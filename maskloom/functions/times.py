"""ISO timestamps: naive text counts as UTC, seconds precision, human format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """Timestamp or NULL.  Text without an offset is UTC (session time zone is pinned to UTC)."""
    return F.trim(text).try_cast("timestamp")


def utc_seconds(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def iso_text(ts: Column) -> Column:
    return F.concat(F.date_format(utc_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def human_datetime(text: Column) -> Column:
    """``Jan 05, 2024 03:07 PM``; blank gives ``-``; text that is no date is shown as it is."""
    raw = F.coalesce(F.trim(text), F.lit(""))
    parsed = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), parse_iso(raw))
    zoned = raw.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    shown = F.date_format(parsed, "MMM dd, yyyy hh:mm a")
    return (
        F.when(raw == "", F.lit("-"))
        .when(parsed.isNull(), raw)
        .when(zoned, F.concat(shown, F.lit(" UTC")))
        .otherwise(shown)
    )
