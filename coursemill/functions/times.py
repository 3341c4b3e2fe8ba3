"""Times: stored in UTC, 'today' counted in the shop's own time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHOP_ZONE = "Asia/Taipei"


def time_literal(at: datetime, column_type: T.DataType) -> Column:
    """A literal of ``column_type`` for ``at``; a time without zone is taken as UTC."""
    utc = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
    if isinstance(column_type, T.TimestampNTZType):
        return F.lit(utc.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.to_timestamp(F.lit(utc.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")))


def day_ranges(now: datetime) -> dict[str, tuple[datetime, datetime]]:
    """Half-open UTC ranges of the date filters, relative to ``now``."""
    local = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(ZoneInfo(SHOP_ZONE))
    today = local.replace(hour=0, minute=0, second=0, microsecond=0)
    tomorrow = today + timedelta(days=1)
    month = today.replace(day=1)
    year = today.replace(month=1, day=1)
    ranges = {
        "today": (today, tomorrow),
        "past_7_days": (today - timedelta(days=7), tomorrow),
        "this_month": (month, (month + timedelta(days=32)).replace(day=1)),
        "this_year": (year, year.replace(year=year.year + 1)),
    }
    return {k: (a.astimezone(timezone.utc), b.astimezone(timezone.utc)) for k, (a, b) in ranges.items()}


def iso_text(time: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS[.ffffff]+00:00``; the fraction only when there is one."""
    micros = F.date_format(time, "SSSSSS")
    fraction = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit(""))
    return F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit("+00:00"))
