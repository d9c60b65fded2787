"""Time buckets, time literals and window lengths. All of it is UTC."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}


def bucket(ts: Column, unit: str) -> Column:
    """Day, Monday of the week, or month of a millisecond time, as text; the session's time zone must be UTC."""
    t = F.timestamp_millis(ts)
    if unit == "month":
        return F.date_format(t, "yyyy-MM")
    if unit == "week":
        return F.date_format(F.date_trunc("WEEK", t), "yyyy-MM-dd")
    return F.date_format(t, "yyyy-MM-dd")


def resolve(literal: str | int | None, now: int) -> int | None:
    """Milliseconds of 7d, 24h, 30m (before now), YYYY-MM-DD, YYYYMMDD (that midnight) or a millisecond number."""
    if literal is None or literal == "":
        return None
    text = str(literal).strip()
    if m := re.fullmatch(r"(\d+)([mhd])", text):
        return now - int(m[1]) * _UNITS[m[2]]
    if m := re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", text):
        return int(datetime(int(m[1]), int(m[2]), int(m[3]), tzinfo=timezone.utc).timestamp() * 1000)
    if re.fullmatch(r"\d{9,}", text):
        return int(text)
    raise ValueError(f"not a time: {literal!r}")


def window_days(since: int | None, until: int | None, now: int) -> float | None:
    end = until if until is not None else now
    return None if since is None or end <= since else (end - since) / 86_400_000


def granularity(days: float | None) -> str:
    return "month" if days is None or days > 366 else "day" if days <= 92 else "week"
