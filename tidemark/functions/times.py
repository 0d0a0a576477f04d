"""What callers type: moments, spans of time, sizes and ladders. Plain functions of the driver; columns for texts of times."""

from __future__ import annotations

import math
import re
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import _c

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def parse_span(text: str) -> float:
    """90s, 15m, 2h, 1d or bare seconds; not negative."""
    found = re.fullmatch(r"\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*([smhd]?)\s*", text)
    if not found:
        raise ValueError(f"{text!r} is not a length of time: expected 90s, 15m, 2h or 1d")
    value = float(found[1]) * _UNITS[found[2] or "s"]
    if not math.isfinite(value):
        raise ValueError(f"{text!r} is not a length of time: out of range")
    return value


def parse_time(text: str, now: float, zone: str = "UTC") -> float:
    """now, -15m, 14:30, 14:30:05, 2026-09-29, 2026-09-29 14:30, 2026-09-29T14:30:05 or epoch seconds."""
    text = text.strip()
    if text.lower() == "now":
        return now
    if text.startswith("-"):
        return now - parse_span(text[1:])
    if re.fullmatch("[0-9]+", text):
        return float(text)
    found = re.fullmatch(r"(?:([0-9]+)-([0-9]{1,2})-([0-9]{1,2}))?(?:(?:(?<=[0-9])[ T])?([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?", text)
    if not found or not text or (found[1] and found[4] and not re.search("[ T]", text)):
        raise ValueError(f"{text!r} is not a time: expected now, -15m, 14:30 or YYYY-MM-DD HH:MM")
    tz = ZoneInfo(zone)
    today = datetime.fromtimestamp(now, tz)
    y, mo, d = (int(x) for x in found.groups()[:3]) if found[1] else (today.year, today.month, today.day)
    h, mi, s = (int(x or 0) for x in found.groups()[3:])
    return datetime(y, mo, d, h, mi, s, tzinfo=tz).timestamp()


def parse_size(text: str) -> int | None:
    """2G, 500M, 1.5G in binary units; 0, none and off are no limit."""
    text = text.strip()
    if text in ("0", "none", "off"):
        return None
    found = re.fullmatch(r"([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*([BKMGTbkmgt]?)", text)
    if not found or float(found[1]) <= 0:
        raise ValueError(f"{text!r} is not a size: expected 2G, 500M, or 0 for no limit")
    size = float(found[1]) * 1024 ** "BKMGT".index((found[2] or "B").upper())
    if not size < 2**64:
        raise ValueError(f"{text!r} is not a size: out of range")
    return int(size)


def parse_ladder(text: str) -> list[tuple[int, int]]:
    """5m@30d,1h@180d -> (resolution, kept for) in seconds, finest first."""
    rungs = [part.split("@") for part in text.split(",") if part.strip()]
    if any(len(r) != 2 for r in rungs):
        raise ValueError(f"{text!r} is not a ladder: expected 5m@30d,1h@180d")
    return sorted((int(parse_span(a)), int(parse_span(b))) for a, b in rungs)


def check_range(since: float, until: float) -> None:
    if until < since:
        raise ValueError("until is before since")


def step_text(seconds: float) -> str:
    return f"{seconds / 60:g}m" if seconds >= 60 and seconds % 60 == 0 else f"{seconds:g}s"


def moment(at: float, step: float, first: float, last: float) -> float | None:
    """A moment to look at: down to the step's grid, within the store; None past its end, which is live."""
    if at > last:
        return None
    return max(math.floor(at / step) * step, first)


def resolution(span: float) -> int:
    """What a stretch of time is read from: 0 (samples) up to 2 hours, 5 minutes up to 2 days, an hour beyond."""
    return 0 if span <= 7200 else 300 if span <= 172_800 else 3600


def full_text(epoch_seconds) -> Column:
    """Of the session's time zone."""
    return F.date_format(F.timestamp_seconds(_c(epoch_seconds)), "yyyy-MM-dd HH:mm:ss")


def clock_text(epoch_seconds) -> Column:
    return F.date_format(F.timestamp_seconds(_c(epoch_seconds)), "HH:mm:ss")


def day_clock_text(epoch_seconds) -> Column:
    return F.date_format(F.timestamp_seconds(_c(epoch_seconds)), "EEE HH:mm:ss")
