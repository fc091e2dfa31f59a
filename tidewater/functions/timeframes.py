"""Session calendar and bar alignment, as integer arithmetic on epoch milliseconds (columns in, columns out).

The exchange's day is UTC+05:30 without daylight saving; its session runs from 09:15 to 15:30.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
IST_MS = 19_800_000
OPEN_MS = 33_300_000
CLOSE_MS = 55_800_000


@dataclass(frozen=True)
class Timeframe:
    """A bar size; ``from_open``: bars are counted from the session's open, else from the epoch."""

    name: str
    ms: int
    from_open: bool


#: The six bar sizes.
TIMEFRAMES = (
    Timeframe("15s", 15_000, False), Timeframe("30s", 30_000, False), Timeframe("1m", 60_000, False),
    Timeframe("3m", 180_000, True), Timeframe("5m", 300_000, True), Timeframe("15m", 900_000, True),
)


def day_start(t: Column) -> Column:
    """Midnight of the exchange's day."""
    local = t + IST_MS
    return local - F.pmod(local, F.lit(DAY_MS)) - IST_MS


def session_open(t: Column) -> Column:
    return day_start(t) + OPEN_MS


def session_close(t: Column) -> Column:
    return day_start(t) + CLOSE_MS


def session_phase(t: Column) -> Column:
    """PRE_OPEN, IN_SESSION or POST_CLOSE."""
    at = F.pmod(t + IST_MS, F.lit(DAY_MS))
    return F.when(at < OPEN_MS, "PRE_OPEN").when(at < CLOSE_MS, "IN_SESSION").otherwise("POST_CLOSE")


def in_session(t: Column) -> Column:
    return F.pmod(t + IST_MS, F.lit(DAY_MS)).between(OPEN_MS, CLOSE_MS - 1)


def bucket_start(t: Column, ms: Column, from_open: Column) -> Column:
    origin = F.when(from_open, session_open(t)).otherwise(F.lit(0).cast("long"))
    return t - F.pmod(t - origin, ms)


def event_day(t: Column) -> Column:
    """The exchange's date as yyyyMMdd (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(t + IST_MS), "yyyyMMdd")


def is_event_day(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d{8}$") & F.try_to_timestamp(s, F.lit("yyyyMMdd")).isNotNull(), F.lit(False))


def gap_threshold_ms(frame_ms: int) -> int:
    return max(2 * frame_ms, 10_000)


def ttl_ms(text: Column) -> Column:
    """Milliseconds of ``<number><ms|s|m|h|d>``; null if it isn't that."""
    number, unit = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 1), F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 2)
    scale = F.when(unit == "ms", 1).when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", DAY_MS)
    return F.when(number != "", F.try_multiply(number.try_cast("long"), scale.cast("long")))


def expiry_bound(t: Column, ttl: Column, margin_ms: int = 0) -> Column:
    """When rows of t's day may go: the start of the next day, the time to live, and a margin."""
    return day_start(t) + DAY_MS + ttl + margin_ms
