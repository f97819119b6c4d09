"""Days, weeks and hours in a report's time zone, and schedules."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values
ALIASES = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *"}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def zoned(ts: Column, zone: str = "UTC") -> Column:
    """Wall time in the zone; the session's zone is to be UTC."""
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def day(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(zoned(ts, zone), "yyyy-MM-dd")


def week(ts: Column, zone: str = "UTC") -> Column:
    """Monday of the week."""
    return F.date_format(F.date_trunc("WEEK", zoned(ts, zone)), "yyyy-MM-dd")


def bucket(ts: Column, kind: str, zone: str = "UTC") -> Column:
    return F.coalesce(day(ts, zone) if kind == "day" else week(ts, zone), F.lit("[unknown]"))


def hour(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(zoned(ts, zone), "HH:00")


def millis(ts: Column) -> Column:
    """Epoch milliseconds, 0 where there is no time."""
    return F.coalesce(F.unix_millis(ts.cast("timestamp")), F.lit(0).cast("long"))


def cron_fields(expression: str) -> list[set[int]]:
    """The five value sets of a schedule; both day fields must match, and 7 is Sunday too."""
    parts = ALIASES.get(expression.strip(), expression).split()
    if len(parts) != 5:
        raise ValueError(f"not a schedule: {expression}")
    out = []
    for part, (low, high) in zip(parts, RANGES, strict=True):
        values: set[int] = set()
        for piece in part.split(","):
            m = re.fullmatch(r"(?:(\*)|(\d+)(?:-(\d+))?)(?:/(\d+))?", piece)
            if not m:
                raise ValueError(f"not a schedule field: {part}")
            first = low if m[1] else int(m[2])
            last = high if m[1] else int(m[3] or m[2])
            if not low <= first <= last <= high or (m[4] is not None and not 1 <= int(m[4]) <= high):
                raise ValueError(f"out of range: {part}")
            values.update(range(first, last + 1, int(m[4] or 1)))
        out.append(values)
    return out


def next_cron(expression: str, after: datetime) -> datetime:
    """First whole minute after a time that the schedule names, within 366 days."""
    minute, hours, days, months, weekdays = cron_fields(expression)
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = at + timedelta(days=366)
    while at <= end:
        if at.month not in months or at.day not in days or not ({at.isoweekday() % 7, at.isoweekday()} & weekdays):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minute:
            at += timedelta(minutes=1)
        else:
            return at
    raise ValueError(f"no run within a year: {expression}")


def _next_run(expression: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([next_cron(e, t.to_pydatetime()) for e, t in zip(expression, after, strict=True)])


def next_run(expression: Column, after: str | Column) -> Column:
    return F.pandas_udf(_next_run, "timestamp")(expression, after)


def parse_schedule(text: str, now: datetime) -> dict:
    """`in 10m`, `every 5 m`, `at <ISO time>`, an alias or five fields -> kind and next run."""
    text = text.strip()
    if m := re.fullmatch(r"(in|every)\s+(\d+)\s*([smhd])\w*", text):
        step = timedelta(seconds=int(m[2]) * UNITS[m[3]])
        return {"kind": "once" if m[1] == "in" else "interval", "every_ms": None if m[1] == "in" else int(step.total_seconds() * 1000), "next": now + step}
    if m := re.fullmatch(r"at\s+(\S+)", text):
        return {"kind": "once", "every_ms": None, "next": datetime.fromisoformat(m[1].replace("Z", "+00:00")).replace(tzinfo=None)}
    return {"kind": "cron", "every_ms": None, "next": next_cron(text, now)}


def following(kind: Column, every_ms: Column, at: Column, expression: Column) -> Column:
    """Next run of a job: none for once, a fixed step for an interval, the schedule's for cron."""
    step = F.timestamp_millis(F.unix_millis(at) + every_ms)
    return F.when(kind == "interval", step).when(kind == "cron", next_run(expression, at))
