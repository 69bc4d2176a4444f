"""Date expressions to spans of time, at planning time.

``parse_span`` gives the inclusive start and the exclusive end in UTC, so the
end of a period needs no fraction of a second; an instant has both equal and is
matched inclusively. Order of forms: duration, instant, partial date-time,
partly unknown day, calendar period or interval, natural language.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


class DateError(ValueError):
    """No date, or a span that ends before it starts."""


@dataclass(frozen=True)
class Span:
    start: datetime
    end: datetime
    #: True if the end itself belongs to the span (instants and durations).
    closed: bool = False

    def last(self) -> datetime:
        """The last microsecond that belongs to the span."""
        return self.end if self.closed else self.end - timedelta(microseconds=1)


_UNITS = {"d": timedelta(days=1), "w": timedelta(weeks=1), "h": timedelta(hours=1), "min": timedelta(minutes=1), "m": timedelta(days=30), "y": timedelta(days=365)}
_WEEKDAYS = {name.lower(): i for i, name in enumerate(calendar.day_name)}


def _utc(*parts: int) -> datetime:
    try:
        return datetime(*parts, tzinfo=UTC)
    except ValueError as e:
        raise DateError(str(e)) from None


def _day(y: int, m: int, d: int) -> Span:
    start = _utc(y, m, d)
    return Span(start, start + timedelta(days=1))


def _months(y: int, m: int, n: int) -> Span:
    last = y * 12 + (m - 1) + n
    return Span(_utc(y, m, 1), _utc(last // 12, last % 12 + 1, 1))


def _years(y: int, n: int) -> Span:
    return Span(_utc(y, 1, 1), _utc(y + n, 1, 1))


def _unknown_day(y: int, m: int, tens: str, units: str) -> Span:
    if not 1 <= m <= 12:
        raise DateError(f"no month {m}")
    last = calendar.monthrange(y, m)[1]
    days = [d for d in range(1, last + 1) if tens in ("X", str(d // 10)) and units in ("X", str(d % 10))]
    if not days:
        raise DateError(f"no such day in {y}-{m:02}")
    return Span(_utc(y, m, days[0]), _utc(y, m, days[-1]) + timedelta(days=1))


def _period(s: str) -> Span | None:
    if m := re.fullmatch(r"(\d\d)XX", s):
        return _years(int(m[1]) * 100, 100)
    if m := re.fullmatch(r"(\d\d\d)X", s):
        return _years(int(m[1]) * 10, 10)
    if m := re.fullmatch(r"(\d{4})(-XX(-XX)?)?", s):
        return _years(int(m[1]), 1)
    if m := re.fullmatch(r"(\d{4})-(2[1-4])", s):
        # seasons begin in March, June, September and December
        return _months(int(m[1]), 3 * (int(m[2]) - 20), 3)
    if m := re.fullmatch(r"(\d{4})-(\d\d)(-XX)?", s):
        if not 1 <= int(m[2]) <= 12:
            raise DateError(f"no month {m[2]}")
        return _months(int(m[1]), int(m[2]), 1)
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", s):
        return _day(int(m[1]), int(m[2]), int(m[3]))
    if m := re.fullmatch(r"(\d{4})-(\d\d)-([\dX])([\dX])", s):
        return _unknown_day(int(m[1]), int(m[2]), m[3], m[4])
    return None


def _spoken(s: str, now: datetime) -> Span | None:
    s = re.sub(r"\s+", " ", s.lower().strip())
    day = None
    if s in ("today", "now", "yesterday", "tomorrow"):
        day = now + timedelta(days={"yesterday": -1, "tomorrow": 1}.get(s, 0))
    elif m := re.fullmatch(r"(\d+|a|an|one) (minute|hour|day|week|month|year)s? ago", s):
        n = int(m[1]) if m[1].isdigit() else 1
        if m[2] in ("month", "year"):
            place = now.year * 12 + now.month - 1 - n * (12 if m[2] == "year" else 1)
            y, mo = place // 12, place % 12 + 1
            if y < 1:
                raise DateError(f"{s} is out of range")
            day = now.replace(year=y, month=mo, day=min(now.day, calendar.monthrange(y, mo)[1]))
        else:
            day = now - _scaled(n, {"minute": "min", "hour": "h", "day": "d", "week": "w"}[m[2]])
    elif m := re.fullmatch(r"last (week|month|year)", s):
        return _spoken(f"1 {m[1]} ago", now)
    elif (m := re.fullmatch(r"(?:(last|next) )?(\w+)", s)) and m[2] in _WEEKDAYS:
        back = (now.weekday() - _WEEKDAYS[m[2]]) % 7
        day = now + timedelta(days=(7 - back) if m[1] == "next" else -(back or 7) if m[1] == "last" else (-back % 7))
    return _day(day.year, day.month, day.day) if day else None


def _scaled(n: int, unit: str) -> timedelta:
    try:
        return n * _UNITS[unit]
    except OverflowError:
        raise DateError(f"{n}{unit} is out of range") from None


def parse_span(text: str, now: datetime | None = None) -> Span:
    now = now or datetime.now(UTC)
    s = text.strip()
    if not s:
        raise DateError("empty date")
    if m := re.fullmatch(r"(\d+)\s*(min|d|w|h|m|y)", s, re.I):
        try:
            return Span(now - _scaled(int(m[1]), m[2].lower()), now, closed=True)
        except OverflowError:
            raise DateError(f"{s} is out of range") from None
    if re.fullmatch(r"[0-9xX/\-]+", s):
        s = s.upper()
    if re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)?", s):
        try:
            at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", s.upper().replace("Z", "+00:00")))
        except ValueError as e:
            raise DateError(str(e)) from None
        at = at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)
        return Span(at, at, closed=True)
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d)(?::(\d\d))?", s):
        start = _utc(*(int(x) for x in m.groups() if x))
        return Span(start, start + (timedelta(minutes=1) if m[5] else timedelta(hours=1)))
    if "/" in s and (ends := s.split("/")) and len(ends) == 2:
        a, b = _period(ends[0]), _period(ends[1])
        if a and b:
            return Span(a.start, b.end)
    found = _period(s) or _spoken(text, now)
    if not found:
        raise DateError(f"unrecognised date {text!r}")
    return found


@dataclass(frozen=True)
class Bounds:
    """Since and until, either of which may be open."""

    since: datetime | None = None
    until: datetime | None = None

    def holds(self, ts: Column) -> Column:
        """Event time within the bounds, both included; a null time is in only when both are open."""
        out = F.lit(True)
        if self.since:
            out = out & (ts >= F.lit(self.since))
        if self.until:
            out = out & (ts <= F.lit(self.until))
        return F.coalesce(out, F.lit(False))

    def overlaps(self, created: Column, updated: Column) -> Column:
        """A session's closed span meets the bounds."""
        out = F.lit(True)
        if self.since:
            out = out & (F.coalesce(updated, created) >= F.lit(self.since))
        if self.until:
            out = out & (F.coalesce(created, updated) <= F.lit(self.until))
        return F.coalesce(out, F.lit(False))


def resolve(since: str | None = None, until: str | None = None, when: str | None = None, now: datetime | None = None) -> Bounds:
    """``since`` takes a span's start, ``until`` its end, ``when`` both."""
    if when and (since or until):
        raise DateError("when excludes since and until")
    if when:
        span = parse_span(when, now)
        return Bounds(span.start, span.last())
    a = parse_span(since, now).start if since else None
    b = parse_span(until, now).last() if until else None
    if a and b and a > b:
        raise DateError(f"since {a} is after until {b}")
    return Bounds(a, b)


def reference() -> list[tuple[str, str]]:
    """Forms that ``parse_span`` takes, with what they mean."""
    return [
        ("7d 2w 24h 30min 1m 1y", "back from now; a month is 30 days, a year 365"),
        ("2026-01-15T14:30:00.5+02:00", "an instant"),
        ("2026-01-15T14, 2026-01-15T14:30", "an hour, a minute"),
        ("2026-01-1X, 2026-01-X5", "days with an unknown digit"),
        ("2026-01-15, 2026-01, 2026, 202X, 20XX, 2026-21", "day, month, year, decade, century, season"),
        ("2026-01/2026-03", "from the first's start to the second's end"),
        ("today, yesterday, 3 days ago, last friday", "whole days in UTC"),
    ]
