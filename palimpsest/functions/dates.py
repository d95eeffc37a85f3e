"""Dates as people write them, parsed on the driver against an injected now."""

from __future__ import annotations

import calendar
import datetime as dt
import re

UTC = dt.timezone.utc
#: Words and their meaning: fixed values.
NUMBERS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten".split())}
MONTHS = {m.lower(): n for n, m in enumerate(calendar.month_name) if m}
DAYS = {d.lower(): n for n, d in enumerate(calendar.day_name)}
SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800}
HOURS = {"noon": 12, "midnight": 0, "tea": 17}


def _month_back(now: dt.datetime, months: int) -> dt.datetime:
    n = now.year * 12 + now.month - 1 - months
    year, month = divmod(n, 12)
    return now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))


def parse_exact(text: str) -> int | None:
    """Seconds of `@n`, ISO 8601, RFC 3339 and `YYYY-MM-DD HH:MM:SS +hhmm`; None for other texts."""
    text = text.strip()
    if m := re.fullmatch(r"@?(\d{5,})(?: [+-]\d{4})?", text):
        return int(m[1])
    if m := re.fullmatch(r"(\d{4})[-./](\d\d?)[-./](\d\d?)(?:[T ](\d\d?):(\d\d)(?::(\d\d)(?:\.\d+)?)?)?\s*(Z|[+-]\d\d:?\d\d)?", text):
        try:
            at = dt.datetime(*(int(x or 0) for x in m.groups()[:6]), tzinfo=UTC)
        except ValueError:
            return None
        zone = (m[7] or "Z").replace(":", "")
        shift = 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[3:5]) * 60)
        return int(at.timestamp()) - shift
    return None


def approximate(text: str, now: int) -> int:
    """Seconds of an approximate date such as `3 days ago`, `yesterday noon`, `last friday`, `tea`; now for what says nothing."""
    exact = parse_exact(text)
    if exact is not None:
        return exact
    at = dt.datetime.fromtimestamp(now, UTC)
    number: int | None = None
    for word in re.findall(r"[a-z]+|\d+(?::\d\d)*", text.lower()):
        single = word.rstrip("s")
        if word == "never":
            return 0
        if word in ("now", "today", "ago", "and"):
            continue
        if word == "yesterday":
            at -= dt.timedelta(days=1)
        elif word in HOURS:
            hour = HOURS[word]
            if at.hour < hour and number is None and "yesterday" not in text.lower():
                at -= dt.timedelta(days=1)
            at = at.replace(hour=hour, minute=0, second=0)
        elif ":" in word:
            parts = [int(x) for x in word.split(":")] + [0]
            at = at.replace(hour=parts[0] % 24, minute=parts[1], second=parts[2])
        elif word.isdigit():
            number = int(word)
        elif word in NUMBERS:
            number = NUMBERS[word]
        elif word == "last":
            number = 1
        elif word in ("am", "pm") and number is not None:
            at = at.replace(hour=number % 12 + 12 * (word == "pm"), minute=0, second=0)
            number = None
        elif single in SECONDS:
            at -= dt.timedelta(seconds=SECONDS[single] * (1 if number is None else number))
            number = None
        elif single == "month":
            at, number = _month_back(at, 1 if number is None else number), None
        elif single == "year":
            at, number = _month_back(at, 12 * (1 if number is None else number)), None
        elif len(word) >= 3 and (month := next((n for m, n in MONTHS.items() if m.startswith(word)), None)):
            year = at.year - (month > at.month)
            at = at.replace(year=year, month=month, day=min(number or at.day, calendar.monthrange(year, month)[1]))
            number = None
        elif len(word) >= 3 and (day := next((n for d, n in DAYS.items() if d.startswith(word)), None)) is not None:
            back = (at.weekday() - day) % 7
            at -= dt.timedelta(days=back + 7 * (0 if number is None else number - (back > 0)) if back or number else 7)
            number = None
    return int(at.timestamp())
