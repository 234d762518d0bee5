"""Relative time expressions: now, yesterday, last week, 3 days ago, in 2 hours, last monday, an epoch or an ISO date."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

# Lengths of units in seconds; a month has 30 days and a year 365.
UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_AGO = re.compile(r"(?P<n>\d+|an?)\s+(?P<unit>[a-z]+?)s?\s+ago\Z")
_IN = re.compile(r"in\s+(?P<n>\d+|an?)\s+(?P<unit>[a-z]+?)s?\Z")


def parse_time(text: str, now: datetime) -> datetime:
    """The moment that an expression means at ``now``; epochs are seconds, or milliseconds from 1e11 on. Raises ValueError for anything else."""
    t = " ".join(text.lower().split())
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if t == "now":
        return now
    if t in ("today", "yesterday", "tomorrow"):
        return midnight + timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[t])
    for pattern, sign in ((_AGO, -1), (_IN, 1)):
        m = pattern.match(t)
        if m and m["unit"] in UNITS:
            return now + sign * timedelta(seconds=UNITS[m["unit"]] * (1 if m["n"].startswith("a") else int(m["n"])))
    if t.startswith("last "):
        what = t[5:]
        if what in DAYS:
            return midnight - timedelta(days=(now.weekday() - DAYS.index(what) - 1) % 7 + 1)
        if what in UNITS:
            return now - timedelta(seconds=UNITS[what])
    if re.fullmatch(r"-?\d+(?:\.\d+)?", t):
        x = float(t)
        return datetime.fromtimestamp(x / 1000 if abs(x) >= 1e11 else x, UTC).replace(tzinfo=now.tzinfo)
    try:
        return datetime.fromisoformat(text.strip())
    except ValueError:
        raise ValueError(f"no time: {text!r}") from None
