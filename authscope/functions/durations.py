"""Duration text such as ``10min``, ``1h`` or ``1 day`` as whole seconds."""

from __future__ import annotations

import re

# Unit spellings and their length in seconds.
UNIT_SECONDS = {
    "s": 1,
    "sec": 1,
    "second": 1,
    "seconds": 1,
    "m": 60,
    "t": 60,
    "min": 60,
    "minute": 60,
    "minutes": 60,
    "h": 3600,
    "hr": 3600,
    "hour": 3600,
    "hours": 3600,
    "d": 86400,
    "day": 86400,
    "days": 86400,
    "w": 604800,
    "week": 604800,
    "weeks": 604800,
}


def duration_seconds(text: str) -> int:
    """Whole seconds of a duration; shorter than one second is refused."""
    parts = re.findall(r"(\d+(?:\.\d+)?)?\s*([a-zA-Z]+)", text)
    rest = re.sub(r"(\d+(?:\.\d+)?)?\s*([a-zA-Z]+)", "", text).strip()
    if not parts or rest:
        raise ValueError(f"not a duration: {text!r}")
    total = 0.0
    for number, unit in parts:
        if unit.lower() not in UNIT_SECONDS:
            raise ValueError(f"unknown unit {unit!r} in duration {text!r}")
        total += float(number or 1) * UNIT_SECONDS[unit.lower()]
    if total < 1 or total != int(total):
        raise ValueError(f"a window is a whole number of seconds, at least 1: {text!r}")
    return int(total)


def interval_text(text: str) -> str:
    """The same duration in the form Spark's window function reads."""
    return f"{duration_seconds(text)} seconds"
