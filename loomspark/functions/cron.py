"""Next firing time of a five-field cron expression in a time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

_BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DAYS = {d: k for k, d in enumerate("sun mon tue wed thu fri sat".split())}


class CronError(ValueError):
    """The expression is malformed."""


def _field(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        body, _, step = part.partition("/")
        number = lambda s: names[s] if s in names else int(s)
        try:
            if body == "*":
                a, b = low, high
            elif "-" in body:
                a, b = map(number, body.split("-"))
            else:
                a = number(body)
                b = high if step else a
            jump = int(step) if step else 1
        except ValueError as e:
            raise CronError(f"bad field {text!r}") from e
        if not low <= a <= b <= high or jump < 1:
            raise CronError(f"field out of range: {text!r}")
        out.update(range(a, b + 1, jump))
    return out


def next_time(expression: str, after_ms: int, zone: str = "UTC") -> int:
    """Epoch milliseconds of the first firing after ``after_ms``.

    If both day fields are restricted, either suffices.  Local times that a
    clock change skips do not fire.
    """
    fields = expression.split()
    if len(fields) != 5:
        raise CronError("five fields expected")
    names = ({}, {}, {}, _MONTHS, _DAYS)
    minute, hour, day, month, week = (_field(f, *b, n) for f, b, n in zip(fields, _BOUNDS, names, strict=True))
    week = {d % 7 for d in week}
    tz = ZoneInfo(zone)
    t = datetime.fromtimestamp(after_ms // 60000 * 60, timezone.utc) + timedelta(minutes=1)
    limit = t + timedelta(days=366 * 8)
    either = fields[2] != "*" and fields[4] != "*"
    while t < limit:
        local = t.astimezone(tz)
        in_month, in_week = local.day in day, (local.weekday() + 1) % 7 in week
        if local.month not in month or not (in_month or in_week if either else in_month and in_week):
            midnight = (local.replace(hour=0, minute=0, tzinfo=None) + timedelta(days=1)).replace(tzinfo=tz)
            later = midnight.astimezone(timezone.utc)
            t = later if later > t else t + timedelta(hours=1)
        elif local.hour not in hour:
            t += timedelta(minutes=60 - local.minute)
        elif local.minute not in minute:
            t += timedelta(minutes=1)
        else:
            return int(t.timestamp() * 1000)
    raise CronError(f"{expression!r} never fires")
