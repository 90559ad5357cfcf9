"""Operands are brought to a column's type on the driver, so that no row can make a cast fail at run time."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

_TRUE, _FALSE = {True, 1, "1", "t", "T", "true", "TRUE", "on", "ON"}, {False, 0, "0", "f", "F", "false", "FALSE", "off", "OFF", "", None}


class CoercionError(ValueError):
    """An operand that its attribute's type cannot take."""


@dataclass(frozen=True)
class Range:
    """A range operand; None is unbounded."""

    lower: Any
    upper: Any
    lower_inc: bool = True
    upper_inc: bool = False


def boolean(value: Any) -> bool:
    """How negate and distinct flags are read: what is not one of the false values is true."""
    try:
        return value not in _FALSE
    except TypeError:
        return True


def integer(value: Any) -> int:
    number = decimal(value)
    if number != number.to_integral_value():
        raise CoercionError(f"{value!r} is not integral")
    return int(number)


def decimal(value: Any) -> Decimal:
    if isinstance(value, bool) or value is None or isinstance(value, (list, dict, set, tuple)):
        raise CoercionError(f"{value!r} is not a number")
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        raise CoercionError(f"{value!r} is not a number") from None
    if not number.is_finite():
        raise CoercionError(f"{value!r} is not finite")
    return number


def moment(value: Any) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    try:
        return dt.datetime.fromisoformat(str(value))
    except ValueError:
        raise CoercionError(f"{value!r} is not a time") from None


def scalar(kind: str, value: Any, labels: dict[str, Any] | None = None) -> Any:
    """value for an attribute of logical type kind; None stays None."""
    if value is None:
        return None
    if labels is not None:
        if isinstance(value, str) and value in labels:
            return labels[value]
        if value in labels.values():
            return value
        raise CoercionError(f"{value!r} is not one of {sorted(labels)}")
    if kind == "integer":
        return integer(value)
    if kind == "decimal" or kind == "numerical":
        return decimal(value)
    if kind == "float":
        return float(decimal(value))
    if kind == "date":
        return moment(value).date()
    if kind in ("datetime", "timestamp", "temporal"):
        return moment(value)
    if kind == "boolean":
        if value in _TRUE:
            return True
        if value in _FALSE:
            return False
        raise CoercionError(f"{value!r} is not a boolean")
    if kind in ("json", "jsonb"):
        return value
    if isinstance(value, (list, dict, set, tuple, Range)):
        raise CoercionError(f"{type(value).__name__} is not a scalar")
    if kind == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    return str(value)


def ordered_range(kind: str, value: Range, labels: dict[str, Any] | None = None) -> tuple[Any, Any]:
    """Both ends in the attribute's type, the smaller one first."""
    lo, hi = scalar(kind, value.lower, labels), scalar(kind, value.upper, labels)
    return (hi, lo) if lo is not None and hi is not None and lo > hi else (lo, hi)


_DURATION = re.compile(r"([+-])?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


@dataclass(frozen=True)
class Duration:
    months: int = 0
    seconds: float = 0

    def __neg__(self) -> Duration:
        return Duration(-self.months, -self.seconds)


def duration(value: Any) -> Duration:
    """An ISO 8601 duration of at most 100 characters, a timedelta, or a Duration."""
    if isinstance(value, Duration):
        return value
    if isinstance(value, dt.timedelta):
        return Duration(0, value.total_seconds())
    found = _DURATION.fullmatch(value) if isinstance(value, str) and len(value) <= 100 else None
    if not found or not any(found.groups()[1:]) or value.endswith("T"):
        raise CoercionError(f"{value!r} is not a duration")
    years, months, weeks, days, hours, minutes = (int(x or 0) for x in found.groups()[1:7])
    out = Duration(12 * years + months, 86400 * (7 * weeks + days) + 3600 * hours + 60 * minutes + float(found[8] or 0))
    return -out if found[1] == "-" else out


def shifted(now: dt.datetime, by: Duration) -> dt.datetime:
    """Calendar arithmetic: months clip to the month's end, then seconds are added."""
    year, month = divmod(now.year * 12 + now.month - 1 + by.months, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last)) + dt.timedelta(seconds=by.seconds)


def literal_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) and math.isfinite(value)
