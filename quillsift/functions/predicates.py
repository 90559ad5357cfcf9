"""The built-in predicates: each a function from a column and plain operands to a boolean column."""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from inspect import Parameter, signature
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.coerce import CoercionError, Range, duration, shifted

KINDS = frozenset({"property", "computed", "aggregate"})
ASSOCIATION = frozenset({"association"})


@dataclass(frozen=True)
class Predicate:
    """A named predicate. operand: how arguments are brought to the attribute's type (scalar, list, range, raw, text, duration)."""

    name: str
    types: tuple[str, ...]
    build: Callable[..., Column]
    least: int = 1
    most: int | None = 1
    kinds: frozenset[str] = KINDS
    operand: str = "scalar"
    validator: Callable[[Any], bool] | None = None
    formatter: Callable[[Any], Any] | None = None
    prepare: Callable[[list], list] | None = None
    adapters: tuple[str, ...] | None = None
    needs_now: bool = False
    label: str | None = None


def arity(fn: Callable, skip: int = 1) -> tuple[int, int | None]:
    """Fewest and most arguments after the first skip ones; most is None for any number."""
    given = [p for p in signature(fn).parameters.values()][skip:]
    if any(p.kind is Parameter.KEYWORD_ONLY and p.default is Parameter.empty for p in given):
        raise TypeError("a callback may not require keyword arguments")
    plain = [p for p in given if p.kind in (Parameter.POSITIONAL_ONLY, Parameter.POSITIONAL_OR_KEYWORD)]
    rest = any(p.kind is Parameter.VAR_POSITIONAL for p in given)
    return sum(p.default is Parameter.empty for p in plain), None if rest else len(plain)


def folded(parts: list[Column], any_of: bool) -> Column:
    """OR or AND of the parts; the empty OR is false, the empty AND true."""
    if not parts:
        return F.lit(not any_of)
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), parts)


def _eq(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == F.lit(v)


def _not_eq(c: Column, v: Any) -> Column:
    return c.isNotNull() if v is None else c != F.lit(v)


def _eq_any(c: Column, values: list) -> Column:
    if values and all(v is not None for v in values):
        return c.isin(values)
    return folded([_eq(c, v) for v in values], True)


def _between(c: Column, lo: Any, hi: Any) -> Column:
    return folded([*([] if lo is None else [c >= F.lit(lo)]), *([] if hi is None else [c <= F.lit(hi)])], False)


def _window(ahead: bool, back: bool, inside: bool) -> Callable[..., Column]:
    def build(c: Column, length: Any, now: dt.datetime, kind: str) -> Column:
        d = duration(length)
        ends = sorted([shifted(now, -d) if back else now, shifted(now, d) if ahead else now])
        lo, hi = (F.lit(x.date() if kind == "date" else x) for x in ends)
        return (c >= lo) & (c <= hi) if inside else (c < lo) | (c > hi)

    return build


def like_escaped(value: Any) -> str:
    return str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _like(before: str, after: str, negative: bool) -> Callable[[Column, Any], Column]:
    def build(c: Column, value: Any) -> Column:
        if isinstance(value, Column):
            escaped = F.regexp_replace(value.cast("string"), r"([\\%_])", r"\\$1")
            found = F.ilike(c.cast("string"), F.concat(F.lit(before), escaped, F.lit(after)))
        else:
            found = c.cast("string").ilike(f"{before}{like_escaped(value)}{after}")
        return ~found if negative else found

    return build


def _each(build: Callable[[Column, Any], Column], any_of: bool) -> Callable[[Column, list], Column]:
    return lambda c, values: folded([build(c, v) for v in values], any_of)


# Arrays


def _array(values: Any) -> Column:
    return F.array(*[F.lit(v) for v in (values if isinstance(values, (list, tuple, set)) else [values])])


def _array_contains(c: Column, values: Any) -> Column:
    return F.size(F.array_except(_array(values).cast("array<string>"), c.cast("array<string>"))) == 0


def _array_contained(c: Column, values: Any) -> Column:
    return F.size(F.array_except(c.cast("array<string>"), _array(values).cast("array<string>"))) == 0


def _array_overlaps(c: Column, values: Any) -> Column:
    return F.when(c.isNotNull(), F.coalesce(F.arrays_overlap(c.cast("array<string>"), _array(values).cast("array<string>")), F.lit(False)))


# Ranges: structs (lower, upper, lower_inc, upper_inc); a null bound is unbounded

_DISCRETE = {"daterange", "int4range", "int8range"}


def _bounds(c: Column, kind: str) -> tuple[Column, Column, Column, Column]:
    lo, hi, lo_inc, hi_inc = c["lower"], c["upper"], c["lower_inc"], c["upper_inc"]
    if kind not in _DISCRETE:
        return lo, hi, lo_inc, hi_inc
    step = (lambda x: F.date_add(x, 1)) if kind == "daterange" else (lambda x: x + 1)
    return F.when(lo_inc, lo).otherwise(step(lo)), F.when(hi_inc, step(hi)).otherwise(hi), F.lit(True), F.lit(False)


def _operand_range(value: Any, kind: str) -> Column:
    r = value if isinstance(value, Range) else Range(value, value, True, True)
    bound = {"daterange": "date", "int4range": "int", "int8range": "bigint", "numrange": "decimal(38,10)"}.get(kind, "timestamp")
    return F.struct(F.lit(r.lower).cast(bound).alias("lower"), F.lit(r.upper).cast(bound).alias("upper"), F.lit(r.lower_inc).alias("lower_inc"), F.lit(r.upper_inc).alias("upper_inc"))


def _starts_by(a: tuple, b: tuple) -> Column:
    """Range a starts no later than b does."""
    return a[0].isNull() | F.coalesce((a[0] < b[0]) | ((a[0] == b[0]) & (a[2] | ~b[2])), F.lit(False))


def _ends_by(a: tuple, b: tuple) -> Column:
    """Range a ends no later than b does."""
    return b[1].isNull() | F.coalesce((a[1] < b[1]) | ((a[1] == b[1]) & (b[3] | ~a[3])), F.lit(False))


def _left_of(a: tuple, b: tuple) -> Column:
    return F.coalesce((a[1] < b[0]) | ((a[1] == b[0]) & ~(a[3] & b[2])), F.lit(False))


def _touches(a: tuple, b: tuple) -> Column:
    return F.coalesce((a[1] == b[0]) & (a[3] != b[2]), F.lit(False))


def _range(test: Callable[[tuple, tuple], Column]) -> Callable[..., Column]:
    def build(c: Column, value: Any, kind: str) -> Column:
        return F.when(c.isNotNull(), test(_bounds(c, kind), _bounds(_operand_range(value, kind), kind)))

    return build


# Networks: strings such as 10.0.0.0/8; a missing prefix is a host


def _v4(c: Column) -> tuple[Column, Column]:
    """Address as a long and prefix length; null unless c is an IPv4 network."""
    ok = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$")
    octet = [F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)", k + 1) for k in range(4)]
    address = reduce(lambda a, b: a + b, [F.try_to_number(o, F.lit("999")).cast("bigint") * (1 << 8 * (3 - k)) for k, o in enumerate(octet)])
    prefix = F.regexp_extract(c, r"/(\d+)$", 1)
    return F.when(ok, address), F.when(ok, F.when(prefix == "", F.lit(32)).otherwise(F.try_to_number(prefix, F.lit("99")).cast("int")))


def _network(how: str) -> Callable[[Column, Any], Column]:
    def build(c: Column, value: Any) -> Column:
        try:
            net = ipaddress.ip_network(str(value), strict=False)
        except ValueError:
            raise CoercionError(f"{value!r} is not a network") from None
        c = c.cast("string")
        if net.version == 6:

            @F.pandas_udf("boolean")
            def six(texts: pd.Series) -> pd.Series:
                return pd.Series([None if t is None else _six(t, net, how) for t in texts], dtype=object)

            return six(c)
        address, prefix = _v4(c)
        other, size = F.lit(int(net.network_address)), net.prefixlen
        short = F.least(prefix, F.lit(size))
        shift = 32 - short
        together = F.call_function("shiftright", address, shift) == F.call_function("shiftright", other.cast("bigint"), shift)
        order = {"contains": prefix < size, "contained": prefix > size, "overlaps": F.lit(True)}[how]
        return F.when(c.isNotNull(), F.coalesce(together & order, F.lit(False)))

    return build


def _six(text: str, net: Any, how: str) -> bool:
    try:
        own = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return False
    if own.version != net.version or not own.overlaps(net):
        return False
    return how == "overlaps" or (own.prefixlen < net.prefixlen if how == "contains" else own.prefixlen > net.prefixlen)


# JSON containment


def json_within(whole: Any, part: Any) -> bool:
    """Whether part is contained in whole: objects by key, arrays by element, scalars by value and type."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and json_within(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(json_within(w, p) for w in whole) for p in part)
    if isinstance(whole, list):
        return False
    return type(whole) is type(part) and whole == part or (isinstance(whole, (int, float)) and isinstance(part, (int, float)) and not isinstance(whole, bool) and not isinstance(part, bool) and whole == part)


def json_contained(text: str, part: Any) -> bool:
    """Whether part is contained in the JSON text, or, a scalar, an element of the array it is; what is no JSON contains nothing."""
    try:
        whole = json.loads(text)
    except ValueError:
        return False
    if isinstance(whole, list) and not isinstance(part, (list, dict)):
        return any(json_within(w, part) for w in whole)
    return json_within(whole, part)


def _leaves(value: Any, path: str):
    """(path, scalar) of an object of scalars and objects; None where JVM functions cannot express the value."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            if not isinstance(k, str) or not k.isidentifier():
                yield None
                return
            yield from _leaves(v, f"{path}.{k}")
    elif isinstance(value, (str, int)) and not isinstance(value, bool) and path != "$":
        yield path, value
    else:
        yield None


def _json_contains(c: Column, value: Any) -> Column:
    leaves = list(_leaves(value, "$"))
    text = c.cast("string")
    if None not in leaves:
        tests = []
        for path, v in leaves:
            found = F.get_json_object(text, path)
            quoted = F.to_json(F.try_variant_get(F.try_parse_json(text), path, "variant")).startswith('"')
            if isinstance(v, str):
                same = (found == F.lit(v)) & quoted
            elif abs(v) < 1 << 63:
                same = (found.try_cast("decimal(38,10)") == F.lit(v).cast("decimal(38,10)")) & ~quoted
            else:
                same = (found.try_cast("double") == F.lit(float(v))) & ~quoted
            tests.append(F.coalesce(same, F.lit(False)))
        return F.when(c.isNotNull(), folded(tests, False))
    part = json.loads(json.dumps(value))

    @F.pandas_udf("boolean")
    def contains(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json_contained(t, part) for t in texts], dtype=object)

    return contains(text)


def builtin() -> list[Predicate]:
    """The 59 built-in predicates; the association predicates are built by the association operator."""
    out = [
        Predicate("eq_nil", ("numerical", "textual", "identifier", "network", "array", "range", "boolean"), lambda c: c.isNull(), 0, 0),
        Predicate("not_eq_nil", ("numerical", "textual", "identifier", "network", "array", "range", "boolean"), lambda c: c.isNotNull(), 0, 0),
    ]
    comparable = ("numerical", "textual", "identifier", "network", "array", "range", "json")
    for name, one in (("eq", _eq), ("not_eq", _not_eq)):
        out.append(Predicate(name, comparable, one))
        out.append(Predicate(f"{name}_any", comparable, _eq_any if name == "eq" else _each(one, True), operand="list"))
        out.append(Predicate(f"{name}_all", comparable, _each(one, False), operand="list"))
    for name, test in (("gt", lambda c, v: c > F.lit(v)), ("lt", lambda c, v: c < F.lit(v)), ("gteq", lambda c, v: c >= F.lit(v)), ("lteq", lambda c, v: c <= F.lit(v))):
        out.append(Predicate(name, ("numerical",), test))
    out.append(Predicate("between", ("numerical",), _between, 1, 2, operand="bounds"))
    out.append(Predicate("not_between", ("numerical",), lambda c, lo, hi: ~_between(c, lo, hi), 1, 2, operand="bounds"))
    for name, ahead, back in (("within", True, True), ("within_next", True, False), ("within_previous", False, True)):
        out.append(Predicate(name, ("temporal",), _window(ahead, back, True), operand="duration", needs_now=True))
        out.append(Predicate(f"not_{name}", ("temporal",), _window(ahead, back, False), operand="duration", needs_now=True))
    for name, before, after, negative in (
        ("matches", "%", "%", False), ("starts_with", "", "%", False), ("ends_with", "%", "", False),
        ("does_not_match", "%", "%", True), ("does_not_start_with", "", "%", True), ("does_not_end_with", "%", "", True),
    ):
        one = _like(before, after, negative)
        out.append(Predicate(name, ("textual",), one, operand="text"))
        out.append(Predicate(f"{name}_any", ("textual",), _each(one, True), operand="texts"))
        out.append(Predicate(f"{name}_all", ("textual",), _each(one, False), operand="texts"))
    out.append(Predicate("eq_true", ("boolean",), lambda c: c == F.lit(True), 0, 0))
    out.append(Predicate("eq_false", ("boolean",), lambda c: c == F.lit(False), 0, 0))
    out.append(Predicate("contains", ("json",), _json_contains, operand="raw"))
    for name, how in (("inet_contains", "contains"), ("inet_contained_within", "contained"), ("inet_overlaps", "overlaps")):
        out.append(Predicate(name, ("network",), _network(how), operand="raw", adapters=("spark",)))
    for name, fn in (("array_contains", _array_contains), ("array_contained_by", _array_contained), ("array_overlaps", _array_overlaps)):
        out.append(Predicate(name, ("array",), fn, operand="raw", adapters=("spark",)))
    for name, test in (
        ("range_contains", lambda a, b: _starts_by(a, b) & _ends_by(b, a)), ("range_contained_by", lambda a, b: _starts_by(b, a) & _ends_by(a, b)),
        ("range_overlaps", lambda a, b: ~_left_of(a, b) & ~_left_of(b, a)), ("range_strictly_left_of", _left_of),
        ("range_strictly_right_of", lambda a, b: _left_of(b, a)), ("range_adjacent_to", lambda a, b: _touches(a, b) | _touches(b, a)),
    ):
        out.append(Predicate(name, ("range",), _range(test), operand="range_scalar" if name == "range_contains" else "range", adapters=("spark",)))
    for name, types in (("has_any", ("association",)), ("not_has_any", ("association",)), ("has_all", ("many_association",)), ("not_has_all", ("many_association",)), ("only_has_any", ("many_association",)), ("only_has_all", ("many_association",))):
        out.append(Predicate(name, types, lambda c, *a: c, 0, 1, ASSOCIATION, "candidates"))
    return out
