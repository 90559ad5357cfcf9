"""Registries, limits and policies of an engine."""

from __future__ import annotations

import contextlib
import contextvars
import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.predicates import ASSOCIATION, KINDS, Predicate, arity, builtin, folded
from quillsift.functions.types import TypeRegistry


@dataclass(frozen=True)
class Aggregate:
    """build(column or key columns, distinct) -> aggregate column; result: a type, or "property" for the property's own."""

    name: str
    types: tuple[str, ...]
    build: Callable[..., Column]
    result: str = "numerical"
    property: bool = True
    distinct: bool = True
    empty_value: Any = None
    label: str | None = None


def _builtin_aggregates() -> list[Aggregate]:
    ordered, summed = ("orderable",), ("summable",)
    return [
        Aggregate("count", (), lambda c, distinct: F.count(c), "integer", property=False, empty_value=0),
        Aggregate("sum", summed, lambda c, distinct: F.sum_distinct(c) if distinct else F.sum(c)),
        Aggregate("avg", summed, lambda c, distinct: F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)),
        Aggregate("min", ordered, lambda c, distinct: F.min(c), "property"),
        Aggregate("max", ordered, lambda c, distinct: F.max(c), "property"),
    ]


@dataclass(frozen=True)
class Settings:
    max_nodes: int = 1000
    max_bytes: int = 1 << 20
    max_depth: int = 15
    invalid_filter_policy: str = "skip"
    callback_error_policy: str = "raise"
    strict: bool = False
    log: bool = False
    max_limit: int | None = None

    def __post_init__(self) -> None:
        if self.invalid_filter_policy not in ("skip", "raise", "match_none") or self.callback_error_policy not in ("raise", "match_none"):
            raise ValueError("unknown policy")


class Registry:
    """Predicates, aggregates, types and node types; settings may be locked, and overridden for a while."""

    def __init__(self, settings: Settings = Settings(), clock: Callable[[], dt.datetime] | None = None):
        self._settings, self._locked = settings, False
        self._temporary: contextvars.ContextVar[Settings | None] = contextvars.ContextVar("settings", default=None)
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.types = TypeRegistry()
        self.predicates: dict[str, Predicate] = {p.name: p for p in builtin()}
        self.aggregates: dict[str, Aggregate] = {a.name: a for a in _builtin_aggregates()}
        self.nodes: dict[str, Callable] = {}
        self.version = 0

    @property
    def settings(self) -> Settings:
        return self._temporary.get() or self._settings

    def configure(self, **changes: Any) -> None:
        self._open()
        self._settings = replace(self._settings, **changes)

    def lock(self) -> None:
        self._locked = True

    def _open(self) -> None:
        if self._locked:
            raise RuntimeError("the settings are locked")
        self.version += 1

    @contextlib.contextmanager
    def temporary(self, **changes: Any):
        token = self._temporary.set(replace(self.settings, **changes))
        try:
            yield self
        finally:
            self._temporary.reset(token)

    def register_predicate(self, name: str, *types: str, fn: Callable | str, compounds: bool = False, kinds: frozenset[str] = KINDS, validator: Callable | None = None, formatter: Callable | None = None, prepare: Callable | None = None, operand: str = "scalar", adapters: tuple[str, ...] | None = None, label: str | None = None) -> None:
        """fn(column, *args) -> Column, or the name of a Column method; compounds adds <name>_any and <name>_all."""
        self._open()
        if isinstance(fn, str):
            if not callable(getattr(Column, fn, None)):
                raise TypeError(f"a column has no method {fn!r}")
            fn = (lambda method: lambda c, *args: getattr(c, method)(*args))(fn)
            least, most = 0, None
        else:
            least, most = arity(fn)
        for f in (validator, formatter, prepare):
            if f is not None and arity(f, 0)[0] > 1:
                raise TypeError("a callback takes one argument")
        self.predicates[name] = Predicate(name, types or ("all",), fn, least, most, kinds, operand, validator, formatter, prepare, adapters, label=label)
        if compounds:
            for suffix, any_of in (("any", True), ("all", False)):
                build = (lambda one, any_of: lambda c, values: folded([one(c, v) for v in values], any_of))(fn, any_of)
                self.predicates[f"{name}_{suffix}"] = Predicate(f"{name}_{suffix}", types or ("all",), build, 1, 1, kinds, "list", validator, formatter, None, adapters)

    def register_association_predicate(self, name: str, fn: Callable, types: tuple[str, ...] = ("association",)) -> None:
        """fn(membership, *args) -> Column over the owner; see operators.association.Membership."""
        self._open()
        least, most = arity(fn)
        self.predicates[name] = Predicate(name, types, fn, least, most, ASSOCIATION, "raw")

    def _unregister(self, held: dict, name: str, type_name: str | None) -> None:
        self._open()
        if type_name is None:
            held.pop(name, None)
        elif name in held:
            held[name] = replace(held[name], types=tuple(t for t in held[name].types if t != type_name))

    def unregister_predicate(self, name: str, type_name: str | None = None) -> None:
        self._unregister(self.predicates, name, type_name)

    def register_aggregate(self, name: str, *types: str, fn: Callable, result: str = "numerical", property: bool = True, distinct: bool = False, empty_value: Any = None, label: str | None = None) -> None:
        self._open()
        self.aggregates[name] = Aggregate(name, types, fn, result, property, distinct, empty_value, label)

    def unregister_aggregate(self, name: str, type_name: str | None = None) -> None:
        self._unregister(self.aggregates, name, type_name)

    def register_filter(self, node_type: str, node: Callable) -> None:
        """node(compiler, payload, scope, path) -> operators.nodes.Outcome, for payloads of this type."""
        self._open()
        self.nodes[node_type] = node

    def predicates_for(self, type_name: str, kind: str) -> list[str]:
        return [p.name for p in self.predicates.values() if kind in p.kinds and self.types.shares(type_name, p.types) and (p.adapters is None or "spark" in p.adapters)]

    def aggregates_for(self, type_name: str) -> list[str]:
        return [a.name for a in self.aggregates.values() if a.property and self.types.shares(type_name, a.types)]
