"""Models, associations and relations: what filters are compiled against."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.types import logical_type

_aliases = itertools.count()


class FilterError(ValueError):
    """A relation or association that cannot be filtered as asked."""


@dataclass(frozen=True)
class Scope:
    """What an association says of its children: a filter of the whole child table, and a selection per owner.

    group_by and having make a grouped scope: children are grouped by owner and child key, having is
    applied, and order may use the aggregates.
    """

    where: Callable[[DataFrame, Any], DataFrame] | None = None
    order: tuple[Callable[[], Column], ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    aggregates: tuple[tuple[str, Callable[[], Column]], ...] = ()
    having: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Bridge:
    """A table between owner and child: its columns for either side."""

    load: Callable[[], DataFrame]
    owner_cols: tuple[str, ...]
    child_cols: tuple[str, ...]


@dataclass(frozen=True)
class Association:
    """kind: belongs_to, has_one, has_many or has_and_belongs_to_many.

    owner_cols = child_cols joins the tables, through `bridge` where there is one; through names
    associations to follow one after another instead; targets (token -> model name) with type_col
    make it polymorphic.
    """

    name: str
    kind: str
    target: str | None = None
    owner_cols: tuple[str, ...] = ()
    child_cols: tuple[str, ...] = ()
    bridge: Bridge | None = None
    through: tuple[str, ...] = ()
    scope: Scope = Scope()
    type_col: str | None = None
    targets: tuple[tuple[str, str], ...] = ()

    @property
    def polymorphic(self) -> bool:
        return bool(self.targets)

    @property
    def many(self) -> bool:
        return self.kind in ("has_many", "has_and_belongs_to_many")


@dataclass(frozen=True)
class Rule:
    """One link of a permission chain: op is whitelist, blacklist, excludelist or includelist; items a list or context -> list."""

    op: str
    items: Any


@dataclass(frozen=True)
class Transform:
    name: str
    on: str
    fn: Callable[[Any], Any]
    only: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    name: str
    load: Callable[[], DataFrame]
    key: tuple[str, ...]
    associations: dict[str, Association] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    enums: dict[str, dict[str, Any]] = field(default_factory=dict)
    encrypted: frozenset[str] = frozenset()
    custom_properties: dict[str, dict] = field(default_factory=dict)
    custom_predicates: dict[str, tuple[str, ...]] = field(default_factory=dict)
    scopes: tuple[Callable[[DataFrame, Any], DataFrame], ...] = ()
    filterable: bool = True
    allowed: tuple[Any, ...] = ()
    rules: tuple[tuple[str, str | None, Rule], ...] = ()
    transforms: tuple[Transform, ...] = ()

    def derive(self, name: str, **changes: Any) -> Model:
        """A model of its own with copies of everything declared here; neither sees the other's later changes."""
        held = {k: dict(getattr(self, k)) for k in ("associations", "types", "enums", "custom_properties", "custom_predicates")}
        return replace(self, name=name, **(held | changes))

    def add_scope(self, fn: Callable[[DataFrame, Any], DataFrame]) -> Model:
        return replace(self, scopes=(*self.scopes, fn))

    def permit(self, about: str, op: str, items: Any, of: str | None = None) -> Model:
        """Adds a rule about properties, order, associations, predicates (of: a type or property) or aggregates (of: an association)."""
        if op not in ("whitelist", "blacklist", "excludelist", "includelist"):
            raise ValueError(f"unknown list {op!r}")
        return replace(self, rules=(*self.rules, (about, of, Rule(op, items))))

    def allow(self, rule: Any) -> Model:
        return replace(self, allowed=(*self.allowed, rule))

    def transform(self, name: str, on: str, fn: Callable[[Any], Any], only: Sequence[str] = (), excluded: Sequence[str] = ()) -> Model:
        """Adds a transform of the value, the value_node or the attribute of a property, a type or all ("*")."""
        if on not in ("value", "value_node", "attribute"):
            raise ValueError(f"unknown transform target {on!r}")
        return replace(self, transforms=(*self.transforms, Transform(name, on, fn, tuple(only), tuple(excluded))))

    def type_of(self, column: str, df: DataFrame) -> str:
        return self.types.get(column) or ("enum" if column in self.enums else logical_type(df.schema[column]))

    def all(self) -> Relation:
        return Relation(self, self.load())


@dataclass(frozen=True)
class Relation:
    """A DataFrame of a model with a deferred selection: a filter is applied before order, offset and limit are."""

    model: Model
    df: DataFrame
    order: tuple[Column, ...] = ()
    limit_n: int | None = None
    offset_n: int = 0
    distinct_rows: bool = False
    group_keys: tuple[str, ...] | None = None
    alias: str = field(default_factory=lambda: f"q{next(_aliases)}")

    def where(self, condition: Column) -> Relation:
        return replace(self, df=self.df.where(condition), alias=f"q{next(_aliases)}")

    def order_by(self, *columns: Column) -> Relation:
        return replace(self, order=columns)

    def limit(self, n: int | None) -> Relation:
        return replace(self, limit_n=n)

    def offset(self, n: int) -> Relation:
        return replace(self, offset_n=n)

    def distinct(self) -> Relation:
        return replace(self, distinct_rows=True)

    def none(self) -> Relation:
        return replace(self, df=self.df.where(F.lit(False)))

    def validate(self) -> None:
        missing = set(self.model.key) - set(self.df.columns)
        if missing:
            raise FilterError(f"the relation lacks key columns {sorted(missing)}")
        if self.group_keys is not None and not set(self.model.key) <= set(self.group_keys):
            raise FilterError("a grouped relation must be grouped by the whole key")

    def column(self, name: str) -> Column:
        return F.col(f"{self.alias}.`{name}`")

    def filtered(self, condition: Column | None) -> DataFrame:
        """Rows of the aliased table under the condition, then the selection."""
        df = self.df.alias(self.alias)
        if condition is not None:
            df = df.where(condition)
        if self.distinct_rows:
            df = df.distinct()
        if self.order:
            df = df.orderBy(*self.order)
        if self.offset_n:
            df = df.offset(self.offset_n)
        return df if self.limit_n is None else df.limit(self.limit_n)

    def to_df(self) -> DataFrame:
        return self.filtered(None)

    def keys(self) -> DataFrame:
        return self.to_df().select(*self.model.key)


def nulls_as_stored(column: Column, direction: str) -> Column:
    """Nulls count as greater than all values: last when ascending, first when descending."""
    return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first()
