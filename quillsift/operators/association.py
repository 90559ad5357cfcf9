"""Membership of owners by their associated children: semi-, anti- and existence joins, per-owner ranking, one-pass set predicates.

Everything here builds plans; nothing runs a job. An owner qualifies if its key is in a table
of keys made from (owner key, child) pairs, tested by a correlated EXISTS that Catalyst turns
into a left semi, left anti or existence join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillsift.functions.coerce import CoercionError, integer, scalar
from quillsift.sources.model import Association, FilterError, Model, Relation, nulls_as_stored

if TYPE_CHECKING:
    from quillsift.operators.nodes import Compiler

_names = itertools.count()
SETS = ("has_any", "not_has_any", "has_all", "not_has_all", "only_has_any", "only_has_all")
#: Of an empty literal candidate set.
EMPTY = {"has_any": False, "not_has_any": True, "has_all": True, "not_has_all": False, "only_has_any": False, "only_has_all": True}


def key_columns(prefix: str, n: int) -> list[str]:
    return [f"__{prefix}{k}" for k in range(n)]


def in_keys(keys: DataFrame, names: list[str], owner: Relation, owner_key: Iterable[str]) -> Column:
    """Whether the owner's key is among the rows of keys."""
    alias = f"k{next(_names)}"
    equal = [F.col(f"{alias}.{n}") == owner.column(k).outer() for n, k in zip(names, owner_key, strict=True)]
    return keys.select(*names).alias(alias).where(reduce(lambda a, b: a & b, equal)).exists()


def scoped(model: Model, df: DataFrame, context: Any) -> DataFrame:
    """df without the rows that any of the model's mandatory scopes lacks, by whole key."""
    for scope in model.scopes:
        kept = scope(model.load(), context)
        if not isinstance(kept, DataFrame):
            raise FilterError(f"a scope of {model.name} must return a DataFrame")
        if missing := set(model.key) - set(kept.columns):
            raise FilterError(f"a scope of {model.name} lacks key columns {sorted(missing)}")
        names = key_columns("s", len(model.key))
        kept = kept.select(*[F.col(k).alias(n) for k, n in zip(model.key, names, strict=True)])
        df = df.join(kept, reduce(lambda a, b: a & b, [df[k] == kept[n] for k, n in zip(model.key, names, strict=True)]), "left_semi")
    return df


def canonical_ids(model: Model, values: Any) -> list[tuple]:
    """Distinct key tuples of scalars, tuples, Rows; nulls and what the key's type cannot take are errors."""
    if isinstance(values, dict):
        raise CoercionError("a mapping is no candidate")
    many = isinstance(values, (list, set, frozenset)) or (isinstance(values, tuple) and len(model.key) == 1 and not isinstance(values, Row))
    schema, out = model.load().schema, {}
    for value in values if many else [values]:
        if isinstance(value, Row):
            if missing := [k for k in model.key if k not in value.__fields__]:
                raise CoercionError(f"a record lacks {missing}")
            value = tuple(value[k] for k in model.key)
        parts = tuple(value) if isinstance(value, (list, tuple)) else (value,)
        if len(parts) != len(model.key):
            raise CoercionError(f"a key has {len(model.key)} parts, not {len(parts)}")
        if any(p is None or isinstance(p, (dict, list, set)) for p in parts):
            raise CoercionError("a key has no null or composite parts")
        kinds = [model.types.get(k) or schema[k].dataType.typeName() for k in model.key]
        cast = tuple(integer(p) if t in ("integer", "long", "short", "byte") else scalar("string" if t in ("string", "uuid") else t, p) for p, t in zip(parts, kinds, strict=True))
        out[cast] = None
    return list(out)


class Membership:
    """The children of a model's association, and predicates over their owners."""

    def __init__(self, compiler: Compiler, owner: Relation, association: Association, target: Model, token: str | None = None):
        self.compiler, self.owner, self.association, self.target, self.token = compiler, owner, association, target, token
        self.model = owner.model
        self.owner_names, self.child_names = key_columns("o", len(self.model.key)), key_columns("c", len(target.key))
        self.scoping: Relation | None = None
        self.scoping_outcome = None

    # Children and pairs

    def children(self) -> DataFrame:
        """All children that the association's scope and the model's scopes leave, whoever owns them."""
        df = scoped(self.target, self.target.load(), self.compiler.context)
        where = self.association.scope.where
        if where is None:
            return df
        kept = where(df, self.compiler.context)
        if not isinstance(kept, DataFrame):
            raise FilterError(f"the scope of {self.association.name} must return a DataFrame")
        return kept

    def _pairs(self) -> DataFrame:
        """Owner key columns beside the child's columns, a row per pair that the tables' join gives."""
        a, m, key = self.association, self.model, self.model.key
        if a.through:
            return self._chain()
        child = self.children()
        child_cols = a.child_cols or self.target.key
        if a.bridge:
            b = a.bridge.load()
            links = key_columns("j", len(child_cols))
            b = b.select(*[F.col(c).alias(n) for c, n in zip(a.bridge.owner_cols, self.owner_names, strict=True)], *[F.col(c).alias(n) for c, n in zip(a.bridge.child_cols, links, strict=True)])
            return b.join(child, reduce(lambda x, y: x & y, [b[n] == child[c] for n, c in zip(links, child_cols, strict=True)])).drop(*links)
        if a.kind != "belongs_to" and (a.owner_cols or key) == key and not a.polymorphic:
            own = [F.col(c).alias(n) for c, n in zip(a.child_cols, self.owner_names, strict=True)]
            return child.select(*own, *child.columns).where(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in self.owner_names]))
        owner = m.load()
        if a.type_col:
            owner = owner.where(F.col(a.type_col) == F.lit(self.token))
        links = key_columns("j", len(a.owner_cols))
        owner = owner.select(*[F.col(k).alias(n) for k, n in zip(key, self.owner_names, strict=True)], *[F.col(c).alias(n) for c, n in zip(a.owner_cols, links, strict=True)])
        return owner.join(child, reduce(lambda x, y: x & y, [owner[n] == child[c] for n, c in zip(links, child_cols, strict=True)])).drop(*links)

    def _chain(self) -> DataFrame:
        model, made = self.model, None
        for name in self.association.through:
            step = model.associations[name]
            target = self.compiler.models[step.target]
            member = Membership(self.compiler, Relation(model, model.load()), step, target)
            pairs = member.selected()
            if made is None:
                made = pairs
            else:
                mid = key_columns("m", len(model.key))
                left = made.select(*self.owner_names, *[F.col(k).alias(n) for k, n in zip(model.key, mid, strict=True)])
                right = pairs.select(*[F.col(n).alias(f"__r{k}") for k, n in enumerate(member.owner_names)], *target.load().columns)
                on = [left[n] == right[f"__r{k}"] for k, n in enumerate(mid)]
                made = left.join(right, reduce(lambda x, y: x & y, on)).drop(*mid, *[f"__r{k}" for k in range(len(mid))])
            model = target
        where = self.association.scope.where
        return made if where is None else where(made, self.compiler.context)

    def selected(self) -> DataFrame:
        """The pairs that the association's own selection leaves each owner."""
        pairs, s, key = self._pairs(), self.association.scope, list(self.target.key)
        limit = 1 if self.association.kind == "has_one" and s.limit is None else s.limit
        if s.aggregates:
            pairs = pairs.groupBy(*self.owner_names, *[c for c in pairs.columns if c not in self.owner_names]).agg(*[make().alias(n) for n, make in s.aggregates])
            if s.having is not None:
                pairs = pairs.where(s.having())
        order = [make() for make in s.order]
        ties = [F.col(k).asc() for k in key]
        if s.distinct:
            one = Window.partitionBy(*self.owner_names, *key).orderBy(*order, *ties)
            pairs = pairs.withColumn("__one", F.row_number().over(one)).where("__one = 1").drop("__one")
        if limit is None and not s.offset:
            return pairs
        pairs = pairs.withColumn("__rank", F.row_number().over(Window.partitionBy(*self.owner_names).orderBy(*order, *ties)))
        if limit is not None:
            pairs = pairs.where(F.col("__rank") <= s.offset + limit)
        if s.offset:
            pairs = pairs.where(F.col("__rank") > s.offset)
        return pairs.drop("__rank")

    def scope_by(self, payload: dict, path: tuple, depth: int = 1) -> Any:
        """Compiles the payload's scoping group, which applies after the per-owner selection, once, under an alias that all its uses have; returns its outcome."""
        self.scoping = Relation(self.target, self.target.load())
        self.scoping_outcome = self.compiler.compile(payload if payload.get("type") else {**payload, "type": "group"}, self.scoping, path, depth)
        return self.scoping_outcome

    def _scoped(self, df: DataFrame) -> DataFrame:
        if self.scoping is None:
            return df
        child = Relation(self.target, df, alias=self.scoping.alias)
        return child.filtered(self.compiler.as_condition(self.scoping_outcome, child))

    def pairs(self) -> DataFrame:
        """(owner key columns, child columns, child key columns under their own names)."""
        df = self._scoped(self.selected())
        return df.select("*", *[F.col(k).alias(n) for k, n in zip(self.target.key, self.child_names, strict=True)])

    def eligible(self) -> DataFrame:
        """Keys of all children that may be meant where no candidates are named."""
        return self._scoped(self.children()).select(*[F.col(k).alias(n) for k, n in zip(self.target.key, self.child_names, strict=True)]).distinct()

    # Candidates

    def candidates(self, args: list) -> tuple[list[tuple] | None, DataFrame | None]:
        """Literal key tuples, or a table of distinct keys."""
        if not args:
            return None, self.eligible()
        value = args[0]
        if isinstance(value, Relation):
            value.validate()
            if value.model.name != self.target.name:
                raise CoercionError(f"candidates are of {value.model.name}, not of {self.target.name}")
            value = value.keys()
        if isinstance(value, DataFrame):
            cols = [k for k in self.target.key if k in value.columns]
            if len(cols) != len(self.target.key):
                if len(value.columns) != len(self.target.key):
                    raise CoercionError("a candidate query must give the key columns")
                cols = value.columns
            return None, value.select(*[F.col(c).alias(n) for c, n in zip(cols, self.child_names, strict=True)]).distinct()
        return canonical_ids(self.target, value), None

    def _flagged(self, literal: list[tuple] | None, query: DataFrame | None) -> DataFrame:
        """Pairs with __in: whether the child is a candidate."""
        pairs = self.pairs().select(*self.owner_names, *self.child_names)
        if literal is not None and len(self.child_names) == 1:
            return pairs.withColumn("__in", F.col(self.child_names[0]).isin([t[0] for t in literal]))
        if literal is not None:
            query = pairs.sparkSession.createDataFrame(literal, pairs.select(*self.child_names).schema)
        marked = query.select(*[F.col(n).alias(f"__q{k}") for k, n in enumerate(self.child_names)], F.lit(True).alias("__hit"))
        on = reduce(lambda x, y: x & y, [pairs[n] == marked[f"__q{k}"] for k, n in enumerate(self.child_names)])
        return pairs.join(marked, on, "left").select(*self.owner_names, *self.child_names, F.coalesce("__hit", F.lit(False)).alias("__in"))

    # Predicates over owners

    def owners(self, keys: DataFrame) -> Column:
        """Whether the owner is in a table that has the owner key columns."""
        return in_keys(keys, self.owner_names, self.owner, self.model.key)

    def has_children(self) -> Column:
        return self.owners(self.pairs())

    def matching(self, candidates: Any) -> DataFrame:
        """The pairs whose child is among the candidates."""
        pairs = self.pairs()
        literal, query = self.candidates([candidates])
        if literal is not None and len(self.child_names) == 1:
            return pairs.where(F.col(self.child_names[0]).isin([t[0] for t in literal]))
        if literal is not None:
            query = pairs.sparkSession.createDataFrame(literal, pairs.select(*self.child_names).schema)
        return pairs.join(query.select(*self.child_names), self.child_names, "left_semi")

    def owner_child_predicate(self, predicate: str, value: Any) -> Column:
        """Whether the key of a child of the owner meets the predicate; eq and not_eq of nothing ask for no child and for any."""
        if value is None and predicate in ("eq", "not_eq"):
            return ~self.has_children() if predicate == "eq" else self.has_children()
        entry = self.compiler.registry.predicates.get(predicate)
        if entry is None or len(self.target.key) > 1:
            raise FilterError(f"unknown predicate {predicate!r}" if entry is None else f"the key of {self.target.name} has several columns")
        key = self.target.key[0]
        kind = self.target.type_of(key, self.target.load())
        return self.owners(self.pairs().where(self.compiler.condition(entry, F.col(self.child_names[0]), kind, [value], self.target, key)))

    def owner_count_at_least(self, minimum: int, candidates: Any = None) -> Column:
        """Whether the owner has so many distinct children (among candidates)."""
        if not isinstance(minimum, int) or isinstance(minimum, bool):
            raise CoercionError("the least count must be an integer")
        if minimum <= 0:
            return F.lit(True)
        flagged = self._flagged(*self.candidates([] if candidates is None else [candidates])).where("__in")
        return self.owners(flagged.groupBy(*self.owner_names).agg(F.count_distinct(F.struct(*self.child_names)).alias("__n")).where(F.col("__n") >= minimum))

    def apply(self, predicate: str, args: list) -> Column:
        base, negative = predicate.removeprefix("not_"), predicate.startswith("not_")
        if base == "has_any" and not args:  # whatever pairs there are are eligible
            return ~self.has_children() if negative else self.has_children()
        literal, query = self.candidates(args)
        if literal == []:
            return F.lit(EMPTY[predicate])
        found = self._set(base, literal, query)
        return ~found if negative else found

    def _set(self, base: str, literal: list[tuple] | None, query: DataFrame | None) -> Column:
        flagged = self._flagged(literal, query)
        if base == "has_any":
            return self.owners(flagged.where("__in"))
        by_owner = flagged.groupBy(*self.owner_names)
        if base == "only_has_any":
            return self.owners(by_owner.agg(F.min("__in").alias("__all")).where("__all"))
        distinct = F.count_distinct(F.when(F.col("__in"), F.struct(*self.child_names))).alias("__n")
        counts = by_owner.agg(distinct, F.min("__in").alias("__all"))
        if base == "only_has_all":
            counts = counts.where("__all")
        if literal is not None:
            return self.owners(counts.where(F.col("__n") == len(literal)))
        size = query.agg(F.count("*").alias("n"))
        return (size.scalar() == 0) | self.owners(counts.where(F.col("__n") == size.scalar()))
