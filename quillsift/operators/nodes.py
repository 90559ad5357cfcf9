"""The five filter nodes, compiled to boolean columns over a relation.

A node never touches the relation: it gives a condition, and the root relation is filtered once
by all of them, before its own order, offset and limit. Only a nested group with a selection of
its own becomes a table of keys.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import coerce
from quillsift.functions.coerce import CoercionError, Range, boolean
from quillsift.functions.predicates import Predicate, folded
from quillsift.operators import expression
from quillsift.operators.association import SETS, Membership, in_keys, key_columns
from quillsift.plans.config import Aggregate, Registry
from quillsift.plans.permissions import PermissionCache, Permissions
from quillsift.plans.result import CallbackError, Diagnostic
from quillsift.sources.model import FilterError, Model, Relation, nulls_as_stored

_IDENTIFIER = re.compile(r"[a-zA-Z_]\w*[?!]?", re.ASCII)


@dataclass(frozen=True)
class Selection:
    order: tuple[Column, ...] = ()
    limit: int | None = None
    offset: int | None = None

    def __bool__(self) -> bool:
        return bool(self.order) or self.limit is not None or self.offset is not None


@dataclass(frozen=True)
class Outcome:
    status: str
    condition: Column | None = None
    diagnostics: tuple[Diagnostic, ...] = ()
    denied: bool = False
    selection: Selection = Selection()


class Failure(Exception):
    """Ends the compilation of one node with a diagnostic."""

    def __init__(self, code: str, message: str, at: tuple = (), category: str = "invalid_filter"):
        super().__init__(message)
        self.code, self.at, self.category = code, at, category


def identifier(payload: dict, key: str, code: str) -> str:
    name = payload.get(key)
    if name is None or name == "":
        raise Failure(code, f"{key} is missing", (key,))
    if not isinstance(name, str) or len(name) > 255 or not _IDENTIFIER.fullmatch(name):
        raise Failure("invalid_filter", f"{key} is not an identifier", (key,))
    return name


def arguments(payload: dict) -> list:
    args = payload.get("args", [])
    if not isinstance(args, list):
        raise Failure("invalid_filter_args", "args is not a list", ("args",))
    return args


class Compiler:
    """Compiles one filter for one context; now is fixed for all of it."""

    def __init__(self, registry: Registry, models: dict[str, Model], context: Any, cache: PermissionCache, now: dt.datetime):
        self.registry, self.models, self.context, self.cache, self.now = registry, models, context, cache, now

    def permissions(self, model: Model) -> Permissions:
        return self.cache.get(self.registry, self.models, model, self.context)

    # Dispatch

    def compile(self, node: Any, scope: Relation, path: tuple = (), depth: int = 1) -> Outcome:
        try:
            if not isinstance(node, dict):
                raise Failure("invalid_filter_element", "a filter is a mapping")
            kind = node.get("type") or ("group" if not path or "filters" in node else None)
            made = {"group": self._group, "property": self._property, "association": self._association, "aggregate": self._aggregate, "computed": self._computed}.get(kind)
            if made is None and kind in self.registry.nodes:
                return self._host(self.registry.nodes[kind], node, scope, path)
            if made is None:
                raise Failure("unknown_filter_type", f"unknown filter type {kind!r}", ("type",))
            return made(node, scope, path, depth)
        except Failure as e:
            return Outcome("failed", diagnostics=(Diagnostic(e.category, e.code, (*path, *e.at), str(e)),), denied=e.category == "permission_denied")
        except CoercionError as e:
            return Outcome("failed", diagnostics=(Diagnostic("invalid_filter", "invalid_filter_args", (*path, "args"), str(e)),))
        except expression.ExpressionError as e:
            return Outcome("failed", diagnostics=(Diagnostic("permission_denied" if e.code.endswith("denied") else "invalid_filter", e.code, (*path, *e.path), str(e)),), denied=e.code.endswith("denied"))

    def _host(self, node: Callable, payload: dict, scope: Relation, path: tuple) -> Outcome:
        try:
            out = node(self, payload, scope, path)
        except (FilterError, CallbackError, Failure):
            raise
        except Exception as e:
            raise CallbackError(f"a filter node failed: {e}") from e
        if isinstance(out, Relation):
            if out.model.name != scope.model.name:
                raise Failure("invalid_filter_result", f"a node for {scope.model.name} returned {out.model.name}")
            out = Outcome("success", self.keys_condition(out.keys(), scope))
        if isinstance(out, Column):
            out = Outcome("success", out)
        if not isinstance(out, Outcome):
            raise Failure("invalid_filter_result", "a node must return a Column, a Relation or an Outcome")
        return self._negated(payload, out)

    def keys_condition(self, keys: DataFrame, scope: Relation) -> Column:
        names = key_columns("n", len(scope.model.key))
        return in_keys(keys.select(*[F.col(k).alias(n) for k, n in zip(scope.model.key, names, strict=True)]), names, scope, scope.model.key)

    def as_condition(self, outcome: Outcome, scope: Relation) -> Column:
        """What the outcome says of a row of scope; a selection becomes a table of keys, of the unpaged scope."""
        condition = F.lit(True) if outcome.condition is None else outcome.condition
        if not outcome.selection:
            return condition
        s = outcome.selection
        inner = replace(scope, order=s.order or scope.order, limit_n=scope.limit_n if s.limit is None else s.limit, offset_n=scope.offset_n if s.offset is None else s.offset)
        return self.keys_condition(inner.filtered(condition).select(*scope.model.key), scope)

    @staticmethod
    def _negated(payload: dict, outcome: Outcome) -> Outcome:
        if outcome.condition is not None and boolean(payload.get("negate")):
            return replace(outcome, condition=~outcome.condition)
        return outcome

    # Group

    def _group(self, node: dict, scope: Relation, path: tuple, depth: int) -> Outcome:
        if depth > self.registry.settings.max_depth:
            raise Failure("invalid_filter", f"groups are nested more than {self.registry.settings.max_depth} deep")
        if "filters" not in node or "predicate" not in node:
            raise Failure("invalid_group", "a group has a predicate and filters", ("filters" if "filters" not in node else "predicate",))
        predicate, filters = node["predicate"], node["filters"]
        if not isinstance(predicate, str) or predicate.lower() not in ("and", "or"):
            raise Failure("invalid_group_predicate", "a group's predicate is and or or", ("predicate",))
        if not isinstance(filters, list):
            raise Failure("invalid_group_filters", "a group's filters are a list", ("filters",))
        selection = self._selection(node, scope)
        inner = replace(scope, order=(), limit_n=None, offset_n=0)
        done = [self.compile(f, inner, (*path, "filters", k), depth + (isinstance(f, dict) and (f.get("type") or "group") == "group")) for k, f in enumerate(filters)]
        kept = [o for o in done if o.status != "failed"]
        notes = tuple(d for o in done for d in o.diagnostics)
        status = "success" if all(o.status == "success" for o in done) else "partial" if kept else "failed"
        if status == "failed":
            return Outcome("failed", diagnostics=notes)
        condition = folded([self.as_condition(o, inner) for o in kept], predicate.lower() == "or")
        return replace(self._negated(node, Outcome(status, condition, notes)), selection=selection)

    def _selection(self, node: dict, scope: Relation) -> Selection:
        order = []
        if node.get("order") is not None:
            if not isinstance(node["order"], list):
                raise Failure("invalid_filter", "order is a list", ("order",))
            for k, entry in enumerate(node["order"]):
                at = ("order", k)
                if not isinstance(entry, dict):
                    raise Failure("invalid_filter", "an order entry is a mapping", at)
                direction = str(entry.get("direction", "asc")).lower()
                if direction not in ("asc", "desc"):
                    raise Failure("invalid_filter", "a direction is asc or desc", (*at, "direction"))
                if "expression" in entry:
                    column, _, _ = self._expression(entry["expression"], scope, (*at, "expression"), ordering=True)
                else:
                    name = identifier(entry, "property", "missing_property")
                    if name not in self.permissions(scope.model).order():
                        raise Failure("property_denied", f"order by {name} is not permitted", (*at, "property"), "permission_denied")
                    column = scope.column(name)
                order.append(nulls_as_stored(column, direction))
        out = {}
        for key in ("limit", "offset"):
            value = node.get(key)
            if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
                raise Failure("invalid_filter", f"{key} is a non-negative integer", (key,))
            out[key] = value
        most = self.registry.settings.max_limit
        if most is not None and out["limit"] is not None:
            out["limit"] = min(most, out["limit"])
        return Selection(tuple(order), out["limit"], out["offset"])

    # Property and computed

    def _property(self, node: dict, scope: Relation, path: tuple, depth: int) -> Outcome:
        name = identifier(node, "property", "missing_property")
        predicate = identifier(node, "predicate", "missing_predicate")
        allowed, model = self.permissions(scope.model), scope.model
        if name not in allowed.properties():
            raise Failure("property_denied", f"{name} is not permitted", ("property",), "permission_denied")
        if name in model.custom_properties:
            return self._custom_property(node, name, predicate, scope, path, depth)
        entry = self._predicate(predicate, "property", allowed.property_predicates(name))
        condition = self.condition(entry, scope.column(name), allowed.property_type(name), arguments(node), model, name)
        return self._negated(node, Outcome("success", condition))

    def _custom_property(self, node: dict, name: str, predicate: str, scope: Relation, path: tuple, depth: int) -> Outcome:
        if predicate not in self.permissions(scope.model).property_predicates(name):
            raise Failure("predicate_denied", f"{predicate} is not permitted for {name}", ("predicate",), "permission_denied")
        if arguments(node):
            raise Failure("invalid_filter_args", f"{predicate} takes no arguments", ("args",))
        stored = scope.model.custom_properties[name]
        stored = stored(self.context) if callable(stored) else stored
        out = self.compile(stored, scope, (*path, "property"), depth + 1)
        if out.status != "success":
            raise Failure("invalid_custom_property", f"the filter of {name} is not valid", ("property",))
        condition = self.as_condition(out, scope)
        return self._negated(node, Outcome("success", condition if predicate == "eq_true" else ~condition))

    def _expression(self, tree: Any, scope: Relation, path: tuple = ("expression",), ordering: bool = False) -> tuple[Column, str, list[str]]:
        allowed = self.permissions(scope.model)

        def column(name: str, at: tuple) -> Column:
            if name not in (allowed.order() if ordering else allowed.properties()) or name in scope.model.custom_properties:
                raise expression.ExpressionError(f"{name} is not permitted", at, "property_denied")
            if not (self.registry.types.is_a(allowed.property_type(name), "summable") or isinstance(tree, dict) and "property" in tree):
                raise expression.ExpressionError(f"{name} is not a number", at)
            return scope.column(name)

        return expression.build(tree, column, allowed.property_type, path)

    def _computed(self, node: dict, scope: Relation, path: tuple, depth: int) -> Outcome:
        predicate = identifier(node, "predicate", "missing_predicate")
        column, kind, leaves = self._expression(node.get("expression"), scope)
        allowed = self.permissions(scope.model)
        if not leaves:
            raise Failure("predicate_denied", "an expression without a property is not permitted", ("expression",), "permission_denied")
        names = set(allowed.predicates(kind, "computed"))
        for leaf in leaves:
            names &= set(allowed.property_predicates(leaf, "computed")) if kind == allowed.property_type(leaf) else set(allowed.predicates(kind, "computed", leaf))
        entry = self._predicate(predicate, "computed", names)
        return self._negated(node, Outcome("success", self.condition(entry, column, kind, arguments(node), scope.model, "computed")))

    # Association and aggregate

    def _member(self, node: dict, scope: Relation, path: tuple, what: str) -> tuple[Membership, str]:
        name = identifier(node, "association", "missing_association")
        allowed, association = self.permissions(scope.model), scope.model.associations.get(name)
        if association is None:
            raise Failure("unknown_association", f"{scope.model.name} has no association {name}", ("association",))
        if name not in allowed.associations():
            raise Failure("association_denied", f"{name} is not permitted", ("association",), "permission_denied")
        token = node.get("target_type")
        if association.polymorphic:
            if token not in allowed.targets(name):
                raise Failure("association_denied", f"{token!r} is no permitted target of {name}", ("target_type",), "permission_denied")
            target = self.models[dict(association.targets)[token]]
        elif token is not None:
            raise Failure(f"invalid_{what}_filter", f"{name} has one target only", ("target_type",))
        else:
            target = self.models[association.target]
        return Membership(self, scope, association, target, token), name

    def _scoping(self, node: dict, member: Membership, path: tuple, depth: int) -> Outcome:
        if node.get("scoping") is None:
            return Outcome("success")
        if not isinstance(node["scoping"], dict):
            raise Failure("invalid_scoping", "scoping is a group", ("scoping",))
        return member.scope_by(node["scoping"], (*path, "scoping"), depth + 1)

    def _association(self, node: dict, scope: Relation, path: tuple, depth: int) -> Outcome:
        predicate = identifier(node, "predicate", "missing_predicate")
        member, name = self._member(node, scope, path, "association")
        if predicate in ("eq", "not_eq"):
            raise Failure("unsupported_predicate", f"{predicate} is no association predicate", ("predicate",))
        entry = self._predicate(predicate, "association", self.permissions(scope.model).association_predicates(name))
        inner = self._scoping(node, member, path, depth)
        if inner.status == "failed":
            return Outcome("failed", diagnostics=inner.diagnostics, denied=inner.denied)
        args = arguments(node)
        if predicate in SETS:
            if len(args) > 1:
                raise Failure("invalid_filter_args", "an association predicate takes one argument", ("args",))
            condition = member.apply(predicate, self._prepared(entry, args))
        else:
            self._arity(entry, args)
            condition = self._called(entry.build, member, *self._prepared(entry, args))
        return self._negated(node, Outcome(inner.status, condition, inner.diagnostics))

    def _aggregate(self, node: dict, scope: Relation, path: tuple, depth: int) -> Outcome:
        predicate = identifier(node, "predicate", "missing_predicate")
        if "include_zero?" in node:
            raise Failure("invalid_aggregate_filter", "include_zero? is not an aggregate's", ("include_zero?",))
        member, name = self._member(node, scope, path, "aggregate")
        called = node.get("aggregate") or "count"
        aggregate: Aggregate | None = self.registry.aggregates.get(called)
        if aggregate is None:
            raise Failure("unknown_aggregate", f"unknown aggregate {called!r}", ("aggregate",))
        allowed = self.permissions(scope.model)
        fields = allowed.aggregates(name).get(called)
        if fields is None:
            raise Failure("aggregate_denied", f"{called} of {name} is not permitted", ("aggregate",), "permission_denied")
        field = node.get("property")
        if aggregate.property and (not isinstance(field, str) or not _IDENTIFIER.fullmatch(field)):
            raise Failure("invalid_aggregate_property", f"{called} takes a property", ("property",))
        if aggregate.property and field not in fields:
            raise Failure("aggregate_denied", f"{called} of {field} is not permitted", ("property",), "permission_denied")
        distinct = boolean(node.get("distinct"))
        if distinct and not aggregate.distinct:
            raise Failure("unsupported_distinct", f"{called} takes no distinct", ("distinct",))
        kind = allowed.result_type(called, name, field)
        entry = self._predicate(predicate, "aggregate", allowed.aggregate_predicates(kind))
        inner = self._scoping(node, member, path, depth)
        if inner.status == "failed":
            return Outcome("failed", diagnostics=inner.diagnostics, denied=inner.denied)
        args, pairs = arguments(node), member.pairs()
        if aggregate.property:
            value = aggregate.build(F.col(f"`{field}`"), distinct)
        else:
            if distinct:
                pairs = pairs.select(*member.owner_names, *member.child_names).distinct()
            value = aggregate.build(F.lit(1), False)
        grouped = pairs.groupBy(*member.owner_names).agg(value.alias("__value"))
        test = lambda c: self.condition(entry, c, kind, args, member.target, field or "")
        passed = F.coalesce(test(F.col("__value")), F.lit(False))
        condition = member.owners(grouped.where(passed))
        if aggregate.empty_value is not None:  # of constants, so one of the two is all that is left of the plan
            condition = F.when(test(F.lit(aggregate.empty_value)), ~member.owners(grouped.where(~passed))).otherwise(condition)
        return self._negated(node, Outcome(inner.status, condition, inner.diagnostics))

    # The predicate pipeline

    def _predicate(self, name: str, kind: str, allowed: Any) -> Predicate:
        entry = self.registry.predicates.get(name)
        if entry is None:
            raise Failure("unknown_predicate", f"unknown predicate {name!r}", ("predicate",))
        if name not in allowed:
            raise Failure("predicate_denied", f"{name} is not permitted here", ("predicate",), "permission_denied")
        return entry

    @staticmethod
    def _called(fn: Callable, *args: Any) -> Any:
        try:
            return fn(*args)
        except (CoercionError, Failure, FilterError):
            raise
        except Exception as e:
            raise CallbackError(f"a callback failed: {e}") from e

    @staticmethod
    def _arity(entry: Predicate, args: list) -> None:
        most = entry.most
        if entry.operand == "bounds" and len(args) == 1 and isinstance(args[0], Range):
            return
        if entry.operand == "bounds" and len(args) != 2 or len(args) < entry.least or (most is not None and len(args) > most):
            raise Failure("invalid_filter_args", f"{entry.name} takes {'2' if entry.operand == 'bounds' else entry.least} arguments, not {len(args)}", ("args",))

    def _prepared(self, entry: Predicate, args: list) -> list:
        out = []
        for k, value in enumerate(args):
            if entry.validator is not None and not self._called(entry.validator, value):
                raise Failure("invalid_filter_args", f"{value!r} is not valid for {entry.name}", ("args", k))
            if entry.formatter is not None:
                value = [self._called(entry.formatter, v) for v in value] if isinstance(value, list) else self._called(entry.formatter, value)
            out.append(value)
        if entry.prepare is not None:
            out = self._called(entry.prepare, out)
            if not isinstance(out, list) or any(isinstance(v, Column) for v in out):
                raise Failure("invalid_prepared_arguments", f"the arguments prepared for {entry.name} are not a list of values", ("args",))
        return out

    def _transforms(self, model: Model, name: str, kind: str, predicate: str, on: str) -> list[Callable]:
        """Of the property first, then of its type, then of all."""
        found = [t for t in model.transforms if t.on == on and predicate not in t.excluded and (not t.only or predicate in t.only)]
        types = [kind, *self.registry.types.ancestors(kind)]
        return [t.fn for t in found if t.name == name] + [t.fn for t in found if t.name in types and t.name != name] + [t.fn for t in found if t.name == "*"]

    def condition(self, entry: Predicate, column: Column, kind: str, args: list, model: Model, name: str) -> Column:
        """The predicate of a column of a logical type."""
        self._arity(entry, args)
        how = entry.operand
        for k, value in enumerate(args):
            if how in ("list", "texts") and not isinstance(value, list):
                raise Failure("invalid_filter_args", f"{entry.name} takes a list", ("args", k))
            if how in ("scalar", "text") and isinstance(value, (list, dict, set)) and not (kind in ("json", "jsonb", "array") or kind.endswith("_array")):
                raise Failure("invalid_filter_args", f"{entry.name} takes a scalar", ("args", k))
        args = self._prepared(entry, args)
        for fn in self._transforms(model, name, kind, entry.name, "value"):
            args = [[self._called(fn, v) for v in a] if isinstance(a, list) else self._called(fn, a) for a in args]
        labels = model.enums.get(name)
        cast = lambda v: coerce.scalar(kind, v, labels)
        if how == "scalar":
            args = [v if isinstance(v, (list, dict)) else cast(v) for v in args]
        elif how == "list":
            args = [[cast(v) for v in values] for values in args]
        elif how == "bounds":
            args = list(coerce.ordered_range(kind, args[0], labels)) if isinstance(args[0], Range) else [cast(v) for v in args]
        elif how == "range" and not isinstance(args[0], Range):
            raise Failure("invalid_filter_args", f"{entry.name} takes a range", ("args", 0))
        for fn in self._transforms(model, name, kind, entry.name, "attribute"):
            column = self._called(fn, column)
        nodes = self._transforms(model, name, kind, entry.name, "value_node")
        if how in ("scalar", "list", "bounds", "text", "texts"):
            for fn in nodes:
                each = lambda a: a if a is None else self._called(fn, a if isinstance(a, Column) else F.lit(a))  # noqa: E731, B023
                args = [[each(v) for v in a] if isinstance(a, list) else each(a) for a in args]
        extra = {"duration": [self.now, kind], "range": [kind], "range_scalar": [kind]}.get(how, [])
        try:
            out = self._called(entry.build, column, *args, *extra)
        except CoercionError as e:
            raise Failure("invalid_filter_args", str(e), ("args", 0)) from e
        if not isinstance(out, Column):
            raise Failure("invalid_filter_result", f"{entry.name} did not give a condition", ("predicate",))
        return out
