"""The public entry points: filter, validate, describe."""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F

from quillsift.operators.association import scoped
from quillsift.operators.nodes import Compiler, Outcome
from quillsift.plans.config import Registry, Settings
from quillsift.plans.permissions import PermissionCache, Permissions
from quillsift.plans.result import CallbackError, Diagnostic, InvalidFilterError, Result
from quillsift.sources.model import FilterError, Model, Relation

_log = logging.getLogger("quillsift")
#: The keys that a payload may give in other spellings (symbols, any case are not); operand values are left alone.
_CLOSED = ("callback_error", "scope_error")


class InputError(ValueError):
    pass


def check_input(tree: Any, settings: Settings) -> None:
    """Bounds the nodes, string bytes and nesting of a payload, and rejects cycles; iterative, so no payload can exhaust the stack."""
    nodes = size = 0
    todo: list[tuple[Any, int, frozenset[int]]] = [(tree, 0, frozenset())]
    while todo:
        value, depth, above = todo.pop()
        nodes += 1
        if isinstance(value, (str, bytes)):
            size += len(value.encode() if isinstance(value, str) else value)
        elif isinstance(value, (dict, list, tuple)):
            if id(value) in above:
                raise InputError("the filter contains itself")
            if depth >= settings.max_depth * 4 + 16:
                raise InputError("the filter is nested too deep")
            below = above | {id(value)}
            todo += [(v, depth + 1, below) for v in (value.values() if isinstance(value, dict) else value)]
            if isinstance(value, dict):
                todo += [(k, depth + 1, below) for k in value]
        if nodes > settings.max_nodes:
            raise InputError(f"the filter has more than {settings.max_nodes} nodes")
        if size > settings.max_bytes:
            raise InputError(f"the filter has more than {settings.max_bytes} bytes of text")


class Engine:
    """Filters relations of registered models. Compiling runs no job."""

    def __init__(self, models: Iterable[Model] = (), settings: Settings = Settings(), clock: Callable[[], dt.datetime] | None = None):
        self.registry = Registry(settings, clock)
        self.models = {m.name: m for m in models}
        self._cache = PermissionCache()

    def register(self, *models: Model) -> None:
        self.models |= {m.name: m for m in models}
        self._cache.clear()

    def clear_caches(self) -> None:
        self._cache.clear()

    def _relation(self, records: Any) -> Relation:
        if isinstance(records, Model):
            return records.all()
        if isinstance(records, str) and records in self.models:
            return self.models[records].all()
        if isinstance(records, Relation):
            return records
        raise TypeError("records are a model or a relation")

    def compile_filter(self, records: Any, filter: Any, context: Any = None) -> Result:
        """The filtered relation and its diagnostics, under the policies."""
        result = self._compiled(records, filter, context)
        if self.registry.settings.log:
            for d in result.diagnostics:
                _log.warning(json.dumps(d.to_dict(), default=str))
        closed = any(d.category in _CLOSED for d in result.diagnostics)
        policy = self.registry.settings.invalid_filter_policy
        if result.success or (policy == "skip" and not closed):
            return result
        if policy == "raise":
            raise InvalidFilterError(result)
        return replace(result, relation=result.relation.none())

    def filter_records_by(self, records: Any, filter: Any, context: Any = None) -> Relation:
        return self.compile_filter(records, filter, context).relation

    def validate_filter(self, records: Any, filter: Any, context: Any = None) -> list[Diagnostic]:
        with self.registry.temporary(invalid_filter_policy="skip"):
            return list(self._compiled(records, filter, context).diagnostics)

    def _failed(self, relation: Relation, category: str, code: str, message: str, path: tuple = ()) -> Result:
        return Result("failed", relation.none(), (Diagnostic(category, code, path, message),))

    def _compiled(self, records: Any, filter: Any, context: Any) -> Result:
        relation = self._relation(records)
        model = relation.model
        if not model.filterable:
            return self._failed(relation, "permission_denied", "model_not_filterable", f"{model.name} cannot be filtered")
        try:
            permissions = self._cache.get(self.registry, self.models, model, context)
            if not permissions.model_allowed():
                return self._failed(relation, "permission_denied", "model_denied", f"{model.name} is not permitted")
            try:
                relation.validate()
                relation = replace(relation, df=scoped(model, relation.df, context))
            except FilterError as e:
                return self._failed(relation, "scope_error", "scope_error", str(e))
            except Exception as e:
                return self._failed(relation, "scope_error", "scope_error", f"a scope failed: {e}")
            try:
                check_input(filter, self.registry.settings)
            except InputError as e:
                return Result("failed", relation, (Diagnostic("invalid_filter", "invalid_filter", (), str(e)),))
            compiler = Compiler(self.registry, self.models, context, self._cache, self.registry.clock())
            return self._applied(relation, compiler.compile(filter, relation))
        except CallbackError as e:
            if self.registry.settings.callback_error_policy == "raise":
                raise
            return self._failed(relation, "callback_error", "callback_error", str(e))
        except FilterError as e:
            return self._failed(relation, "scope_error", "scope_error", str(e))

    @staticmethod
    def _applied(relation: Relation, outcome: Outcome) -> Result:
        if outcome.status == "failed":
            return Result("failed", relation.none() if outcome.denied else relation, outcome.diagnostics)
        s = outcome.selection
        condition = F.lit(True) if outcome.condition is None else outcome.condition
        df = relation.df.alias(relation.alias).where(condition)
        out = replace(relation, df=df, order=s.order or relation.order, limit_n=relation.limit_n if s.limit is None else s.limit, offset_n=relation.offset_n if s.offset is None else s.offset)
        return Result(outcome.status, out, outcome.diagnostics)

    def filter_capabilities(self, model: Model | str, context: Any = None) -> dict[str, Any]:
        """What the caller may use of a model, by nine headings; with error: True if it cannot be told."""
        found = self.models.get(model) if isinstance(model, str) else model
        empty = {k: {} for k in ("predicates", "property_predicates", "association_targets", "aggregates", "aggregate_metadata", "aggregate_predicates")}
        empty |= {k: [] for k in ("properties", "associations", "order")}
        if not isinstance(found, Model) or not found.filterable:
            return empty | {"error": True}
        try:
            permissions = Permissions(self.registry, self.models, found, context)
            return permissions.to_dict() if permissions.model_allowed() else empty
        except CallbackError:
            return empty | {"error": True}
