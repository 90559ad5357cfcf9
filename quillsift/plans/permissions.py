"""What a caller may use: permission chains over a model, and the metadata made from them."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from typing import Any

from quillsift.plans.config import Registry
from quillsift.plans.result import CallbackError
from quillsift.sources.model import Model, Rule

_CACHED = 1000


def _apply(chain: Iterable[Rule], start: list[str], universe: list[str], context: Any) -> list[str]:
    held = list(start)
    for rule in chain:
        items = rule.items
        if callable(items):
            try:
                items = items(context)
            except Exception as e:
                raise CallbackError(f"a permission callback failed: {e}") from e
        if not isinstance(items, (list, tuple, set, frozenset)) or not all(isinstance(x, str) for x in items):
            raise CallbackError("a permission callback must return a list or set of names")
        if rule.op == "whitelist":
            held = [x for x in held if x in items]
        elif rule.op in ("blacklist", "excludelist"):
            held = [x for x in held if x not in items]
        else:
            held += [x for x in universe if x in items and x not in held]
    return held


class Permissions:
    """The permissions of one model for one context."""

    def __init__(self, registry: Registry, models: dict[str, Model], model: Model, context: Any):
        self.registry, self.models, self.model, self.context = registry, models, model, context
        self.schema = model.load()
        self._held: dict[Any, Any] = {}

    def _chain(self, about: str, of: Any = None) -> list[Rule]:
        return [r for a, o, r in self.model.rules if a == about and o == of]

    def _once(self, key: Any, make):
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    @property
    def strict(self) -> bool:
        return self.registry.settings.strict

    def model_allowed(self) -> bool:
        """The last rule wins; anything but true, false and None denies."""
        verdict: Any = True
        for rule in self.model.allowed:
            try:
                verdict = rule(self.context) if callable(rule) else rule
            except Exception as e:
                raise CallbackError(f"a model rule failed: {e}") from e
        return verdict is True or verdict is None

    def property_type(self, name: str) -> str:
        if name in self.model.custom_properties:
            return "boolean"
        return self.model.type_of(name, self.schema) if name in self.schema.columns else "string"

    def properties(self) -> list[str]:
        def make():
            m = self.model
            foreign = {c for a in m.associations.values() if a.kind == "belongs_to" and not a.through for c in a.owner_cols} - set(m.key)
            columns = [c for c in self.schema.columns if c not in m.encrypted and c not in foreign]
            universe = [*columns, *m.custom_properties]
            start = list(m.custom_properties) if self.strict else universe
            return _apply(self._chain("properties"), start, universe, self.context)

        return self._once("properties", make)

    def order(self) -> list[str]:
        allowed = [p for p in self.properties() if p not in self.model.custom_properties]
        return self._once("order", lambda: _apply(self._chain("order"), allowed, allowed, self.context))

    def _target_allowed(self, name: str | None) -> bool:
        target = self.models.get(name or "")
        return bool(target and target.filterable and Permissions(self.registry, self.models, target, self.context).model_allowed())

    def targets(self, association: str) -> list[str]:
        """Tokens of a polymorphic association whose models may be filtered."""
        return [token for token, name in self.model.associations[association].targets if self._target_allowed(name)]

    def associations(self) -> list[str]:
        def make():
            universe = [n for n, a in self.model.associations.items() if (self.targets(n) if a.polymorphic else self._target_allowed(a.target))]
            return _apply(self._chain("associations"), [] if self.strict else universe, universe, self.context)

        return self._once("associations", make)

    def predicates(self, type_name: str, kind: str, name: str | None = None) -> list[str]:
        """Global rules, then those of types from general to special, then the property's; types and adapters are hard limits."""

        def make():
            universe = self.registry.predicates_for(type_name, kind)
            chain = [*self._chain("predicates")]
            for t in self.registry.types.specificity(type_name):
                chain += self._chain("predicates", ("type", t))
            chain += self._chain("predicates", ("property", name)) if name else []
            return _apply(chain, [] if self.strict else universe, universe, self.context)

        return self._once(("predicates", type_name, kind, name), make)

    def property_predicates(self, name: str, kind: str = "property") -> list[str]:
        if name in self.model.custom_properties:
            declared = self.model.custom_predicates.get(name, ("eq_true", "eq_false"))
            with_rules = _apply([*self._chain("predicates"), *self._chain("predicates", ("type", "boolean")), *self._chain("predicates", ("property", name))], list(declared), list(declared), self.context)
            return [p for p in with_rules if p in ("eq_true", "eq_false")]
        return self.predicates(self.property_type(name), kind, name)

    def association_predicates(self, name: str) -> list[str]:
        return self.predicates(self.model.associations[name].kind, "association", name)

    def aggregates(self, association: str) -> dict[str, Any]:
        """Aggregate -> True, or the list of child properties it may take."""

        def make():
            a = self.model.associations.get(association)
            if a is None or a.polymorphic or association not in self.associations():
                return {}
            child = Permissions(self.registry, self.models, self.models[a.target], self.context)
            universe: dict[str, Any] = {}
            for g in self.registry.aggregates.values():
                if not g.property:
                    universe[g.name] = True
                elif fields := [p for p in child.properties() if p not in child.model.custom_properties and g.name in self.registry.aggregates_for(child.property_type(p))]:
                    universe[g.name] = fields
            names = _apply(self._chain("aggregates", association), [] if self.strict else list(universe), list(universe), self.context)
            return {n: universe[n] for n in universe if n in names}

        return self._once(("aggregates", association), make)

    def result_type(self, aggregate: str, association: str, field: str | None) -> str:
        g = self.registry.aggregates[aggregate]
        if g.result != "property":
            return g.result
        child = Permissions(self.registry, self.models, self.models[self.model.associations[association].target], self.context)
        return child.property_type(field or "")

    def aggregate_predicates(self, type_name: str) -> list[str]:
        return self.predicates(type_name, "aggregate")

    def to_dict(self) -> dict[str, Any]:
        label = lambda n, own=None: own or n.replace("_", " ").strip().capitalize()
        names = self.properties()
        aggregates = {a: self.aggregates(a) for a in self.associations()}
        kinds = {self.property_type(p) for p in names}
        results = sorted({self.result_type(g, a, f) for a, gs in aggregates.items() for g, fields in gs.items() for f in ([None] if fields is True else fields)})
        return {
            "properties": [{"name": p, "type": self.property_type(p), "label": label(p)} for p in names],
            "associations": [{"name": a, "type": self.model.associations[a].kind, "label": label(a), "predicates": self.association_predicates(a)} for a in self.associations()],
            "predicates": {t: [{"name": p, "label": label(p, self.registry.predicates[p].label)} for p in self.predicates(t, "property")] for t in sorted(kinds)},
            "property_predicates": {p: self.property_predicates(p) for p in names},
            "order": list(self.order()),
            "association_targets": {a: self.targets(a) for a in self.associations() if self.model.associations[a].polymorphic},
            "aggregates": {a: {g: (v if v is True else list(v)) for g, v in gs.items()} for a, gs in aggregates.items()},
            "aggregate_metadata": {g.name: {"label": label(g.name, g.label), "property": g.property, "distinct": g.distinct, "result": g.result, "zero_inclusive": g.empty_value is not None} for g in self.registry.aggregates.values()},
            "aggregate_predicates": {t: self.aggregate_predicates(t) for t in results},
        }


class PermissionCache:
    """Permissions by model and context; the older half goes when it is full, all of it when a registry changes."""

    def __init__(self) -> None:
        self._held: OrderedDict[Any, Permissions] = OrderedDict()

    def get(self, registry: Registry, models: dict[str, Model], model: Model, context: Any) -> Permissions:
        key = (id(model), id(context), registry.version, registry.settings.strict)
        found = self._held.get(key)
        if found is None or found.model is not model or found.context is not context:
            if len(self._held) >= _CACHED:
                for old in list(self._held)[: _CACHED // 2]:
                    del self._held[old]
            found = self._held[key] = Permissions(registry, models, model, context)
        return found

    def clear(self) -> None:
        self._held.clear()
