"""Logical type groups and the Spark types that they stand for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

#: Group -> members, a directed acyclic graph over names; fixed values.
GROUPS: dict[str, tuple[str, ...]] = {
    "numerical": ("integer", "float", "decimal", "interval", "binary", "temporal"),
    "textual": ("string", "text", "binary", "enum"),
    "temporal": ("date", "time", "datetime", "timestamp"),
    "boolean": (),
    "association": ("many_association", "single_association"),
    "many_association": ("has_many", "has_and_belongs_to_many"),
    "single_association": ("has_one", "belongs_to"),
    "summable": ("integer", "float", "decimal"),
    "orderable": ("numerical", "temporal", "textual"),
    "identifier": ("uuid", "primary_key"),
    "network": ("inet", "cidr"),
    "array": ("string_array", "integer_array", "text_array"),
    "json": ("jsonb",),
    "range": ("daterange", "tsrange", "tstzrange", "int4range", "int8range", "numrange"),
}


class TypeRegistry:
    """Named groups with members; a type's family is itself with all that is above or below it."""

    def __init__(self, groups: dict[str, tuple[str, ...]] | None = None):
        self._members = {k: set(v) for k, v in (GROUPS if groups is None else groups).items()}

    def register(self, group: str, *members: str) -> None:
        self._members.setdefault(group, set()).update(members)

    def unregister(self, group: str, *members: str) -> None:
        if not members:
            self._members.pop(group, None)
        else:
            self._members.get(group, set()).difference_update(members)

    def _closure(self, start: str, step) -> list[str]:
        seen, todo = [], [start]
        while todo:  # cycles end where a name is met again
            for x in sorted(step(todo.pop(0))):
                if x not in seen and x != start:
                    seen.append(x)
                    todo.append(x)
        return seen

    def ancestors(self, name: str) -> list[str]:
        return self._closure(name, lambda n: [g for g, m in self._members.items() if n in m])

    def descendants(self, name: str) -> list[str]:
        return self._closure(name, lambda n: self._members.get(n, ()))

    def family(self, name: str) -> set[str]:
        return {"all", name, *self.ancestors(name), *self.descendants(name)}

    def specificity(self, name: str) -> list[str]:
        """From general to special: ancestors, the farthest first; the type; its members."""
        return [*reversed(self.ancestors(name)), name, *self.descendants(name)]

    def is_a(self, name: str, group: str) -> bool:
        return name == group or group in self.ancestors(name)

    def shares(self, name: str, registered: Iterable[str]) -> bool:
        return bool(self.family(name) & set(registered))


def logical_type(field: T.StructField) -> str:
    """The logical type of a column; metadata {"logical": name} overrides what its Spark type says."""
    if name := (field.metadata or {}).get("logical"):
        return name
    kind = field.dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        return "string_array" if isinstance(element, T.StringType) else "integer_array" if isinstance(element, (T.IntegerType, T.LongType, T.ShortType)) else "array"
    if isinstance(kind, T.StructType) and {"lower", "upper"} <= set(kind.names):
        bound = kind["lower"].dataType
        return "daterange" if isinstance(bound, T.DateType) else "tsrange" if isinstance(bound, (T.TimestampType, T.TimestampNTZType)) else "int8range" if isinstance(bound, T.IntegralType) else "numrange"
    for spark, name in (
        (T.DecimalType, "decimal"), (T.DateType, "date"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.BooleanType, "boolean"),
        (T.BinaryType, "binary"), (T.DayTimeIntervalType, "interval"), (T.YearMonthIntervalType, "interval"), (T.StructType, "json"), (T.MapType, "json"), (T.VariantType, "json"),
    ):
        if isinstance(kind, spark):
            return name
    return "string"
