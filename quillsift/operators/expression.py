"""Arithmetic trees over a model's columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.coerce import literal_number

OPERATORS = ("add", "subtract", "multiply", "divide")


class ExpressionError(ValueError):
    def __init__(self, message: str, path: tuple, code: str = "invalid_expression"):
        super().__init__(message)
        self.path, self.code = path, code


def build(tree: Any, column: Callable[[str, tuple], Column], kind: Callable[[str], str], path: tuple = ("expression",)) -> tuple[Column, str, list[str]]:
    """(column, type, property leaves) of {property}, {literal} or {operator, operands: [left, right]}."""
    if not isinstance(tree, dict):
        raise ExpressionError("an expression is a mapping", path)
    if "property" in tree:
        name = tree["property"]
        if not isinstance(name, str):
            raise ExpressionError("a property is a name", (*path, "property"))
        return column(name, (*path, "property")), kind(name), [name]
    if "literal" in tree:
        if not literal_number(tree["literal"]):
            raise ExpressionError("a literal is a finite number", (*path, "literal"))
        return F.lit(tree["literal"]), "numerical", []
    operator, operands = tree.get("operator"), tree.get("operands")
    if operator not in OPERATORS:
        raise ExpressionError(f"unknown operator {operator!r}", (*path, "operator"))
    if not isinstance(operands, list) or len(operands) != 2:
        raise ExpressionError("an operator takes two operands", (*path, "operands"))
    (left, a, p), (right, b, q) = (build(x, column, kind, (*path, "operands", k)) for k, x in enumerate(operands))
    if operator == "divide":
        if literal_number(operands[1].get("literal")) and operands[1]["literal"] == 0:
            raise ExpressionError("division by zero", (*path, "operands", 1, "literal"))
        exact = "float" not in (a, b) and not any(isinstance(x.get("literal"), float) for x in operands)
        out = left.cast("decimal(38,10)" if exact else "double") / F.nullif(right, F.lit(0))
    else:
        out = left + right if operator == "add" else left - right if operator == "subtract" else left * right
    return out, "float" if "float" in (a, b) else "numerical", p + q
