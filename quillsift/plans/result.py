"""What a compiled filter returns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from quillsift.sources.model import Relation

CATEGORIES = ("invalid_filter", "permission_denied", "callback_error", "scope_error")


@dataclass(frozen=True)
class Diagnostic:
    category: str
    code: str
    path: tuple[Any, ...]
    message: str

    def to_dict(self) -> dict[str, Any]:
        return {"category": self.category, "code": self.code, "path": list(self.path), "message": self.message}


@dataclass(frozen=True)
class Result:
    status: str
    relation: Relation
    diagnostics: tuple[Diagnostic, ...] = ()

    def __post_init__(self) -> None:
        if self.status not in ("success", "partial", "failed"):
            raise ValueError(f"unknown status {self.status!r}")
        if (self.status == "success") != (not self.diagnostics):
            raise ValueError("a result has diagnostics unless it is a success")

    @property
    def success(self) -> bool:
        return self.status == "success"

    @property
    def partial(self) -> bool:
        return self.status == "partial"

    @property
    def failed(self) -> bool:
        return self.status == "failed"

    def to_df(self) -> DataFrame:
        return self.relation.to_df()


class InvalidFilterError(ValueError):
    """Raised under the policy `raise`; result is what the policy `skip` would have returned."""

    def __init__(self, result: Result):
        super().__init__("; ".join(d.message for d in result.diagnostics))
        self.result = result


class CallbackError(RuntimeError):
    """A host callback failed."""
