"""Filters of streams: property and computed conditions are stateless and run on a streaming DataFrame as they are."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from quillsift.plans.engine import Engine
from quillsift.sources.model import FilterError, Model, Relation


def filter_stream(engine: Engine, model: Model, stream: DataFrame, tree: dict, context: Any = None) -> DataFrame:
    """stream filtered by a tree of groups, property and computed nodes; other nodes and selections would need state."""

    def check(node: Any) -> None:
        if isinstance(node, dict):
            if node.get("type", "group") not in ("group", "property", "computed") or any(node.get(k) is not None for k in ("order", "limit", "offset")):
                raise FilterError("a stream takes property and computed filters without order, limit or offset")
            for child in node.get("filters") or []:
                check(child)

    check(tree)
    return engine.compile_filter(Relation(model, stream), tree, context).to_df()
