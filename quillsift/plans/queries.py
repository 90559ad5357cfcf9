"""One query per operator over the driver's tables, each with the same selection as SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.coerce import Range
from quillsift.operators.nodes import Outcome
from quillsift.plans.engine import Engine
from quillsift.sources.driver_tables import driver_models
from quillsift.sources.model import Relation, nulls_as_stored

NOW = dt.datetime(2024, 1, 16, 12)
KEYS = {
    "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey",
    "document": "doc_id", "label": "doc_id", "conversation": "conv_id, turn", "event": "event_id",
}
TABLES = {"document": "documents", "label": "labels", "conversation": "conversations", "event": "events"}


def prop(name: str, predicate: str, *args: Any, **more: Any) -> dict:
    return {"type": "property", "property": name, "predicate": predicate, "args": list(args), **more}


def group(predicate: str, *filters: dict, **more: Any) -> dict:
    return {"type": "group", "predicate": predicate, "filters": list(filters), **more}


def assoc(name: str, predicate: str, *args: Any, **more: Any) -> dict:
    return {"type": "association", "association": name, "predicate": predicate, "args": list(args), **more}


def agg(association: str, aggregate: str, predicate: str, *args: Any, **more: Any) -> dict:
    return {"type": "aggregate", "association": association, "aggregate": aggregate, "predicate": predicate, "args": list(args), **more}


def computed(tree: dict, predicate: str, *args: Any) -> dict:
    return {"type": "computed", "expression": tree, "predicate": predicate, "args": list(args)}


def op(operator: str, left: Any, right: Any) -> dict:
    return {"operator": operator, "operands": [{"property": x} if isinstance(x, str) else x if isinstance(x, dict) else {"literal": x} for x in (left, right)]}


_ORDERS = "EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = t.c_custkey AND {})"
_SOLD = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {}) AS rk FROM orders)"
_NOTE = "CASE WHEN o_orderkey % 3 <> 0 THEN 'rate_' || (o_orderkey % 100)::VARCHAR || '%' END"
_NET_BITS = "((user_id % 4) * 256 + event_id % 8)"
_AMONG = "(SELECT count(*) FROM " + _SOLD + " s WHERE s.l_partkey = t.p_partkey AND s.l_suppkey IN ({}))"

#: name: (root model, filter, SQL condition over the root table t).
SPECS: dict[str, tuple[str, dict, str]] = {
    "prop_eq": ("customer", prop("c_mktsegment", "eq", "BUILDING"), "c_mktsegment = 'BUILDING'"),
    "prop_not_eq": ("customer", prop("c_mktsegment", "not_eq", "BUILDING"), "c_mktsegment <> 'BUILDING'"),
    "prop_eq_nil": ("orders", prop("clerk_note", "eq_nil"), "o_orderkey % 3 = 0"),
    "prop_not_eq_nil": ("orders", prop("clerk_note", "not_eq_nil"), "o_orderkey % 3 <> 0"),
    "prop_eq_any": ("customer", prop("c_mktsegment", "eq_any", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "prop_eq_all": ("part", prop("p_size", "eq_all", [3, "3"]), "p_size = 3"),
    "prop_not_eq_any": ("part", prop("p_size", "not_eq_any", [3]), "p_size <> 3"),
    "prop_not_eq_all": ("part", prop("p_size", "not_eq_all", [3, 4]), "p_size <> 3 AND p_size <> 4"),
    "prop_gt": ("customer", prop("c_acctbal", "gt", 5000), "c_acctbal > 5000"),
    "prop_lt": ("customer", prop("c_acctbal", "lt", "5000"), "c_acctbal < 5000"),
    "prop_gteq": ("part", prop("p_size", "gteq", 25), "p_size >= 25"),
    "prop_lteq": ("part", prop("p_size", "lteq", 25), "p_size <= 25"),
    "prop_between": ("part", prop("p_size", "between", 10, 20), "p_size BETWEEN 10 AND 20"),
    "prop_not_between": ("part", prop("p_size", "not_between", 10, 20), "p_size NOT BETWEEN 10 AND 20"),
    "prop_between_range": ("part", prop("p_size", "between", Range(20, 10)), "p_size BETWEEN 10 AND 20"),
    "prop_between_open": ("part", prop("p_size", "between", None, 20), "p_size <= 20"),
    "temporal_within": ("event", prop("ts", "within", "P3D"), "ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-19 12:00:00'"),
    "temporal_within_next": ("event", prop("ts", "within_next", "P1W"), "ts BETWEEN TIMESTAMP '2024-01-16 12:00:00' AND TIMESTAMP '2024-01-23 12:00:00'"),
    "temporal_within_previous": ("event", prop("ts", "within_previous", "PT36H"), "ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-16 12:00:00'"),
    "temporal_not_within": ("event", prop("ts", "not_within", "P3D"), "ts NOT BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-19 12:00:00'"),
    "temporal_not_within_next": ("event", prop("ts", "not_within_next", "P1W"), "ts NOT BETWEEN TIMESTAMP '2024-01-16 12:00:00' AND TIMESTAMP '2024-01-23 12:00:00'"),
    "temporal_not_within_previous": ("event", prop("ts", "not_within_previous", "P1M"), "ts NOT BETWEEN TIMESTAMP '2023-12-16 12:00:00' AND TIMESTAMP '2024-01-16 12:00:00'"),
    "bool_eq_true": ("label", prop("is_good", "eq_true"), "doc_id % 7 <> 0 AND quality = 1"),
    "bool_eq_false": ("label", prop("is_good", "eq_false"), "doc_id % 7 <> 0 AND quality <> 1"),
    "bool_negated_null": ("label", prop("is_good", "eq_true", negate=True), "doc_id % 7 <> 0 AND quality <> 1"),
    "group_and": ("customer", group("and", prop("c_mktsegment", "eq", "BUILDING"), prop("c_acctbal", "gt", 0)), "c_mktsegment = 'BUILDING' AND c_acctbal > 0"),
    "group_or": ("customer", group("OR", prop("c_mktsegment", "eq", "BUILDING"), prop("c_acctbal", "gt", 9000)), "c_mktsegment = 'BUILDING' OR c_acctbal > 9000"),
    "group_nested": ("customer", group("and", prop("c_custkey", "lt", 700), group("or", prop("c_mktsegment", "eq", "BUILDING"), prop("c_acctbal", "lt", 0))), "c_custkey < 700 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)"),
    "group_negate": ("orders", group("and", prop("clerk_note", "ends_with", "7%"), negate="true"), f"NOT ({_NOTE} ILIKE '%7\\%' ESCAPE '\\')"),
    "group_empty_and": ("customer", group("and"), "TRUE"),
    "group_empty_or": ("customer", group("or"), "FALSE"),
    "group_order_limit_offset": ("customer", group("and", prop("c_acctbal", "gt", 0), order=[{"property": "c_acctbal", "direction": "DESC"}, {"property": "c_custkey"}], limit=20, offset=5), "c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5)"),
    "group_nested_selection": ("customer", group("and", prop("c_custkey", "lt", 700), group("and", prop("c_acctbal", "gt", 0), order=[{"property": "c_acctbal", "direction": "desc"}, {"property": "c_custkey"}], limit=50)), "c_custkey < 700 AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50)"),
    "group_negated_selection": ("part", group("and", prop("p_size", "gt", 10), negate=1, order=[{"property": "p_retailprice"}, {"property": "p_partkey"}], limit=7), "p_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10 ORDER BY p_retailprice, p_partkey LIMIT 7)"),
    "group_order_expression": ("part", group("and", order=[{"expression": op("multiply", "p_size", -1)}, {"property": "p_partkey"}], limit=9), "p_partkey IN (SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 9)"),
    "group_drops_failed": ("customer", group("and", prop("c_mktsegment", "eq", "BUILDING"), prop("no_such", "eq", 1), prop("c_custkey", "gt", "x")), "c_mktsegment = 'BUILDING'"),
    "assoc_has_any": ("part", assoc("suppliers", "has_any", [1, 2]), _AMONG.format("1, 2") + " > 0"),
    "assoc_not_has_any": ("part", assoc("suppliers", "not_has_any", [1, 2]), _AMONG.format("1, 2") + " = 0"),
    "assoc_has_all": ("part", assoc("suppliers", "has_all", [1, "2", 2]), _AMONG.format("1, 2") + " = 2"),
    "assoc_not_has_all": ("part", assoc("suppliers", "not_has_all", [1, 2]), _AMONG.format("1, 2") + " <> 2"),
    "assoc_only_has_any": ("nation", assoc("suppliers", "only_has_any", list(range(61))), "EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey <= 60) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey > 60)"),
    "assoc_only_has_all": ("region", assoc("nations", "only_has_all", [0, 5, 10, 15, 20]), "(SELECT list(n_nationkey ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) = [0, 5, 10, 15, 20]"),
    "assoc_has_all_missing_id": ("part", assoc("suppliers", "has_all", [1, 999999999]), "FALSE"),
    "assoc_empty_has_any": ("part", assoc("suppliers", "has_any", []), "FALSE"),
    "assoc_empty_only_has_all": ("part", assoc("suppliers", "only_has_all", []), "TRUE"),
    "assoc_has_any_scoped": ("customer", assoc("orders", "has_any", scoping=group("and", prop("o_totalprice", "gt", 400000))), _ORDERS.format("o_totalprice > 400000")),
    "assoc_has_all_scoped_global": ("nation", assoc("customers", "not_has_all", scoping=group("and", prop("c_custkey", "eq", 7))), "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey = 7) <> (SELECT count(*) FROM customer WHERE c_custkey = 7)"),
    "assoc_nested_scoping": ("nation", assoc("customers", "has_any", scoping=group("and", assoc("orders", "has_any", scoping=group("and", prop("o_totalprice", "gt", 495000))))), "EXISTS (SELECT 1 FROM customer c JOIN orders o ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 495000)"),
    "assoc_belongs_to": ("orders", assoc("customer", "has_any", scoping=group("and", prop("c_mktsegment", "eq", "BUILDING"))), "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"),
    "assoc_through": ("customer", assoc("region", "has_any", [1, 3]), "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey IN (1, 3))"),
    "assoc_self_ref": ("nation", assoc("siblings", "has_any", scoping=group("and", prop("n_name", "ends_with", "0"))), "n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name ILIKE '%0')"),
    "assoc_scoped_association": ("customer", assoc("urgent_orders", "not_has_any"), "NOT " + _ORDERS.format("o_orderpriority = '1-URGENT'")),
    "assoc_composite_key": ("conversation", assoc("turns", "has_any", [[1, 0], [2, 0], [3, 1]]), "EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.conv_id AND (c.conv_id, c.turn) IN ((1, 0), (2, 0), (3, 1)))"),
    "assoc_has_one_latest": ("customer", assoc("latest_order", "has_any", scoping=group("and", prop("o_orderstatus", "eq", "F"))), f"EXISTS (SELECT 1 FROM {_RANKED.format('o_orderdate DESC, o_orderkey')} r WHERE r.o_custkey = t.c_custkey AND rk = 1 AND o_orderstatus = 'F')"),
    "assoc_top_n": ("customer", agg("top3_orders", "sum", "gt", 1000000, property="o_totalprice"), f"(SELECT sum(o_totalprice) FROM {_RANKED.format('o_totalprice DESC, o_orderkey')} r WHERE r.o_custkey = t.c_custkey AND rk <= 3) > 1000000"),
    "assoc_offset_only": ("customer", agg("later_orders", "count", "gteq", 3), f"(SELECT count(*) FROM {_RANKED.format('o_totalprice DESC, o_orderkey')} r WHERE r.o_custkey = t.c_custkey AND rk > 10) >= 3"),
    "assoc_distinct_ranked": ("part", assoc("first_suppliers", "has_any", list(range(1, 31))), f"EXISTS (SELECT 1 FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM {_SOLD} s JOIN supplier ON s_suppkey = l_suppkey) r WHERE r.l_partkey = t.p_partkey AND rk <= 2 AND l_suppkey BETWEEN 1 AND 30)"),
    "assoc_polymorphic": ("event", assoc("subject", "has_any", target_type="click", scoping=group("and", prop("c_acctbal", "gt", 0))), "event_type = 'click' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)"),
    "agg_count": ("customer", agg("orders", "count", "gteq", 12), "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 12"),
    "agg_count_zero": ("orders", agg("lineitems", "count", "eq", 0), "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "agg_count_scoped_zero": ("customer", agg("orders", "count", "lteq", 1, scoping=group("and", prop("o_orderstatus", "eq", "P"))), "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') <= 1"),
    "agg_count_distinct": ("part", agg("suppliers", "count", "gteq", 25, distinct=True), f"(SELECT count(*) FROM {_SOLD} s WHERE l_partkey = p_partkey) >= 25"),
    "agg_count_rows": ("part", agg("suppliers", "count", "gteq", 30), "(SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) >= 30"),
    "agg_sum": ("orders", agg("lineitems", "sum", "gt", 150, property="l_quantity"), "(SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) > 150"),
    "agg_sum_distinct": ("orders", agg("lineitems", "sum", "gt", 20, property="l_linenumber", distinct=True), "(SELECT sum(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) > 20"),
    "agg_avg": ("customer", agg("orders", "avg", "gt", 260000.125, property="o_totalprice"), "(SELECT avg(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 260000.125"),
    "agg_avg_distinct": ("orders", agg("lineitems", "avg", "gteq", 5, property="l_linenumber", distinct=True), "(SELECT avg(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) >= 5"),
    "agg_min": ("customer", agg("orders", "min", "lt", 3000, property="o_totalprice"), "(SELECT min(o_totalprice) FROM orders WHERE o_custkey = c_custkey) < 3000"),
    "agg_max": ("customer", agg("orders", "max", "gteq", "1998-01-01", property="o_orderdate"), "(SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) >= TIMESTAMP '1998-01-01'"),
    "agg_between": ("customer", agg("orders", "count", "between", "8", "10"), "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) BETWEEN 8 AND 10"),
    "agg_or_property": ("customer", group("or", agg("orders", "count", "gteq", 15), prop("c_acctbal", "gt", 9500)), "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 15 OR c_acctbal > 9500"),
    "agg_negate": ("orders", agg("lineitems", "count", "gt", 2, negate=True), "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) <= 2"),
    "agg_has_one": ("document", agg("label", "count", "eq", 0), "doc_id NOT IN (SELECT doc_id FROM labels)"),
    "computed_add": ("part", computed(op("add", "p_size", 10), "gt", 40), "p_size + 10 > 40"),
    "computed_subtract": ("part", computed(op("subtract", "p_partkey", "p_size"), "lt", 0), "p_partkey - p_size < 0"),
    "computed_multiply": ("part", computed(op("multiply", "p_size", "p_size"), "between", 100, 400), "p_size * p_size BETWEEN 100 AND 400"),
    "computed_divide": ("part", computed(op("divide", "p_size", 2), "eq", 3.5), "p_size = 7"),
    "computed_divide_by_zero": ("part", computed(op("divide", "p_size", op("subtract", "p_size", 7)), "gteq", 1), "p_size <> 7 AND p_size::DOUBLE / nullif(p_size - 7, 0) >= 1"),
    "computed_nested": ("part", computed(op("add", op("multiply", "p_size", 2), op("subtract", "p_partkey", 5)), "eq_any", [100, 101, 200]), "p_size * 2 + p_partkey - 5 IN (100, 101, 200)"),
    "custom_property_true": ("customer", prop("rich_builder", "eq_true"), "c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "custom_property_false": ("customer", prop("rich_builder", "eq_false"), "NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 5000)"),
    "json_contains": ("event", prop("props", "contains", {"k": 87}), "json_extract(props, '$.k')::VARCHAR = '87'"),
    "array_contains": ("part", prop("tags", "array_contains", "PROMO"), "list_contains(string_split(p_type, ' '), 'PROMO')"),
    "array_contained_by": ("part", prop("sizes", "array_contained_by", [5, 6, 7]), "p_size IN (5, 6)"),
    "array_overlaps": ("part", prop("sizes", "array_overlaps", [10, 20]), "p_size IN (9, 10, 19, 20)"),
    "range_contains": ("orders", prop("period", "range_contains", dt.date(1996, 6, 15)), "DATE '1996-06-15' >= o_orderdate::DATE AND DATE '1996-06-15' < o_orderdate::DATE + 30"),
    "range_contained_by": ("orders", prop("period", "range_contained_by", Range(dt.date(1996, 1, 1), dt.date(1996, 12, 31), True, True)), "o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE + 30 <= DATE '1997-01-01'"),
    "range_overlaps": ("orders", prop("period", "range_overlaps", Range(dt.date(1996, 1, 1), dt.date(1996, 2, 1))), "o_orderdate::DATE < DATE '1996-02-01' AND o_orderdate::DATE + 30 > DATE '1996-01-01'"),
    "range_strictly_left_of": ("orders", prop("period", "range_strictly_left_of", Range(dt.date(1996, 1, 1), None)), "o_orderdate::DATE + 30 <= DATE '1996-01-01'"),
    "range_strictly_right_of": ("orders", prop("period", "range_strictly_right_of", Range(None, dt.date(1997, 1, 1))), "o_orderdate::DATE >= DATE '1997-01-01'"),
    "range_adjacent_to": ("orders", prop("period", "range_adjacent_to", Range(dt.date(1995, 3, 1), dt.date(1996, 3, 1))), "o_orderdate::DATE = DATE '1996-03-01' OR o_orderdate::DATE + 30 = DATE '1995-03-01'"),
    "inet_contains": ("event", prop("net", "inet_contains", "10.1.3.0/24"), f"event_id % 2 = 0 AND {_NET_BITS} // 256 = 1"),
    "inet_contained_within": ("event", prop("net", "inet_contained_within", "10.2.0.0/16"), f"event_id % 2 = 1 AND {_NET_BITS} // 256 = 2"),
    "inet_overlaps": ("event", prop("net", "inet_overlaps", "10.1.3.0/24"), f"({_NET_BITS} // 256 = 1) AND (event_id % 2 = 0 OR event_id % 8 = 3)"),
}

for _name, _sql, _any, _all in (
    ("matches", "p_name ILIKE '%{}%' ESCAPE '\\'", ["old", "PLATE"], ["old", "PLATE"]), ("starts_with", "p_name ILIKE '{}%' ESCAPE '\\'", ["RED", "hot"], ["re", "RED P"]), ("ends_with", "p_name ILIKE '%{}' ESCAPE '\\'", ["BOLT", "ring"], ["e", "d plate"]),
    ("does_not_match", "p_name NOT ILIKE '%{}%' ESCAPE '\\'", ["old", "PLATE"], ["old", "PLATE"]), ("does_not_start_with", "p_name NOT ILIKE '{}%' ESCAPE '\\'", ["re", "RED P"], ["RED", "hot"]), ("does_not_end_with", "p_name NOT ILIKE '%{}' ESCAPE '\\'", ["e", "d plate"], ["BOLT", "ring"]),
):
    SPECS[f"text_{_name}"] = ("part", prop("p_name", _name, _any[0]), _sql.format(_any[0]))
    SPECS[f"text_{_name}_any"] = ("part", prop("p_name", f"{_name}_any", _any), " OR ".join(_sql.format(v) for v in _any))
    SPECS[f"text_{_name}_all"] = ("part", prop("p_name", f"{_name}_all", _all), " AND ".join(_sql.format(v) for v in _all))
SPECS["text_escaped"] = ("orders", prop("clerk_note", "matches", "_50%"), f"{_NOTE} LIKE '%\\_50\\%%' ESCAPE '\\'")


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(driver_models(spark, sf_dir).values(), clock=lambda: NOW)


def _spec_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    model, tree, _ = SPECS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir)
        return engine.compile_filter(model, tree).to_df().select(*KEYS[model].split(", "))

    run.__name__ = name
    return run


def assoc_candidate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are a paged relation: the five suppliers with the greatest balance."""
    engine = _engine(spark, sf_dir)
    top = engine.models["supplier"].all().order_by(F.col("s_acctbal").desc(), F.col("s_suppkey")).limit(5)
    return engine.filter_records_by("part", assoc("suppliers", "has_any", top)).to_df().select("p_partkey")


def assoc_candidate_query_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    some = engine.models["supplier"].all().where(F.col("s_suppkey") <= 2)
    return engine.filter_records_by("part", assoc("suppliers", "has_all", some)).to_df().select("p_partkey")


def assoc_candidate_query_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty candidate query is contained in every owner's children."""
    engine = _engine(spark, sf_dir)
    none = engine.models["supplier"].all().where(F.col("s_suppkey") < 0)
    return engine.filter_records_by("part", assoc("suppliers", "only_has_all", none)).to_df().select("p_partkey")


def caller_page_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's page is taken after the filter."""
    engine = _engine(spark, sf_dir)
    page = engine.models["customer"].all().order_by(F.col("c_acctbal").desc(), F.col("c_custkey")).offset(3).limit(10)
    return engine.filter_records_by(page, prop("c_mktsegment", "eq", "BUILDING")).to_df().select("c_custkey")


def derived_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation over a derived table that keeps the key."""
    engine = _engine(spark, sf_dir)
    model = engine.models["customer"]
    spent = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return engine.filter_records_by(Relation(model, model.load().join(spent, "c_custkey").where("top > 300000")), prop("c_acctbal", "lt", 0)).to_df().select("c_custkey")


def model_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory scopes hold for roots and children: only P and F orders exist for this caller."""
    engine = _engine(spark, sf_dir)
    engine.register(engine.models["orders"].add_scope(lambda df, ctx: df.where(F.col("o_orderstatus").isin(ctx))))
    return engine.filter_records_by("customer", agg("orders", "count", "lteq", 4), ["P", "F"]).to_df().select("c_custkey")


def transform_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    model = engine.models["customer"].transform("c_mktsegment", "attribute", F.lower).transform("c_mktsegment", "value", str.lower)
    engine.register(model)
    return engine.filter_records_by("customer", prop("c_mktsegment", "eq", "bUILDING")).to_df().select("c_custkey")


def transform_value_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions around column and operands, whatever form the operands have."""
    engine = _engine(spark, sf_dir)
    model = engine.models["customer"].transform("c_mktsegment", "attribute", F.lower).transform("c_mktsegment", "value_node", F.lower)
    engine.register(model)
    tree = group("or", prop("c_mktsegment", "eq_any", ["BUILDING", "household"]), prop("c_mktsegment", "starts_with_any", ["AUTO"]))
    return engine.filter_records_by("customer", tree).to_df().select("c_custkey")


def caller_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation of the caller's own whose repeated rows are taken once."""
    engine = _engine(spark, sf_dir)
    model = engine.models["customer"]
    twice = model.load().select("c_custkey", "c_acctbal")
    return engine.filter_records_by(Relation(model, twice.union(twice)).distinct(), prop("c_acctbal", "lt", 0)).to_df().select("c_custkey")


def custom_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.registry.register_predicate("multiple_of", "integer", fn=lambda c, n: c % F.lit(n) == 0, compounds=True)
    return engine.filter_records_by("part", prop("p_size", "multiple_of_any", [7, 11])).to_df().select("p_partkey")


def custom_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.registry.register_aggregate("spread", "summable", fn=lambda c, distinct: F.max(c) - F.min(c))
    return engine.filter_records_by("customer", agg("orders", "spread", "gt", 400000, property="o_totalprice")).to_df().select("c_custkey")


def owner_count_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.registry.register_association_predicate("has_at_least", lambda member, n, ids: member.owner_count_at_least(n, ids))
    return engine.filter_records_by("part", assoc("suppliers", "has_at_least", 2, [1, 2, 3, 4, 5])).to_df().select("p_partkey")


def matching_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An association predicate of the host's own from the pairs of an owner's matching children."""
    engine = _engine(spark, sf_dir)

    def has_just_one_of(member, ids):
        counts = member.matching(ids).groupBy(*member.owner_names).agg(F.count_distinct(*member.child_names).alias("n"))
        return member.owners(counts.where("n = 1"))

    engine.registry.register_association_predicate("has_just_one_of", has_just_one_of)
    return engine.filter_records_by("part", assoc("suppliers", "has_just_one_of", [1, 2, 3, 4, 5])).to_df().select("p_partkey")


def owner_child_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.registry.register_association_predicate("has_key_below", lambda member, key: member.owner_child_predicate("lt", key))
    return engine.filter_records_by("customer", assoc("orders", "has_key_below", 500)).to_df().select("c_custkey")


def host_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node type of the host's own, beside built-in ones."""
    engine = _engine(spark, sf_dir)

    def even(compiler, payload, scope, path):
        return Outcome("success", scope.column(payload["column"]) % 2 == 0)

    engine.registry.register_filter("even", even)
    return engine.filter_records_by("customer", group("and", {"type": "even", "column": "c_custkey"}, {"type": "even", "column": "c_nationkey", "negate": True})).to_df().select("c_custkey")


def order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    rel = engine.models["orders"].all().order_by(nulls_as_stored(F.col("clerk_note"), "desc"), F.col("o_orderkey")).limit(12)
    return engine.filter_records_by(rel, prop("o_totalprice", "gt", 1000)).to_df().select("o_orderkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment with many orders and no small one, or with a supplier nation of a given region."""
    engine = _engine(spark, sf_dir)
    tree = group("or", group("and", prop("c_mktsegment", "eq", "BUILDING"), agg("orders", "count", "gteq", 12)), group("and", assoc("region", "has_any", [2]), agg("orders", "min", "gt", 100000, property="o_totalprice")))
    return engine.filter_records_by("customer", tree).to_df().select("c_custkey")


_OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "assoc_candidate_query": (assoc_candidate_query, f"SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM {_SOLD} s WHERE l_partkey = p_partkey AND l_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5))"),
    "assoc_candidate_query_all": (assoc_candidate_query_all, f"SELECT p_partkey FROM part t WHERE {_AMONG.format('0, 1, 2')} = 3"),
    "assoc_candidate_query_empty": (assoc_candidate_query_empty, "SELECT p_partkey FROM part"),
    "caller_page_preserved": (caller_page_preserved, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 3"),
    "derived_source": (derived_source, "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 300000"),
    "model_scope": (model_scope, "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('P', 'F')) <= 4"),
    "transform_lower": (transform_lower, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "transform_value_node": (transform_value_node, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'household') OR lower(c_mktsegment) LIKE 'auto%'"),
    "caller_distinct": (caller_distinct, "SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "custom_predicate": (custom_predicate, "SELECT p_partkey FROM part WHERE p_size % 7 = 0 OR p_size % 11 = 0"),
    "custom_aggregate": (custom_aggregate, "SELECT c_custkey FROM customer WHERE (SELECT max(o_totalprice) - min(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 400000"),
    "owner_count_at_least": (owner_count_at_least, f"SELECT p_partkey FROM part t WHERE {_AMONG.format('1, 2, 3, 4, 5')} >= 2"),
    "matching_children": (matching_children, f"SELECT p_partkey FROM part t WHERE {_AMONG.format('1, 2, 3, 4, 5')} = 1"),
    "owner_child_predicate": (owner_child_predicate, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey < 500)"),
    "host_node": (host_node, "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 2 <> 0"),
    "order_nulls": (order_nulls, f"SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY {_NOTE} DESC NULLS FIRST, o_orderkey LIMIT 12"),
    "flagship": (flagship, "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 12) OR (EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2) AND (SELECT min(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 100000)"),
}

QUERIES = {name: _spec_query(name) for name in SPECS} | {name: q for name, (q, _) in _OTHERS.items()}
SQL = {name: f"SELECT {KEYS[m]} FROM {TABLES.get(m, m)} t WHERE {cond}" for name, (m, _, cond) in SPECS.items()} | {name: s for name, (_, s) in _OTHERS.items()}
