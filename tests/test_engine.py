"""Semantics on small inline tables: identities, paging, permissions, diagnostics, policies."""

import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from quillsift.functions.coerce import CoercionError, Range, boolean, duration, shifted
from quillsift.functions.predicates import builtin, json_within
from quillsift.functions.types import TypeRegistry
from quillsift.operators.association import EMPTY, Membership, canonical_ids
from quillsift.operators.nodes import Compiler
from quillsift.plans.config import Settings
from quillsift.plans.engine import Engine
from quillsift.plans.queries import agg, assoc, computed, group, op, prop
from quillsift.plans.result import CallbackError, InvalidFilterError, Result
from quillsift.sources.model import Association, FilterError, Model, Relation, Scope
from quillsift.streaming.stateless import filter_stream

NOW = dt.datetime(2024, 3, 31, 12)


@pytest.fixture(scope="module")
def engine(spark):
    owners = spark.createDataFrame([(1, "one", 5, None, True), (2, "two", 20, 7, False), (3, "None_50%", None, 7, None)], "id long, name string, amount int, tenant_id int, active boolean").cache()
    children = spark.createDataFrame([(10, 1, "a", 5, 1), (11, 1, "b", 20, 1), (12, 2, "c", 30, 0), (13, None, "d", 1, 0)], "id long, owner_id long, name string, amount int, status int").cache()
    pairs = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (2, "x", "r")], "tenant long, code string, label string").cache()
    kids = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "x"), (4, 2, "x")], "id long, tenant long, code string").cache()
    latest = Scope(order=(lambda: F.col("id").desc(),), limit=1)
    owner = Model("owner", lambda: owners, ("id",), {
        "children": Association("children", "has_many", "child", child_cols=("owner_id",)),
        "latest": Association("latest", "has_many", "child", child_cols=("owner_id",), scope=latest),
        "first": Association("first", "has_one", "child", child_cols=("owner_id",)),
    }, custom_properties={"big": {"type": "property", "property": "amount", "predicate": "gt", "args": [10]}})
    child = Model("child", lambda: children, ("id",), {"owner": Association("owner", "belongs_to", "owner", ("owner_id",))}, enums={"status": {"off": 0, "on": 1}})
    parent = Model("pair", lambda: pairs, ("tenant", "code"), {"kids": Association("kids", "has_many", "kid", child_cols=("tenant", "code"))})
    kid = Model("kid", lambda: kids, ("id",), {"pair": Association("pair", "belongs_to", "pair", ("tenant", "code"), ("tenant", "code"))})
    return Engine([owner, child, parent, kid], clock=lambda: NOW)


def ids(engine, model, tree, context=None):
    rows = engine.filter_records_by(model, tree, context).to_df().collect()
    return sorted(r["id"] for r in rows)


def test_all_59_predicates_are_there():
    assert len(builtin()) == 59 and len({p.name for p in builtin()}) == 59


@pytest.mark.parametrize("predicate", list(EMPTY))
def test_empty_candidates(engine, predicate):
    assert ids(engine, "owner", assoc("children", predicate, [])) == ([1, 2, 3] if EMPTY[predicate] else [])


def test_set_predicates(engine):
    assert ids(engine, "owner", assoc("children", "has_any", [10, 12])) == [1, 2]
    assert ids(engine, "owner", assoc("children", "not_has_any", [10])) == [2, 3]
    assert ids(engine, "owner", assoc("children", "has_all", ["10", 11])) == [1]
    assert ids(engine, "owner", assoc("children", "not_has_all", [10, 11])) == [2, 3]
    assert ids(engine, "owner", assoc("children", "has_all", [10, 999])) == []
    assert ids(engine, "owner", assoc("children", "only_has_any", [10, 11, 99])) == [1]
    assert ids(engine, "owner", assoc("children", "only_has_all", 12)) == [2]
    assert ids(engine, "owner", assoc("children", "only_has_all", [10])) == []
    assert ids(engine, "owner", assoc("children", "has_any")) == [1, 2]
    assert ids(engine, "owner", assoc("latest", "has_all", [11])) == [1]
    assert ids(engine, "owner", assoc("first", "has_any", [11])) == []
    assert ids(engine, "child", assoc("owner", "not_has_any", [1])) == [12, 13]


def test_candidate_queries(engine):
    child = engine.models["child"].all()
    assert ids(engine, "owner", assoc("children", "has_all", child.where(F.col("id") < 0))) == [1, 2, 3]
    assert ids(engine, "owner", assoc("children", "has_all", child.where(F.col("owner_id") == 1))) == [1]
    assert ids(engine, "owner", assoc("children", "has_any", child.order_by(F.col("name").desc()).limit(2))) == [2]
    assert ids(engine, "owner", assoc("children", "has_any", child.df.where("id = 10").collect()[0])) == [1]


def test_composite_keys(engine):
    got = engine.filter_records_by("kid", assoc("pair", "has_any", [[1, "x"], [2, "x"]])).to_df().collect()
    assert sorted(r["id"] for r in got) == [1, 3, 4]
    got = engine.filter_records_by("pair", agg("kids", "count", "gteq", 2)).to_df().collect()
    assert [(r["tenant"], r["code"]) for r in got] == [(2, "x")]


def test_aggregates_and_zero(engine):
    assert ids(engine, "owner", agg("children", "count", "eq", 0)) == [3]
    assert ids(engine, "owner", agg("children", "count", "lteq", 1, scoping=group("and", prop("status", "eq", "on")))) == [2, 3]
    assert ids(engine, "owner", agg("children", "sum", "lt", 100, property="amount")) == [1, 2]
    assert ids(engine, "owner", agg("latest", "sum", "eq", 20, property="amount")) == [1]
    assert ids(engine, "owner", agg("children", "min", "between", 2, 10, property="amount")) == [1]
    assert ids(engine, "owner", agg("children", "count", "gt", 0, negate=True)) == [3]


def test_filter_comes_before_the_page(engine):
    page = engine.models["owner"].all().order_by(F.col("id").desc()).limit(1)
    assert ids(engine, page, prop("amount", "gteq", 5)) == [2]
    assert ids(engine, page.limit(5), group("and", order=[{"property": "id"}], limit=1, offset=1)) == [2]


def test_nulls_stay_unknown_under_negation(engine):
    assert ids(engine, "owner", prop("amount", "gt", 10, negate=True)) == [1]
    assert ids(engine, "owner", prop("amount", "not_eq", 5)) == [2]
    assert ids(engine, "owner", prop("amount", "eq", None)) == [3]
    assert ids(engine, "owner", prop("amount", "between", "2", "10")) == [1]
    assert ids(engine, "owner", prop("name", "matches", "_50%")) == [3]
    assert ids(engine, "owner", prop("big", "eq_false")) == [1]


def test_group_identities(engine):
    assert ids(engine, "owner", group("and")) == [1, 2, 3] and ids(engine, "owner", group("or")) == []
    assert ids(engine, "owner", group("or", negate="1")) == [1, 2, 3]
    assert ids(engine, "owner", {"predicate": "AND", "filters": [prop("id", "eq", 1)]}) == [1]


def test_computed(engine):
    assert ids(engine, "owner", computed(op("divide", "amount", op("subtract", "amount", 5)), "gt", 1)) == [2]
    assert ids(engine, "owner", computed(op("add", "amount", "tenant_id"), "eq", 27)) == [2]
    got = engine.compile_filter("owner", computed(op("divide", "amount", 0), "eq", 1))
    assert got.failed and got.diagnostics[0].path == ("expression", "operands", 1, "literal")


def test_diagnostics_and_status(engine):
    got = engine.compile_filter("owner", group("and", prop("amount", "gteq", 5), prop("nope", "eq", 1), assoc("children", "eq", 1)))
    assert got.partial and [(d.code, d.path) for d in got.diagnostics] == [("property_denied", ("filters", 1, "property")), ("unsupported_predicate", ("filters", 2, "predicate"))]
    assert sorted(r["id"] for r in got.to_df().collect()) == [1, 2]
    for tree, code in (
        ({"type": "zap"}, "unknown_filter_type"), (prop("amount", "zap"), "unknown_predicate"), (prop("amount", "eq_true"), "predicate_denied"), (prop("amount", "eq", "x"), "invalid_filter_args"),
        (prop("amount", "eq"), "invalid_filter_args"), (assoc("nope", "has_any"), "unknown_association"), (agg("children", "zap", "eq", 1), "unknown_aggregate"), (agg("children", "sum", "eq", 1), "invalid_aggregate_property"),
        ({"type": "group", "predicate": "and"}, "invalid_group"), ({"type": "group", "predicate": "xor", "filters": []}, "invalid_group_predicate"), (assoc("children", "has_any", scoping=[]), "invalid_scoping"),
        (assoc("children", "has_any", [None]), "invalid_filter_args"), (assoc("children", "has_any", [1.5]), "invalid_filter_args"), (assoc("children", "has_any", {"a": 1}), "invalid_filter_args"), (agg("children", "count", "eq", 1.5), "invalid_filter_args"),
        (group("and", limit=-1), "invalid_filter"), (computed({"property": "nope"}, "eq", 1), "property_denied"), ([], "invalid_filter_element"),
    ):
        got = engine.compile_filter("owner", tree)
        assert got.failed and got.diagnostics[0].code == code, (tree, got.diagnostics)
    # a malformed root leaves the authorised rows, a denied one none
    assert ids(engine, "owner", prop("amount", "eq", "x")) == [1, 2, 3] and ids(engine, "owner", prop("nope", "eq", 1)) == []


def test_limits(engine):
    deep = prop("id", "eq", 1)
    for _ in range(20):
        deep = group("and", deep)
    assert engine.validate_filter("owner", deep)
    loop = group("and")
    loop["filters"].append(loop)
    assert "itself" in engine.validate_filter("owner", loop)[0].message
    assert engine.validate_filter("owner", prop("id", "eq_any", list(range(2000))))
    with engine.registry.temporary(max_bytes=10):
        assert engine.validate_filter("owner", prop("name", "eq", "x" * 50))


def test_policies(engine, caplog):
    bad = group("and", prop("amount", "gt", 1), prop("nope", "eq", 1))
    with engine.registry.temporary(invalid_filter_policy="raise"), pytest.raises(InvalidFilterError) as e:
        engine.compile_filter("owner", bad)
    assert e.value.result.partial
    with engine.registry.temporary(invalid_filter_policy="match_none", log=True), caplog.at_level(logging.WARNING, "quillsift"):
        assert ids(engine, "owner", bad) == []
    assert "property_denied" in caplog.text


def test_scopes_and_model_rules(spark, engine):
    models = dict(engine.models)
    scoped = Engine([models["owner"].add_scope(lambda df, tenant: df.where(F.col("tenant_id") == tenant)), models["child"].add_scope(lambda df, tenant: df.where("amount > 5"))], clock=lambda: NOW)
    assert ids(scoped, "owner", group("and"), 7) == [2, 3]
    assert ids(scoped, "owner", agg("children", "count", "eq", 0), 7) == [3]
    assert ids(scoped, "owner", assoc("children", "has_all", [12, 10]), 7) == []
    broken = Engine([models["owner"].add_scope(lambda df, ctx: 1 / 0)])
    got = broken.compile_filter("owner", group("and"))
    assert got.diagnostics[0].category == "scope_error" and got.to_df().count() == 0
    denied = Engine([models["owner"].allow(True).allow(lambda ctx: ctx == "admin")])
    assert ids(denied, "owner", group("and"), "admin") == [1, 2, 3]
    assert denied.compile_filter("owner", group("and"), "x").diagnostics[0].code == "model_denied"


def test_permission_chains(engine):
    owner = engine.models["owner"]
    m = owner.permit("properties", "blacklist", ["name"]).permit("properties", "includelist", lambda ctx: ["name"] if ctx == "admin" else [])
    m = m.permit("predicates", "blacklist", ["gt", "lt"]).permit("predicates", "includelist", ["gt"], ("property", "amount")).permit("order", "whitelist", ["id"]).permit("aggregates", "whitelist", ["count"], "children")
    e = Engine([m, engine.models["child"]])
    cap = e.filter_capabilities("owner", "x")
    names = [p["name"] for p in cap["properties"]]
    assert "name" not in names and "big" in names and cap["order"] == ["id"]
    assert "gt" in cap["property_predicates"]["amount"] and "lt" not in cap["property_predicates"]["amount"] and "gt" not in cap["property_predicates"]["id"]
    assert cap["property_predicates"]["big"] == ["eq_true", "eq_false"] and list(cap["aggregates"]["children"]) == ["count"]
    assert "name" in [p["name"] for p in e.filter_capabilities("owner", "admin")["properties"]]
    assert len(cap) == 9 and e.filter_capabilities("zap")["error"]
    strict = Engine([owner, engine.models["child"]], Settings(strict=True)).filter_capabilities("owner")
    assert [p["name"] for p in strict["properties"]] == ["big"] and strict["associations"] == []


def test_callbacks(engine):
    e = Engine([engine.models["owner"].permit("properties", "whitelist", lambda ctx: 1)])
    with pytest.raises(CallbackError):
        e.compile_filter("owner", prop("id", "eq", 1))
    with e.registry.temporary(callback_error_policy="match_none"):
        assert e.compile_filter("owner", prop("id", "eq", 1)).to_df().count() == 0


def test_registry(engine):
    e = Engine(engine.models.values())
    r = e.registry
    r.register_predicate("even", "integer", fn=lambda c: c % 2 == 0)
    r.register_predicate("near", "integer", fn=lambda c, v, by=1: F.abs(c - F.lit(v)) <= by, validator=lambda v: v < 1000, formatter=lambda v: v + 0)
    assert ids(e, "owner", prop("amount", "even")) == [2] and ids(e, "owner", prop("amount", "near", 4)) == [1] and ids(e, "owner", prop("amount", "near", 15, 5)) == [2]
    assert e.compile_filter("owner", prop("amount", "near", 1000)).failed
    r.unregister_predicate("even")
    assert e.compile_filter("owner", prop("amount", "even")).diagnostics[0].code == "unknown_predicate"
    r.register_aggregate("rows", fn=lambda c, distinct: F.count(c), result="integer", property=False, empty_value=0)
    assert ids(e, "owner", agg("children", "rows", "eq", 0)) == [3]
    with pytest.raises(TypeError):
        r.register_predicate("bad", fn="no_such_method")
    r.lock()
    with pytest.raises(RuntimeError):
        r.register_predicate("late", fn=lambda c: c)


def test_types_and_coercion():
    t = TypeRegistry()
    assert {"all", "date", "temporal", "numerical", "orderable"} <= t.family("date") and "textual" not in t.family("date")
    t.register("a", "b")
    t.register("b", "a")
    assert t.family("a") == {"all", "a", "b"}
    assert boolean("true") and boolean(1) and not boolean("0") and not boolean(None)
    assert shifted(NOW, -duration("P1M")) == dt.datetime(2024, 2, 29, 12) and duration("P1DT2H").seconds == 93600
    for bad in ("1D", "P", "PT", "P1DT", "x" * 101, 5):
        with pytest.raises(CoercionError):
            duration(bad)
    assert json_within({"a": [1, {"b": 2}], "c": 3}, {"a": [{"b": 2}]}) and not json_within({"a": "1"}, {"a": 1})


def test_ids_and_relations(engine):
    child = engine.models["child"]
    assert canonical_ids(child, ["1", 1, 2.0]) == [(1,), (2,)]
    with pytest.raises(FilterError):
        Relation(child, child.load().select("name")).validate()
    got = engine.compile_filter(Relation(child, child.load().select("name")), group("and"))
    assert got.diagnostics[0].category == "scope_error"
    derived = child.derive("other", encrypted=frozenset({"name"}))
    assert "name" not in [p["name"] for p in Engine([derived]).filter_capabilities("other")["properties"]] and not child.encrypted
    with pytest.raises(ValueError):
        Result("success", child.all(), (None,))


def test_ranges_networks_arrays(spark):
    rows = [(1, (1, 5, True, False), "10.0.0.0/8", ["a", "b"], '{"k": {"n": 1}, "t": ["x", "y"]}'), (2, (5, 9, True, True), "2001:db8::/32", ["b", None], '{"k": 2}'), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, r struct<lower:int,upper:int,lower_inc:boolean,upper_inc:boolean>, n string, t array<string>, j string")
    e = Engine([Model("m", lambda: df, ("id",), types={"n": "inet", "j": "json"})])
    assert ids(e, "m", prop("r", "range_contains", 5)) == [2] and ids(e, "m", prop("r", "range_overlaps", Range(4, 6))) == [1, 2]
    assert ids(e, "m", prop("r", "range_adjacent_to", Range(5, 7))) == [1] and ids(e, "m", prop("r", "range_strictly_left_of", Range(5, None))) == [1]
    assert ids(e, "m", prop("r", "range_contained_by", Range(0, 9))) == [1] and ids(e, "m", prop("r", "range_strictly_right_of", Range(None, 5))) == [2]
    assert ids(e, "m", prop("n", "inet_contains", "10.1.2.3")) == [1] and ids(e, "m", prop("n", "inet_contains", "2001:db8::1")) == [2]
    assert ids(e, "m", prop("n", "inet_contains", "10.0.0.0/8")) == [] and ids(e, "m", prop("n", "inet_overlaps", "10.0.0.0/8")) == [1]
    assert ids(e, "m", prop("n", "inet_contained_within", "0.0.0.0/0")) == [1]
    assert ids(e, "m", prop("t", "array_contains", ["a"])) == [1] and ids(e, "m", prop("t", "array_overlaps", ["z"], negate=True)) == [1, 2]
    assert ids(e, "m", prop("t", "array_contained_by", ["a", "b", "c"])) == [1]
    assert ids(e, "m", prop("j", "contains", {"k": {"n": 1}})) == [1] and ids(e, "m", prop("j", "contains", {"t": ["y"]})) == [1] and ids(e, "m", prop("j", "contains", {"k": "2"})) == []


def test_streaming(spark, engine, tmp_path):
    owners = engine.models["owner"].load()
    owners.write.parquet(str(tmp_path / "in"))
    stream = filter_stream(engine, engine.models["owner"], spark.readStream.schema(owners.schema).parquet(str(tmp_path / "in")), group("and", prop("amount", "gt", 10)))
    query = stream.writeStream.format("memory").queryName("filtered").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["id"] for r in spark.sql("select id from filtered").collect()] == [2]
    with pytest.raises(FilterError):
        filter_stream(engine, engine.models["owner"], stream, group("and", limit=1))


def test_json_contains_in_arrays_and_of_what_is_no_json(spark):
    from quillsift.functions.predicates import json_contained

    assert json_contained('["foo", "bar"]', "foo") and not json_contained('[["foo"]]', "foo") and not json_contained("{", "foo")
    assert json_contained('[1, {"a": 2}]', [{"a": 2}]) and not json_contained('{"a": [1]}', {"a": 1}) and not json_contained("[1]", True)


def test_scoping_is_compiled_once_and_counts_for_depth(spark, engine):
    def tree(levels):
        inner = {"predicate": "and", "filters": [{"type": "property", "property": "id", "predicate": "gt", "args": [0]}]}
        for k in range(levels):
            inner = {"predicate": "and", "filters": [{"type": "association", "association": "children" if (levels - k) % 2 else "owner", "predicate": "has_any", "scoping": inner}]}
        return inner

    made = []
    compile_ = Compiler.compile
    try:
        Compiler.compile = lambda self, node, *a, **k: made.append(node) or compile_(self, node, *a, **k)
        assert ids(engine, "owner", tree(6)) == [1, 2]
        assert len(made) == 2 * 6 + 2
    finally:
        Compiler.compile = compile_
    deepest = engine.registry.settings.max_depth
    assert engine.compile_filter("owner", tree(deepest)).status != "success"


@pytest.mark.parametrize(("predicate", "args", "want"), [("eq", "ONE", [1]), ("eq_any", ["ONE", "two"], [1, 2]), ("not_eq_all", ["ONE"], [2, 3]), ("matches", "E_5", [3]), ("starts_with_any", ["On", "TW"], [1, 2]), ("ends_with", "%", [3])])
def test_value_nodes_of_all_operands(engine, predicate, args, want):
    engine.register(engine.models["owner"].transform("name", "attribute", F.lower).transform("name", "value_node", F.lower))
    assert ids(engine, "owner", {"type": "property", "property": "name", "predicate": predicate, "args": [args]}) == want


def test_value_nodes_of_bounds(engine):
    engine.register(engine.models["owner"].transform("amount", "value_node", lambda c: c + 1))
    assert ids(engine, "owner", {"type": "property", "property": "amount", "predicate": "between", "args": [4, 6]}) == [1]
    assert ids(engine, "owner", {"type": "property", "property": "amount", "predicate": "between", "args": [5, 18]}) == []


def test_child_predicates_and_matching_children(engine):
    member = lambda model, name: Membership(Compiler(engine.registry, engine.models, None, engine._cache, NOW), engine.models[model].all(), engine.models[model].associations[name], engine.models[engine.models[model].associations[name].target])

    def owners(test):
        m = member("owner", "children")
        return sorted(r.id for r in m.owner.filtered(test(m)).collect())

    assert owners(lambda m: m.owner_child_predicate("gteq", 12)) == [2]
    assert owners(lambda m: m.owner_child_predicate("eq", None)) == [3]
    assert owners(lambda m: m.owner_child_predicate("not_eq", None)) == [1, 2]
    assert sorted(r.id for r in member("owner", "children").matching([10, 12, 13]).collect()) == [10, 12]
    assert member("owner", "children").matching([]).count() == 0
    assert [r.label for r in member("kid", "pair").matching([(2, "x")]).collect()] == ["r", "r"]
    with pytest.raises(FilterError):
        member("kid", "pair").owner_child_predicate("eq", 1)
    with pytest.raises(FilterError):
        member("owner", "children").owner_child_predicate("no_such", 1)
