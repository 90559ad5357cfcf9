"""Models over the driver's tables, with derived columns for the types that those lack."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources.model import Association, Bridge, Model, Scope, nulls_as_stored


def driver_models(spark: SparkSession, sf_dir: str) -> dict[str, Model]:
    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def load(name: str) -> Callable[[], DataFrame]:
        return lambda: read(name)

    @cache
    def parts() -> DataFrame:
        return load("part")().withColumn("tags", F.split("p_type", " ")).withColumn("sizes", F.array(F.col("p_size"), F.col("p_size") + 1))

    @cache
    def orders() -> DataFrame:
        day = F.to_date("o_orderdate")
        df = load("orders")().withColumn("o_day", day)
        df = df.withColumn("period", F.struct(day.alias("lower"), F.date_add(day, 30).alias("upper"), F.lit(True).alias("lower_inc"), F.lit(False).alias("upper_inc")))
        return df.withColumn("clerk_note", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("rate_"), (F.col("o_orderkey") % 100).cast("string"), F.lit("%"))))

    @cache
    def labels() -> DataFrame:
        return load("labels")().withColumn("is_toxic", F.col("toxic") == 1).withColumn("is_good", F.when(F.col("doc_id") % 7 != 0, F.col("quality") == 1))

    @cache
    def events() -> DataFrame:
        host = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 4).cast("string"), (F.col("event_id") % 8).cast("string"), F.lit("0"))
        return load("events")().withColumn("net", F.concat(host, F.lit("/"), (F.lit(16) + 8 * (F.col("event_id") % 2)).cast("string")))

    by_date = (lambda: nulls_as_stored(F.col("o_orderdate"), "desc"), lambda: F.col("o_orderkey"))
    by_price = (lambda: nulls_as_stored(F.col("o_totalprice"), "desc"),)
    sold = lambda: load("lineitem")().select("l_partkey", "l_suppkey")
    found = [
        Model("region", load("region"), ("r_regionkey",), {"nations": Association("nations", "has_many", "nation", child_cols=("n_regionkey",))}),
        Model("nation", load("nation"), ("n_nationkey",), {
            "region": Association("region", "belongs_to", "region", ("n_regionkey",)),
            "customers": Association("customers", "has_many", "customer", child_cols=("c_nationkey",)),
            "suppliers": Association("suppliers", "has_many", "supplier", child_cols=("s_nationkey",)),
            "siblings": Association("siblings", "has_many", "nation", ("n_regionkey",), ("n_regionkey",)),
        }),
        Model("customer", load("customer"), ("c_custkey",), {
            "nation": Association("nation", "belongs_to", "nation", ("c_nationkey",)),
            "region": Association("region", "has_one", "region", through=("nation", "region")),
            "orders": Association("orders", "has_many", "orders", child_cols=("o_custkey",)),
            "latest_order": Association("latest_order", "has_one", "orders", child_cols=("o_custkey",), scope=Scope(order=by_date)),
            "top3_orders": Association("top3_orders", "has_many", "orders", child_cols=("o_custkey",), scope=Scope(order=by_price, limit=3)),
            "later_orders": Association("later_orders", "has_many", "orders", child_cols=("o_custkey",), scope=Scope(order=by_price, offset=10)),
            "urgent_orders": Association("urgent_orders", "has_many", "orders", child_cols=("o_custkey",), scope=Scope(where=lambda df, ctx: df.where("o_orderpriority = '1-URGENT'"))),
        }, custom_properties={"rich_builder": {"type": "group", "predicate": "and", "filters": [
            {"type": "property", "property": "c_mktsegment", "predicate": "eq", "args": ["BUILDING"]}, {"type": "property", "property": "c_acctbal", "predicate": "gt", "args": [5000]}]}}),
        Model("supplier", load("supplier"), ("s_suppkey",), {"parts": Association("parts", "has_and_belongs_to_many", "part", bridge=Bridge(sold, ("l_suppkey",), ("l_partkey",)))}),
        Model("part", parts, ("p_partkey",), {
            "suppliers": Association("suppliers", "has_and_belongs_to_many", "supplier", bridge=Bridge(sold, ("l_partkey",), ("l_suppkey",))),
            "first_suppliers": Association("first_suppliers", "has_and_belongs_to_many", "supplier", bridge=Bridge(sold, ("l_partkey",), ("l_suppkey",)), scope=Scope(order=(lambda: F.col("s_acctbal").desc(),), limit=2, distinct=True)),
        }),
        Model("orders", orders, ("o_orderkey",), {
            "customer": Association("customer", "belongs_to", "customer", ("o_custkey",)),
            "lineitems": Association("lineitems", "has_many", "lineitem", child_cols=("l_orderkey",)),
        }),
        Model("lineitem", load("lineitem"), ("l_orderkey", "l_linenumber"), {"order": Association("order", "belongs_to", "orders", ("l_orderkey",))}),
        Model("document", load("documents"), ("doc_id",), {"label": Association("label", "has_one", "label", child_cols=("doc_id",))}),
        Model("label", labels, ("doc_id",), {}),
        Model("conversation", load("conversations"), ("conv_id", "turn"), {"turns": Association("turns", "has_many", "conversation", ("conv_id",), ("conv_id",))}),
        Model("event", events, ("event_id",), {
            "subject": Association("subject", "belongs_to", owner_cols=("user_id",), type_col="event_type", targets=(("click", "customer"), ("purchase", "part"))),
        }, types={"props": "json", "net": "inet"}),
        Model("embedding", load("embeddings"), ("vec_id",)),
    ]
    return {m.name: m for m in found}
