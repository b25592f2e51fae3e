"""The catalog over a folder of the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.ordered import following
from weftgraph.sources.catalog import GraphCatalog


#: Rows of a task that tells distinct rows apart. Adaptive execution sizes tasks by compressed bytes, of which a pair of keys
#: has so few that a task's hash table would take twenty times as many.
ROWS_OF_TASK = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct (a, b) of a table, in as many tasks as its rows ask for."""
    return rows.select(a, b).repartition(max(1, -(-rows.count() // ROWS_OF_TASK)), a, b).distinct()


def star_graph(spark: SparkSession, folder: str) -> GraphCatalog:
    """Region, Nation, Customer, Supplier, Part, Order, Event, Document, Vector and their relationships."""
    t = lambda name: lambda: table(spark, folder, name)
    g = GraphCatalog()
    for label, name, key in (
        ("Region", "region", "r_regionkey"),
        ("Nation", "nation", "n_nationkey"),
        ("Customer", "customer", "c_custkey"),
        ("Supplier", "supplier", "s_suppkey"),
        ("Part", "part", "p_partkey"),
        ("Order", "orders", "o_orderkey"),
        ("Event", "events", "event_id"),
        ("Document", "documents", "doc_id"),
        ("Vector", "embeddings", "vec_id"),
    ):
        g.add_nodes(label, t(name), key, labels=("Party",) if label in ("Customer", "Supplier") else ())
    g.add_nodes("User", lambda: t("events")().select("user_id").distinct(), "user_id")
    g.add_foreign_key("IN_REGION", "Nation", "Region", "n_regionkey", on="source")
    g.add_foreign_key("CUSTOMER_OF", "Customer", "Nation", "c_nationkey", on="source")
    g.add_foreign_key("SUPPLIER_OF", "Supplier", "Nation", "s_nationkey", on="source")
    g.add_foreign_key("PLACED", "Customer", "Order", "o_custkey", on="target")
    g.add_foreign_key("DID", "User", "Event", "user_id", on="target")
    g.add_edges("CONTAINS", t("lineitem"), "Order", "Part", "l_orderkey", "l_partkey", by_place=True)
    g.add_edges("SUPPLIED_BY", t("lineitem"), "Order", "Supplier", "l_orderkey", "l_suppkey", by_place=True)
    g.add_edges("SUPPLIES", lambda: distinct_pairs(t("lineitem")(), "l_suppkey", "l_partkey"), "Supplier", "Part", "l_suppkey", "l_partkey", key=("l_suppkey", "l_partkey"))

    def next_events() -> DataFrame:
        return following(t("events")().select("user_id", "ts", "event_id"), "user_id", ["ts"], "event_id").toDF("event_id", "next_id")

    g.add_edges("NEXT", next_events, "Event", "Event", "event_id", "next_id", key=("event_id",))
    return g
