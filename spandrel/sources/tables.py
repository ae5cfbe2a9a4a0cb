"""Driver tables, and the graph that the change-impact queries run on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.storage import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and type: customers as functions, suppliers as methods of nations, nations as classes."""
    parts = [("customer", "c", "c_custkey", "CUSTOMER"), ("supplier", "s", "s_suppkey", "SUPPLIER"), ("nation", "n", "n_nationkey", "NATION")]
    return reduce(DataFrame.unionAll, [read(spark, sf_dir, t).select(key(p, c).alias("id"), F.lit(kind).alias("type")) for t, p, c, kind in parts])


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type: a customer calls the suppliers of its orders and extends its nation, which has its suppliers as methods."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    bought = dealt(items.select("l_orderkey", "l_suppkey"), "l_orderkey").join(orders.select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    calls = dealt(bought.select("o_custkey", "l_suppkey"), "o_custkey", "l_suppkey").distinct()
    return reduce(
        DataFrame.unionAll,
        [
            calls.select(key("c", "o_custkey").alias("src"), key("s", "l_suppkey").alias("dst"), F.lit("CALLS").alias("type")),
            read(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("EXTENDS").alias("type")),
            read(spark, sf_dir, "supplier").select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst"), F.lit("HAS_METHOD").alias("type")),
        ],
    )


#: The same as SQL, for oracles.
TRADE_SQL = """
nodes AS (SELECT 'c:' || c_custkey AS id, 'CUSTOMER' AS type FROM customer UNION ALL SELECT 's:' || s_suppkey, 'SUPPLIER' FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'NATION' FROM nation),
edges AS MATERIALIZED (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst, 'CALLS' AS type FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'EXTENDS' FROM customer UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'HAS_METHOD' FROM supplier)
"""
