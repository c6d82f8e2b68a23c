"""A sales relation over the order tables, on which the time-aware operators run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sales(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """sale_id, trade_date, district, kind, price, area, age, floor_ratio,
    has_parking; orders without line items have null attributes. ``only`` has
    the sale_ids that are wanted, if these are few: they are sent to every task."""
    wanted = lambda rows, key: rows if only is None else rows.join(F.broadcast(only), rows[key] == only["sale_id"], "left_semi")
    items = wanted(read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"), F.round(F.avg("l_discount") * 100, 6).alias("age"), F.round(F.avg("l_tax") * 10, 6).alias("floor_ratio"))
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = wanted(orders, "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: a fixed list
    joined = joined.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("sale_id"), F.to_date("o_orderdate").alias("trade_date"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("kind"), F.col("o_totalprice").alias("price"), "area", "age", "floor_ratio", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("has_parking"))


SALES_SQL = """li AS (SELECT l_orderkey, sum(l_quantity) AS area, round(avg(l_discount) * 100, 6) AS age, round(avg(l_tax) * 10, 6) AS floor_ratio FROM lineitem GROUP BY 1),
sales AS (SELECT o_orderkey AS sale_id, CAST(o_orderdate AS DATE) AS trade_date, n_name AS district, c_mktsegment AS kind, o_totalprice AS price, area, age, floor_ratio,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS has_parking
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN li ON l_orderkey = o_orderkey)"""
