"""Bills out of order tables: an order is a claim, its lines are the bill's, parts say what for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.adjudicate import Policy, Rule, SubLimit

#: What stands for rules and limits in these tables.
RULES = [
    Rule("R_PLATE", "clause 1", "plates are not covered", ("plate",), "consumables"),
    Rule("R_RED", "clause 2", "red plates are not covered", ("red plate",), "non_medical"),
    Rule("R_GIZMO", "clause 3", "gizmos are not covered", ("gizmo",)),
    Rule("R_HOT", "clause 4", "hot gizmos are not covered", ("hot gizmo",)),
]
POLICY = Policy(
    sum_insured="150000", room_percent="1.0", icu_percent="2.0", proportionate=("room_rent", "nursing", "surgery"),
    sub_limits=(SubLimit("anvil", "40000", "limit A"), SubLimit("large", "80000", "limit B")),
)
CATEGORY_OF = {"STANDARD": "room_rent", "ECONOMY": "pharmacy", "MEDIUM": "nursing", "PROMO": "non_medical", "SMALL": "consumables"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category(part_type: Column) -> Column:
    out = F.lit("surgery")
    for kind, name in CATEGORY_OF.items():
        out = F.when(part_type == kind, name).otherwise(out)
    return out


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_index, page_index, description, category, quantity, unit_rate, amount, part and supplier keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"), (F.row_number().over(order) - 1).alias("line_index"), F.col("l_linenumber").alias("page_index"),
        F.col("p_name").alias("description"), category(F.col("p_type")).alias("category"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"), F.lit(None).cast("decimal(18,2)").alias("unit_rate"),
        F.round(F.col("l_extendedprice"), 2).cast("decimal(18,2)").alias("amount"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").cast("date").alias("service_date"), F.round(F.col("l_discount"), 2).cast("decimal(18,2)").alias("discount"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "icu").otherwise("general").alias("ward_type"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("stated_net"))


#: The same rows in SQL, for oracles.
ITEMS_SQL = """
items AS (
  SELECT l_orderkey AS doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS line_index,
    l_linenumber AS page_index, p_name AS description,
    CASE p_type WHEN 'STANDARD' THEN 'room_rent' WHEN 'ECONOMY' THEN 'pharmacy' WHEN 'MEDIUM' THEN 'nursing'
      WHEN 'PROMO' THEN 'non_medical' WHEN 'SMALL' THEN 'consumables' ELSE 'surgery' END AS category,
    l_quantity::BIGINT AS qty, round(l_extendedprice * 100)::BIGINT AS amt, l_partkey AS part, l_suppkey AS supplier,
    l_shipdate::DATE AS service_date, round(l_discount * 100)::BIGINT AS discount
  FROM lineitem JOIN part ON p_partkey = l_partkey),
claims AS (
  SELECT o_orderkey AS doc_id, o_orderpriority = '1-URGENT' AS icu, round(o_totalprice * 100)::BIGINT AS stated FROM orders)"""
