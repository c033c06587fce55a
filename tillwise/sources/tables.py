"""The test tables seen as transactions, interactions, pairs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per purchase: customer_id, material, quantity, calday."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("material"),
        F.col("l_quantity").alias("quantity"),
        F.to_date("o_orderdate").alias("calday"),
    )


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions made dirty by rule: blanks, zeros, negatives and copies."""
    key = F.col("l_orderkey")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    quantity = (
        F.when(key % 11 == 0, F.lit(None).cast("double"))
        .when(key % 7 == 0, F.lit(0.0))
        .when(key % 13 == 0, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
    )
    copies = F.when(key % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        lines.join(orders, key == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            key.alias("doc_number_text"),
            F.to_date("o_orderdate").alias("calday"),
            F.col("l_partkey").alias("material"),
            F.col("p_name").alias("material_text"),
            F.col("p_brand").alias("matl_group"),
            quantity.alias("quantity"),
            (F.col("l_returnflag") == "A").alias("is_accessory"),
            F.col("o_custkey").alias("customer_id"),
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Implicit interactions: the item is the ``k`` of the event's properties."""
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("item"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("factors"),
        F.lit(0.0).alias("bias"), "label",
    )
