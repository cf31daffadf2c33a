"""The driver's tables read as the data that the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return blocks.pieces(table(spark, d, "documents"), "doc_id", F.col("text"), "\n")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A turn of the user and the assistant's next one: source and target."""
    c = table(spark, d, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    reply = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return user.join(reply, ["conv_id", "turn"])


def curated(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the customers' names: their state follows the balance."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_name").alias("source"), F.when(F.col("c_acctbal") > 0, F.lower("c_mktsegment")).otherwise("").alias("translation"),
        F.when(F.col("c_acctbal") > 5000, "approved").when(F.col("c_acctbal") < 0, "ignored").otherwise("pending").alias("status"),
        F.when(F.col("c_acctbal") > 8000, 0.95).otherwise(0.5).alias("confidence"), (F.col("c_acctbal") > 9000).alias("locked"), F.col("c_custkey").alias("pos"),
    )


def imported(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the orders' customers, their first order first."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("c_name").alias("source"), F.when(F.col("o_totalprice") > 100000, F.lower("o_orderpriority")).otherwise("").alias("translation"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), F.when(F.col("o_totalprice") > 200000, 0.9).otherwise(0.45).alias("confidence"),
        (F.col("o_orderstatus") == "P").alias("locked"), F.col("o_orderkey").alias("pos"),
    )
