"""The given tables as streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-{user_id}: contiguous from 0 in order of event_id."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("stream").orderBy("event_id")
    return e.select(
        F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream"), "event_id", "user_id", "event_type",
        F.col("ts").cast("timestamp").alias("ts"), "value", F.col("props").alias("data")
    ).withColumn("index", (F.row_number().over(w) - 1).cast("long"))


#: What orders copies of one order line: all other columns.
LINE_ORDER = ("partkey", "suppkey", "quantity", "price", "discount", "tax", "shipdate", "event_type")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-{l_orderkey}: lines with copies and gaps, index from 0."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat(
            F.lit("Order-"), F.col("l_orderkey").cast("string")
        ).alias("stream"), "l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("index"), F.concat("l_returnflag", "l_linestatus").alias("event_type"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("shipdate"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation-{conv_id}: turns, contiguous from 0."""
    x = table(spark, sf_dir, "conversations")
    return x.select(
        F.concat(F.lit("Conversation-"), F.col("conv_id").cast("string")).alias("stream"), F.col("turn").alias("index"),
        F.col("role").alias("event_type"), F.col("text").alias("data"), F.octet_length("text").cast("long").alias("size")
    )
