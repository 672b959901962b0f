"""The driver's tables as raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import DEVICES, MONETARY, REGIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_number(c: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the raw event schema, with the integer id as ``eid``; the region is that of the user's nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", _by_number(F.col("n_regionkey"), REGIONS).alias("region"))
    kind = (
        F.when(F.col("event_type") == "signup", "add_to_cart")
        .when(F.col("event_type") == "error", F.when(F.col("event_id") % 7 == 0, "refund").otherwise("view"))
        .otherwise(F.col("event_type"))
    )
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("event_type"), "value")
    return (
        e.join(customers, "user_id")
        .join(nations, "n_nationkey")
        .select(
            F.col("event_id").alias("eid"),
            F.col("event_id").cast("string").alias("event_id"),
            "ts",
            F.format_string("u%05d", "user_id").alias("user_id"),
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            "event_type",
            "region",
            _by_number(F.col("event_id") % 3, DEVICES).alias("device"),
            F.when(F.col("event_type").isin(*MONETARY), F.col("value").cast("decimal(12,2)")).alias("amount"),
            F.lit(0).cast("bigint").alias("created_ns"),
        )
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with faults of every kind, by id."""
    hit = lambda n: F.col("eid") % n == 0
    money = "decimal(12,2)"
    return raw_events(spark, sf_dir).withColumns(
        {
            "user_id": F.when(hit(101), F.lit("")).otherwise(F.col("user_id")),
            "event_type": F.when(hit(89), F.lit("hack")).when(hit(83), F.lit(None)).otherwise(F.col("event_type")),
            "region": F.when(hit(97), F.lit("mars")).otherwise(F.col("region")),
            "device": F.when(hit(103), F.lit("fridge")).otherwise(F.col("device")),
            "amount": F.when(hit(107), F.lit(-5).cast(money)).when(hit(109), F.lit(0).cast(money)).when(hit(113), F.lit(None).cast(money)).otherwise(F.col("amount")),
        }
    )


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as purchases and refunds, for volume."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", _by_number(F.col("n_regionkey"), REGIONS).alias("region"))
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.join(orders, "l_orderkey")
        .join(customers, "c_custkey")
        .join(nations, "n_nationkey")
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
            F.col("l_shipdate").alias("ts"),
            F.format_string("u%05d", "c_custkey").alias("user_id"),
            F.col("l_orderkey").cast("string").alias("session_id"),
            F.when(F.col("l_returnflag") == "R", "refund").otherwise("purchase").alias("event_type"),
            "region",
            _by_number(F.col("l_linenumber") % 3, DEVICES).alias("device"),
            F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(12,2)").alias("amount"),
            F.lit(0).cast("bigint").alias("created_ns"),
        )
    )
