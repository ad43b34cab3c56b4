"""Views of the test tables as readings, supply trees and multigraphs (definitions in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_S = 21_600
THRESHOLDS = {"pressure": (60.0, 90.0, 130.0), "flowrate": (80.0, 110.0, 150.0)}
NOISE = {"pressure": (20.0, 0.05), "flowrate": (30.0, 0.05)}
FAULT_START_S, FAULT_END_S = 864_000, 1_728_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 2024-01-01 of a time without a zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("2024-01-01")))
    return days.cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def state_of(t: Column) -> Column:
    return F.when(t < FAULT_START_S, "normal").when(t < FAULT_END_S, "fault_active").otherwise("recovery")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour means of the events as readings of three scenarios; ``half`` 0 is the reference run, 1 the observed one."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "event_id", "value")
    kind = F.col("event_type")
    parameter = F.when(kind.isin("click", "view"), "pressure").when(kind.isin("purchase", "error"), "flowrate").otherwise("demand")
    rows = e.select(
        F.concat(F.lit("S"), (F.floor(F.col("user_id") / 10) % 3).cast("string")).alias("scenario"),
        (F.floor(epoch_seconds(F.col("ts")) / STEP_S) * STEP_S).cast("long").alias("timestamp_s"),
        F.concat(F.lit("A"), F.lpad((F.col("user_id") % 10).cast("string"), 2, "0")).alias("asset_id"),
        F.when(kind.isin("purchase", "error"), "link").otherwise("node").alias("asset_type"),
        parameter.alias("parameter"), (F.col("event_id") % 2).cast("int").alias("half"), "value",
    )
    out = rows.groupBy("scenario", "timestamp_s", "asset_id", "asset_type", "parameter", "half").agg(F.avg("value").alias("value"))
    return out.withColumn("state", state_of(F.col("timestamp_s")))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).where("half = 0").drop("half")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).where("half = 1").drop("half")


def supply_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): WORLD, regions, nations, customers, orders."""
    def arcs(name: str, child: str, prefix: str, parent: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(child).cast("string")).alias("child"), parent.alias("parent"))

    def up(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    return (
        arcs("region", "r_regionkey", "R", F.lit("WORLD"))
        .union(arcs("nation", "n_nationkey", "N", up("R", "n_regionkey")))
        .union(arcs("customer", "c_custkey", "C", up("N", "c_nationkey")))
        .union(arcs("orders", "o_orderkey", "O", up("C", "o_custkey")))
    )


def multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-supplier links of all order lines, with the quantity over 25 as a signed flow; parallel links stay."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("start"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("end"),
        (F.col("l_quantity") - 25).alias("flowrate"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("asset_id"),
    )


def first_part(links: DataFrame) -> DataFrame:
    """(node): the part with the least number."""
    return links.agg(F.min(F.substring("start", 2, 20).cast("long")).alias("k")).select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("node"))
