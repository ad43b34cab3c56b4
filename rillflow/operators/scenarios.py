"""Fault scenarios: the matrix of target, severity and start, state labels, report-period means, network generation helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import scenario_name, state_at

#: order in which the kinds of fault are generated
FAULT_ORDER = ("leak", "pump_failure", "blockage")


def matrix(spark: SparkSession, blocks: Mapping[str, Mapping], enabled: bool = True) -> DataFrame:
    """One row for each target, severity and start hour of each kind's block {target_ids, severities, start_hours, duration_hours}."""
    schema = "kind int, fault_type string, targets array<string>, severities array<double>, starts array<double>, duration double"
    rows = [
        (i, k, [str(t) for t in b["target_ids"]], [float(x) for x in b["severities"]], [float(x) for x in b["start_hours"]], float(b["duration_hours"]))
        for i, k in enumerate(FAULT_ORDER) if enabled and (b := blocks.get(k))
    ]
    df = spark.createDataFrame(rows, schema)
    df = df.select("kind", "fault_type", "duration", "severities", "starts", F.posexplode("targets").alias("a", "target_id"))
    df = df.select("*", F.posexplode("severities").alias("b", "severity")).select("*", F.posexplode("starts").alias("c", "start_hour"))
    end = F.col("start_hour") + F.col("duration")
    name = scenario_name(F.col("fault_type"), F.col("target_id"), F.col("severity"), F.col("start_hour"), end)
    number = F.row_number().over(Window.orderBy("kind", "a", "b", "c"))  # a configuration's matrix has some hundred rows
    return df.select(number.alias("scenario_id"), name.alias("scenario"), "fault_type", "target_id", "severity", "start_hour", end.alias("end_hour"))


def matrix_from(targets: DataFrame, severities: Sequence[float], starts: Sequence[float], duration: float, kind: str) -> DataFrame:
    """The matrix for targets(target_id) in a table, by exploding two short lists; no cartesian join."""
    rows = targets.select("target_id", F.explode(F.array(*map(F.lit, severities))).alias("severity"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, starts))).alias("start_hour")).withColumn("end_hour", F.col("start_hour") + duration)
    name = scenario_name(F.lit(kind), F.col("target_id"), F.col("severity"), F.col("start_hour"), F.col("end_hour"))
    return rows.select(name.alias("scenario"), F.lit(kind).alias("fault_type"), "target_id", "severity", "start_hour", "end_hour")


def label_states(readings: DataFrame, windows: DataFrame) -> DataFrame:
    """Readings with the state of their time in the fault window(scenario, start_s, end_s) of their scenario."""
    rows = readings.drop("state").join(windows, "scenario")
    return rows.withColumn("state", state_at(F.col("timestamp_s"), F.col("start_s"), F.col("end_s"))).drop("start_s", "end_s")


def check_targets(scenarios: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Scenarios whose target isn't an asset of the kind that their fault needs."""
    known = vertices.where("kind = 'junction'").select(F.lit("leak").alias("fault_type"), F.col("asset_id").alias("target_id")).union(
        edges.where("kind = 'pump'").select(F.lit("pump_failure"), "asset_id")
    ).union(edges.select(F.lit("blockage"), "asset_id"))
    return scenarios.join(known, ["fault_type", "target_id"], "left_anti")


def report_means(readings: DataFrame, period_s: int, floor: float | None = None) -> DataFrame:
    """Means over (t - period, t]; pressures are raised to a floor before they are averaged, and nulls stay null."""
    v = F.col("value")
    if floor is not None:
        v = F.when((F.col("parameter") == "pressure") & (v < floor), F.lit(floor)).otherwise(v)
    at = (F.ceil(F.col("timestamp_s") / period_s) * period_s).cast("long")
    return readings.withColumns({"timestamp_s": at, "value": v}).groupBy("scenario", "timestamp_s", "asset_id", "asset_type", "parameter").agg(
        F.avg("value").alias("value")
    )


def melt(wide: DataFrame, parameter: str, ids: Sequence[str] = ("timestamp_s",)) -> DataFrame:
    """A wide result table (a column for each asset) in long format."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], "asset_id", "value").withColumn("parameter", F.lit(parameter))


def leak_pattern(start_s: int, end_s: int | None, duration_s: int, step_s: int, spark: SparkSession) -> DataFrame:
    """The 0/1 gate of a leak's extra demand by step; without an end it is open to one step past the run."""
    end = duration_s + step_s if end_s is None else end_s
    steps = spark.range(0, duration_s + step_s, step_s).withColumnRenamed("id", "timestamp_s")
    return steps.withColumn("gate", ((F.col("timestamp_s") >= start_s) & (F.col("timestamp_s") < end)).cast("int"))


def normalised(patterns: DataFrame, by: str = "pattern", value: str = "multiplier") -> DataFrame:
    """Demand multipliers divided by their pattern's mean."""
    return patterns.withColumn(value, F.col(value) / F.avg(value).over(Window.partitionBy(by)))


def polyline_length(path: Column) -> Column:
    """Length of a path, an array of [x, y, z]."""
    def step(a: Column, b: Column) -> Column:
        d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))

    n = F.greatest(F.size(path) - 1, F.lit(0))
    legs = F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), step)
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)
