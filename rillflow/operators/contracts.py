"""Data contracts. Each is one aggregate over the rows; the first broken rule, in a fixed order, is raised on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.columns import finite
from rillflow.schemas import ASSET_TYPES, KEY, PARAMETERS, SEVERITIES, STATES


class ContractError(ValueError):
    """Rows that break a contract; ``rule`` names the broken one."""

    def __init__(self, rule: str, message: str):
        super().__init__(message)
        self.rule = rule


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError("columns", f"missing columns: {', '.join(missing)}")


def missing(c: str, df: DataFrame) -> Column:
    col = F.col(c)
    return col.isNull() | F.isnan(col) if dict(df.dtypes)[c] in ("double", "float") else col.isNull()


def violations(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """One row: rows, nulls by column, rows with a repeated key (all of them), rows with an unknown parameter."""
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *(F.count_if(missing(c, df)).alias(f"null_{c}") for c in required),
        F.count_if(~F.col("parameter").isin(*PARAMETERS)).alias("unknown_parameter"),
    )
    repeated = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_key_rows"))
    return counts.crossJoin(repeated)  # one row each


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_readings(df: DataFrame, scenario_key: bool = False) -> DataFrame:
    """Raise for readings that are empty, lack columns or values, repeat a key or name an unknown parameter, in this order."""
    required = [*KEY, "value", "scenario", "state"]
    require_columns(df, required)
    keys = (["scenario"] if scenario_key else []) + KEY
    r = violations(df, keys, required).first()
    if not r.row_count:
        raise ContractError("empty", "the dataset has no rows")
    if nulls := [f"{c}={r[f'null_{c}']}" for c in required if r[f"null_{c}"]]:
        raise ContractError("nulls", f"missing values: {', '.join(nulls)}")
    if r.duplicate_key_rows:
        examples = [tuple(x)[: len(keys)] for x in duplicate_keys(df, keys).limit(5).collect()]
        raise ContractError("duplicates", f"{r.duplicate_key_rows} rows with repeated keys, such as {examples}")
    if r.unknown_parameter:
        raise ContractError("parameters", f"{r.unknown_parameter} rows with unknown parameters; known are {', '.join(PARAMETERS)}")
    return df


def check_baseline(df: DataFrame) -> DataFrame:
    """A baseline has one scenario and one state, both ``normal``."""
    check_readings(df)
    r = df.agg(F.collect_set("scenario").alias("scenario"), F.collect_set("state").alias("state")).first()
    if r.scenario != ["normal"] or r.state != ["normal"]:
        raise ContractError("baseline", f"a baseline is all normal, not {sorted(r.scenario)} and {sorted(r.state)}")
    return df


def check_scenarios(df: DataFrame) -> DataFrame:
    """States are known; a null scenario is not."""
    check_readings(df, scenario_key=True)
    bad = [r.state for r in df.where(~F.col("state").isin(*STATES)).select("state").distinct().limit(5).collect()]
    if bad:
        raise ContractError("states", f"unknown states: {sorted(bad)}")
    return df


def check_residuals(df: DataFrame) -> DataFrame:
    """Expected, observed and residual are numbers and finite; abs_residual is not negative."""
    columns = ["expected_value", "observed_value", "residual", "abs_residual"]
    require_columns(df, columns)
    r = df.agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(~finite(F.col(c).try_cast("double"))).alias(c) for c in columns),
        F.count_if(F.col("abs_residual").try_cast("double") < 0).alias("negative"),
    ).first()
    if not r.n:
        raise ContractError("empty", "no residuals")
    if bad := [f"{c}={r[c]}" for c in columns if r[c]]:
        raise ContractError("finite", f"values that are not finite: {', '.join(bad)}")
    if r.negative:
        raise ContractError("negative", f"{r.negative} negative absolute residuals")
    return df


def check_manifest(df: DataFrame) -> DataFrame:
    """Scenario, type, target and window are present; names are unique."""
    required = ["scenario", "fault_type", "target_id", "severity", "start_hour", "end_hour", "dataset_file"]
    require_columns(df, required)
    r = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scenario").alias("names"), *(F.count_if(F.col(c).isNull()).alias(c) for c in required)
    ).first()
    if not r.n:
        raise ContractError("empty", "the manifest has no rows")
    if nulls := [f"{c}={r[c]}" for c in required if r[c]]:
        raise ContractError("nulls", f"missing values: {', '.join(nulls)}")
    if r.names != r.n:
        raise ContractError("duplicates", "scenario names are not unique")
    return df


def check_snapshot(df: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Types and parameters fit together, ids are known and unique by step; up to ten unknown ids are named."""
    require_columns(df, KEY)
    link = F.col("asset_type") == "link"
    fits = F.when(link, F.col("parameter").isin("flowrate", "velocity", "status")).otherwise(
        F.col("parameter").isin("pressure", "demand", "head")
    )
    r = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("asset_type").isin(*ASSET_TYPES)).alias("types"),
        F.count_if(F.trim("asset_id") == "").alias("ids"), F.count_if(~fits).alias("fit"),
    ).first()
    for rule, bad, what in (("empty", not r.n, "no rows"), ("types", r.types, "unknown asset types"), ("ids", r.ids, "empty ids"),
                            ("assignment", r.fit, "parameters of the other asset type")):
        if bad:
            raise ContractError(rule, what)
    unknown = [x.asset_id for x in unknown_assets(df, vertices, edges).select("asset_id").distinct().orderBy("asset_id").limit(11).collect()]
    if unknown:
        raise ContractError("unknown", f"unknown assets: {', '.join(unknown[:10])}{' ...' if len(unknown) > 10 else ''}")
    if repeated := duplicate_keys(df, KEY).limit(1).collect():
        raise ContractError("duplicates", f"repeated reading: {tuple(repeated[0])}")
    return df


def unknown_assets(readings: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(asset_type, asset_id) of readings whose node or link the network doesn't have."""
    known = vertices.select(F.lit("node").alias("asset_type"), "asset_id").union(edges.select(F.lit("link").alias("asset_type"), "asset_id"))
    return readings.select("asset_type", "asset_id").distinct().join(known, ["asset_type", "asset_id"], "left_anti")


def leaks(packets: DataFrame, text: str, tokens: Sequence[str]) -> DataFrame:
    """Packets whose text names a ground-truth token, in any case."""
    found = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(F.col(text)), F.lower(t)))
    return packets.withColumn("tokens", found).where(F.size("tokens") > 0)


def check_detected(df: DataFrame) -> DataFrame:
    """What events are made of: point rows with known severities (null is none), a time and a scenario."""
    require_columns(df, [*KEY, "scenario", "state", "severity", "is_anomaly", "abs_residual"])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(~F.col("severity").isin(*SEVERITIES), F.col("severity")))).alias("severities"),
               *(F.count_if(F.col(c).isNull()).alias(c) for c in ("timestamp_s", "scenario"))).first()
    if not r.n:
        raise ContractError("empty", "no detected rows")
    if r.severities:
        raise ContractError("severities", f"unknown severities: {', '.join(r.severities)}")
    for c in ("timestamp_s", "scenario"):
        if r[c]:
            raise ContractError("nulls", f"{c} is missing in {r[c]} rows")
    return df


def single_optional(df: DataFrame, column: str):
    """The one value of a column, or None where it has none or isn't there; several are an error."""
    if column not in df.columns:
        return None
    values = sorted(r[0] for r in df.where(~missing(column, df)).select(column).distinct().limit(11).collect())
    if len(values) > 1:
        raise ContractError("single", f"several values of {column}: {', '.join(map(str, values[:10]))}{' ...' if len(values) > 10 else ''}")
    return values[0] if values else None


def asset_types(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """The column trimmed and in lower case; values beyond the known ones are an error."""
    tidy = df.withColumn(column, F.lower(F.trim(column)))
    unknown = tidy.where(F.col(column).isNull() | ~F.col(column).isin(*known)).select(column).distinct().limit(5).collect()
    if unknown:
        raise ContractError("types", f"unknown asset types: {', '.join(sorted(str(r[0]) for r in unknown))}; known are {', '.join(sorted(known))}")
    return tidy
