"""CSV and Parquet sources and sinks. Schemas are always given: an inferred one would turn the asset id ``101`` into a number."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import contracts
from rillflow.schemas import MANIFEST_DDL, READINGS_DDL

READING_COLUMNS = [f.split()[0] for f in READINGS_DDL.split(", ")]


def csv_path(path: str) -> str:
    """A path to CSV data: ``.csv`` in any case, or a directory or glob of them; backslashes are slashes."""
    path = path.replace("\\", "/")
    suffix = PurePosixPath(path).suffix
    if suffix and suffix.lower() != ".csv":
        raise contracts.ContractError("path", f"not a CSV file: {path}")
    return path


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV files read by header names, whatever the order of their columns; NaN values are nulls."""
    paths = [csv_path(p) for p in ([paths] if isinstance(paths, str) else paths)]
    names = spark.read.option("header", True).csv(paths).columns
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema.fields}
    if lacking := sorted(set(required) - set(names)):
        raise contracts.ContractError("columns", f"missing columns: {', '.join(lacking)}")
    rows = spark.read.option("header", True).schema(", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)).csv(paths)
    doubles = {n: F.when(~F.isnan(n), F.col(n)) for n in names if types.get(n) == "double"}
    return rows.withColumns(doubles) if doubles else rows


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return contracts.check_baseline(read_csv(spark, path, READINGS_DDL, READING_COLUMNS))


def read_scenarios(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Readings of any number of scenarios as one DataFrame."""
    return contracts.check_scenarios(read_csv(spark, paths, READINGS_DDL, READING_COLUMNS))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, MANIFEST_DDL)
    return contracts.check_manifest(rows.withColumn("dataset_file", F.translate("dataset_file", "\\", "/")))


def dataset_candidates(entry: str, directory: str) -> list[str]:
    """Where a manifest's dataset may be, in order: as given, under the directory, or there by its name alone."""
    entry = entry.replace("\\", "/")
    if entry.startswith("/") or "://" in entry:
        return [entry]
    return [entry, f"{directory}/{entry}", f"{directory}/{PurePosixPath(entry).name}"]


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file systems, so that paths in any store work."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, manifest: DataFrame, directory: str) -> list[str]:
    """The datasets of a manifest (one row for each scenario) that a single read then takes."""
    found = []
    for r in manifest.select("scenario", "dataset_file").collect():
        path = next((p for p in dataset_candidates(r.dataset_file, directory) if exists(spark, p)), None)
        if path is None:
            raise FileNotFoundError(f"no dataset of scenario {r.scenario}: {r.dataset_file}")
        found.append(path)
    return found


INCIDENTS_DDL = (
    "scenario string, incident_no long, detected_at_s long, last_seen_s long, event_count long, parameters array<string>, epicenter string, "
    "candidates array<struct<position:long,asset_id:string,asset_type:string,parameter:string,score:double,residual:double,peak_at_s:long,first_seen_s:long,channel_rank:long>>"
)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents as ``detect`` wrote them as JSON lines."""
    return spark.read.schema(INCIDENTS_DDL).json(path)


def write_scenarios(readings: DataFrame, path: str) -> None:
    """Parquet, one directory for each scenario; tasks write their own files, so a large scenario is many of them."""
    readings.write.mode("overwrite").partitionBy("scenario").parquet(path)


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """A small result as one CSV file with a header, sorted."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, by: str) -> None:
    """Rows as JSON lines (nulls left out), in a directory for each value of ``by``."""
    rows.select(by, F.to_json(F.struct(*(c for c in rows.columns if c != by))).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def series_payload(readings: DataFrame, digits: int = 4) -> DataFrame:
    """(scenario, payload): parameter -> asset -> values in time order, as JSON for a viewer."""
    points = F.array_sort(F.collect_list(F.struct("timestamp_s", F.round("value", digits).alias("v"))))
    series = readings.groupBy("scenario", "parameter", "asset_id").agg(F.transform(points, lambda p: p["v"]).alias("values"))
    assets = series.groupBy("scenario", "parameter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_id", "values")))).alias("assets"))
    out = assets.groupBy("scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", F.to_json("assets").alias("j"))))).alias("m"))
    return out.select("scenario", F.to_json("m").alias("payload"))
