"""Sensor pipeline: noisy observations, sigma or MAD scores, and incidents of adjacent time steps with ranked candidates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import by_parameter, gaussian, noise_scale, ratio_or_infinite
from rillflow.functions.lineage import cut

DETECTED = ("pressure", "flowrate")  # a leak is added demand, so demand would give the answer away


def observe(
    readings: DataFrame, spec: Mapping[str, tuple[float, float]], sensors: DataFrame | None = None, seed: int | Column = 42, noise: bool = True
) -> DataFrame:
    """What instruments report: covered assets only, the truth kept beside the noisy value, and the noise's scale.

    The draw depends on seed and key alone: neither row order nor other rows change it.
    """
    rows = readings.withColumn("asset_id", F.col("asset_id").cast("string"))
    if sensors is not None:
        rows = rows.join(sensors.select(F.col("asset_id").cast("string")).distinct(), "asset_id", "left_semi")
    scale = noise_scale(F.col("parameter"), F.col("value"), spec)
    rows = rows.withColumns({"truth": F.col("value").cast("double"), "noise_std": scale})
    draw = gaussian(seed, F.col("parameter"), F.col("asset_type"), F.col("asset_id"), F.col("timestamp_s"))
    return rows.withColumn("value", F.col("truth") + F.col("noise_std") * draw if noise else F.col("truth"))


def residual_scores(
    observed: DataFrame, baseline: DataFrame, by: Sequence[str] = ("timestamp_s", "asset_id", "parameter"), floors: Mapping[str, float] | None = None
) -> DataFrame:
    """observed - expected in units of the noise; residuals under a parameter's floor score zero.

    The baseline's ``truth`` is expected where it has one. Readings without a counterpart are dropped.
    """
    source = "truth" if "truth" in baseline.columns else "value"
    expected = baseline.select(*by, F.col(source).cast("double").alias("expected"))
    rows = observed.where(F.col("parameter").isin(*DETECTED)).join(expected, list(by))
    rows = rows.withColumnRenamed("value", "observed")
    r = F.col("observed") - F.col("expected")
    score = ratio_or_infinite(F.abs(r), F.col("noise_std"))
    if floors:
        score = F.when(F.abs(r) < by_parameter(floors, F.col("parameter"), 0.0), 0.0).otherwise(score)
    return rows.withColumns({"residual": r, "score": score})



def mad_scores(observed: DataFrame, by: Sequence[str] = ("scenario", "parameter", "asset_id")) -> DataFrame:
    """Deviation from the asset's own median in units of 1.4826 MAD, or of the noise where that is larger. One shuffle for both medians."""
    w = Window.partitionBy(*by)
    rows = observed.where(F.col("parameter").isin(*DETECTED)).withColumn("expected", F.median("value").over(w))
    rows = rows.withColumn("residual", F.col("value") - F.col("expected"))
    mad = F.median(F.abs("residual")).over(w)
    scale = F.greatest(1.4826 * mad, F.col("noise_std"))
    return rows.withColumn("score", ratio_or_infinite(F.abs("residual"), scale)).withColumnRenamed("value", "observed")


def flag(scored: DataFrame, threshold: float = 4.0, inclusive: bool = False) -> DataFrame:
    """Readings whose score is over the threshold: strictly, but in interactive views at the threshold too."""
    over = F.col("score") >= threshold if inclusive else F.col("score") > threshold
    return scored.where(over & ~F.isnan("score"))


def positive_steps(flagged: DataFrame, min_assets: int = 2) -> DataFrame:
    """Time steps at which at least min_assets different assets are flagged."""
    n = F.count_distinct(F.struct("asset_type", "asset_id"))
    return flagged.groupBy("scenario", "timestamp_s").agg(n.alias("asset_count")).where(F.col("asset_count") >= min_assets)


def incident_steps(observed: DataFrame, flagged: DataFrame, min_assets: int = 2) -> DataFrame:
    """(scenario, timestamp_s, incident_no): positive steps, in runs that no quiet step of the observed timeline interrupts."""
    timeline = observed.where(F.col("parameter").isin(*DETECTED)).select("scenario", "timestamp_s").distinct()
    w = Window.partitionBy("scenario").orderBy("timestamp_s")
    marked = timeline.withColumn("_at", F.row_number().over(w)).join(positive_steps(flagged, min_assets), ["scenario", "timestamp_s"])
    run = F.col("_at") - F.row_number().over(w)
    return marked.withColumn("_run", run).select("scenario", "timestamp_s", F.dense_rank().over(Window.partitionBy("scenario").orderBy("_run")).alias("incident_no"))


def members(observed: DataFrame, flagged: DataFrame, min_assets: int = 2) -> DataFrame:
    """Flagged readings at the positive steps, with the number of their incident. Both are few beside the readings and are read again and again: they are
    written to the checkpoint folder, so that readings are scanned and scored once."""
    flagged = cut(flagged)
    return cut(flagged.join(incident_steps(observed, flagged, min_assets), ["scenario", "timestamp_s"]))


def candidates(member_rows: DataFrame) -> DataFrame:
    """The channels of each incident: best score (the earliest at ties), first flag, and an order that interleaves the parameters."""
    group = ["scenario", "incident_no", "parameter", "asset_id"]
    best = F.max_by(F.struct("asset_type", "score", "residual", F.col("timestamp_s").alias("peak_at_s")), F.struct("score", -F.col("timestamp_s")))
    rows = member_rows.groupBy(*group).agg(best.alias("b"), F.min("timestamp_s").alias("first_seen_s"))
    rows = rows.select(*group, "b.*", "first_seen_s")
    # equal scores keep the order of first appearance
    tie = ["first_seen_s", "parameter", "asset_id"]
    in_channel = Window.partitionBy("scenario", "incident_no", "parameter").orderBy(F.desc("score"), *tie)
    rows = rows.withColumn("channel_rank", F.row_number().over(in_channel))
    order = Window.partitionBy("scenario", "incident_no").orderBy("channel_rank", F.desc("score"), *tie)
    return rows.withColumn("position", F.row_number().over(order))


def incidents(member_rows: DataFrame) -> DataFrame:
    """One row for each incident, with its epicenter (the first candidate) and candidates nested in order."""
    head = member_rows.groupBy("scenario", "incident_no").agg(
        F.min("timestamp_s").alias("detected_at_s"), F.max("timestamp_s").alias("last_seen_s"), F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("parameter")).alias("parameters"),
    )
    fields = ["position", "asset_id", "asset_type", "parameter", "score", "residual", "peak_at_s", "first_seen_s", "channel_rank"]
    nested = candidates(member_rows).groupBy("scenario", "incident_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    return head.join(nested, ["scenario", "incident_no"]).withColumn("epicenter", F.col("candidates")[0]["asset_id"])


def in_order(flagged: DataFrame) -> DataFrame:
    """Flagged readings by scenario and time, the highest score first."""
    return flagged.orderBy("scenario", "timestamp_s", F.desc("score"), "asset_id", "parameter")


def report(flagged: DataFrame) -> DataFrame:
    """Flagged readings of each scenario, and when the first was."""
    return flagged.groupBy("scenario").agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp_s").alias("first_event_s"))


#: detector name -> scores(observed, baseline)
DETECTORS: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] = {
    "residual": lambda observed, baseline: residual_scores(observed, baseline),
    "statistical": lambda observed, baseline: mad_scores(observed),
}


def detect(observed: DataFrame, baseline: DataFrame | None, detector: str = "residual", threshold: float = 4.0, min_assets: int = 2):
    """(flagged readings, incidents) of all scenarios."""
    scored = DETECTORS[detector](observed, baseline)
    flagged = flag(scored, threshold)
    return flagged, incidents(members(observed, flagged, min_assets))


def as_of(readings: DataFrame, every_s: int) -> DataFrame:
    """Each reading once for every step at which it is already known: rows gain ``as_of_s``.

    The prefix join of a live replay, as an explode over the reading's own later steps (no theta join). The rows grow with the square of the
    steps, as a replay's do, so it is for a day's steps; streams keep state instead.
    """
    last = readings.groupBy("scenario").agg(F.max("timestamp_s").alias("_last"))
    first = F.ceil(F.col("timestamp_s") / every_s).cast("long") * every_s
    end = F.ceil(F.col("_last") / every_s).cast("long") * every_s
    return readings.join(last, "scenario").withColumn("as_of_s", F.explode(F.sequence(first, end, F.lit(every_s).cast("long")))).drop("_last")
