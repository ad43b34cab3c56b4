"""Detection, retrieval and diagnosis in one: whole days with hindsight, or as known at each hour. All scenarios are one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.lineage import cut
from rillflow.operators import detect, diagnosis, retrieval
from rillflow.operators.retrieval import Building, Retrieval

#: Absolute and relative noise of a building's instruments (m, m3/s); demand isn't metered.
BUILDING_NOISE = {"pressure": (0.25, 0.0), "flowrate": (2e-6, 0.02)}
SEP = "\x1f"


def building_observed(readings: DataFrame, building: Building, seed: int = 0, noise: bool = True, spec: Mapping[str, tuple[float, float]] = BUILDING_NOISE) -> DataFrame:
    """What the building's instruments report: its metered assets, and the parameters that ``spec`` knows."""
    return detect.observe(readings.where(F.col("parameter").isin(*spec)), spec, building.sensors, seed, noise)


def sensor_readings(readings: DataFrame, building: Building) -> DataFrame:
    """Readings with the id of the sensor that takes them, by asset and parameter; those that no sensor takes are dropped."""
    return readings.join(building.sensors.select("asset_id", "parameter", "sensor_id"), ["asset_id", "parameter"])


@dataclass(frozen=True)
class Evidence:
    """What was found of all incidents, each a relation keyed by ``incident``."""

    heads: DataFrame
    rows: DataFrame
    span: DataFrame
    bounds: DataFrame
    chains: DataFrame
    series: DataFrame
    packets: DataFrame


def evidence(steps: DataFrame, flagged: DataFrame, building: Building, config: Retrieval = Retrieval(), min_assets: int = 2) -> Evidence:
    """Incidents of flagged readings and their packets; steps(scenario, timestamp_s, parameter) is the observed timeline.

    Alarms are the incident's candidates and flags shortly before it. In its packet an incident is ``INC-n``, so that no scenario's name leaks.
    """
    return evidence_of(detect.members(steps, flagged, min_assets), flagged, building, config)


def evidence_of(found: DataFrame, flagged: DataFrame, building: Building, config: Retrieval = Retrieval()) -> Evidence:
    """The same of found members (flagged readings with ``incident_no``), and all flagged readings that may bear on them."""
    key = F.concat_ws("-", "scenario", "incident_no")
    heads = found.groupBy("scenario", "incident_no").agg(F.min("timestamp_s").alias("detected_at_s"), F.max("timestamp_s").alias("last_seen_s"))
    heads = cut(heads.select(key.alias("incident"), "scenario", "incident_no", F.format_string("INC-%d", "incident_no").alias("label"), "detected_at_s", "last_seen_s"))
    named = cut(retrieval.alarms(detect.candidates(found).withColumn("incident", key), building, config))
    alarms = named.unionByName(retrieval.early_alarms(named, heads, flagged, building, config))
    rows = retrieval.classified(alarms, flagged, heads, building, config)
    span, bounds = retrieval.suspect_spans(rows, building)
    chains = retrieval.low_tank_chains(rows, building)
    series = cut(retrieval.timelines(rows, flagged, heads, config))
    near = retrieval.context(rows, span, bounds, chains, building, config)
    told = retrieval.facts(rows, span, bounds, chains, building)
    packets = cut(retrieval.packets(rows, near, series, heads, building, config, told))
    return Evidence(heads, rows, span, bounds, chains, series, packets)


def diagnosed(found: Evidence, building: Building | None = None) -> DataFrame:
    """One row for each incident, from its packet alone (no building is needed): scenario, number, hours of its first and last alarm, packet, diagnosis (JSON; null if no rule applies) and whether it is grounded."""
    chosen = diagnosis.diagnose(diagnosis.from_packets(found.packets))
    checked = diagnosis.grounding(chosen, found.packets)
    text = F.to_json(F.struct(*(c for c in chosen.columns if c != "incident")))
    checked = checked.select("incident", text.alias("diagnosis"), "grounded")
    hours = [F.floor(F.col(c) / 3600).cast("long").alias(n) for c, n in (("detected_at_s", "first_alarm_hour"), ("last_seen_s", "last_alarm_hour"))]
    out = found.heads.join(found.packets, "incident").join(checked, "incident", "left")
    return out.select("incident", "scenario", "incident_no", *hours, "packet", "diagnosis", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def _marked(observed: DataFrame, baseline: DataFrame, by: tuple[str, ...], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(timeline, flagged readings): every reading is scored once, and what is over the threshold is kept."""
    steps = observed.where(F.col("parameter").isin(*detect.DETECTED)).select("scenario", "timestamp_s", "parameter").distinct()
    return steps, cut(detect.flag(detect.residual_scores(observed, baseline, by), threshold))


def run(observed: DataFrame, baseline: DataFrame, building: Building, threshold: float = 4.0, min_assets: int = 2, config: Retrieval = Retrieval(),
        by: tuple[str, ...] = ("timestamp_s", "asset_id", "parameter")) -> DataFrame:
    """Every incident of noisy observations, diagnosed with all their readings; no incident gives no row."""
    steps, flagged = _marked(observed, baseline, by, threshold)
    return diagnosed(evidence(steps, flagged, building, config, min_assets))


def run_live(observed: DataFrame, baseline: DataFrame, building: Building, every_s: int = 3600, threshold: float = 4.0, min_assets: int = 2, config: Retrieval = Retrieval(),
             by: tuple[str, ...] = ("timestamp_s", "asset_id", "parameter")) -> DataFrame:
    """The rows of ``run`` as known at each step, from the readings until then: they gain ``as_of_s``; steps without an incident have no row.

    A reading's score does not depend on later ones, so readings are scored once, and only flags and time steps are repeated for the steps at which they are known. Noise
    is that of the observations, so a past reading never changes.
    """
    steps, flagged = _marked(observed, baseline, by, threshold)
    known = cut(detect.as_of(steps, every_s))
    name = F.concat_ws(SEP, "scenario", F.col("as_of_s").cast("string"))
    at = known.select("scenario", "timestamp_s", "as_of_s").distinct()
    again = flagged.join(at, ["scenario", "timestamp_s"]).withColumn("scenario", name).drop("as_of_s")
    out = diagnosed(evidence(known.withColumn("scenario", name), again, building, config, min_assets))
    part = F.split("scenario", SEP)
    return out.withColumns({"as_of_s": part[1].cast("long"), "scenario": part[0], "incident": F.concat_ws("-", part[0], "incident_no")})


def retrieval_scores(found: Evidence, truth: DataFrame, building: Building) -> DataFrame:
    """(incident, target_in_packet, target_at_focus, focus, assets, tokens) against truth(incident, target_id)."""
    points = retrieval.focus(found.rows, found.span, found.chains, building).groupBy("incident").agg(F.array_sort(F.collect_set("asset_id")).alias("_f"))
    rows = truth.select("incident", "target_id").join(found.packets, "incident").join(points, "incident", "left")
    focus = F.coalesce("_f", F.array().cast("array<string>"))
    ids = F.filter("allowed_ids", lambda x: ~F.startswith(x, F.lit("sensor:")))
    return rows.select("incident", F.array_contains(ids, F.col("target_id")).alias("target_in_packet"), F.array_contains(focus, F.col("target_id")).alias("target_at_focus"),
                       F.array_join(focus, " ").alias("focus"), F.size(ids).alias("assets"), "tokens")
