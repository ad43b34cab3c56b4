"""Kinds of fault: what each needs, and its answer-key record. Faults change a hydraulic model before a run; the engine uses their labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.columns import scenario_name

#: kind -> (asset type of the target, parameters with defaults)
KINDS: dict[str, tuple[str, Mapping[str, float]]] = {
    "leak": ("node", {"max_leak_demand": 0.01}),
    "pump_failure": ("link", {}),
    "blockage": ("link", {}),
}

ANSWERS_DDL = (
    "fault_type string, target_id string, severity double, start_hour double, end_hour double, extra_demand double, full_outage boolean, "
    "affected_nodes array<string>, affected_links array<string>"
)


def create_fault(fault_type: str, target_id: str, severity: float, start_hour: float, end_hour: float | None = None, **params) -> dict:
    """A checked fault: severity in (0, 1], a window that is not empty, an end for a blockage, only known parameters."""
    if fault_type not in KINDS:
        raise ValueError(f"unknown fault type: {fault_type}; known are {', '.join(KINDS)}")
    if not 0 < severity <= 1 or start_hour < 0 or (end_hour is not None and end_hour <= start_hour):
        raise ValueError("severity must be in (0, 1], and the window must begin at 0 or later and end after it begins")
    if fault_type == "blockage" and end_hour is None:
        raise ValueError("a blockage needs an end")
    place, known = KINDS[fault_type]
    if unknown := sorted(set(params) - set(known)):
        raise ValueError(f"unknown parameters of {fault_type}: {', '.join(unknown)}")
    leak = severity * float((known | params)["max_leak_demand"]) if fault_type == "leak" else None
    return {
        "fault_type": fault_type, "target_id": str(target_id), "severity": float(severity), "start_hour": float(start_hour),
        "end_hour": None if end_hour is None else float(end_hour), "extra_demand": leak,
        # a pump of full severity stops for the window, else it runs slower all day; a blockage closes fully at any severity
        "full_outage": severity >= 1 if fault_type == "pump_failure" else fault_type == "blockage",
        "affected_nodes": [str(target_id)] if place == "node" else [], "affected_links": [str(target_id)] if place == "link" else [],
    }


def answer_key(spark: SparkSession, faults: list[dict]) -> DataFrame:
    """The answer key, a row for each fault, with the scenario's name."""
    rows = spark.createDataFrame([tuple(f[c.split()[0]] for c in ANSWERS_DDL.split(", ")) for f in faults], ANSWERS_DDL)
    name = scenario_name(*(F.col(c) for c in ("fault_type", "target_id", "severity", "start_hour", "end_hour")))
    return rows.select(name.alias("scenario"), "*")


def parse_name(scenario: DataFrame, column: str = "scenario") -> DataFrame:
    """Type, target, severity and window back from a scenario's name (nulls where it has another form)."""
    pattern = r"^(leak|pump_failure|blockage)_(.+)_sev(\d+)_t(\d+)_(\d+|end)$"
    part = lambda i: F.nullif(F.regexp_extract(column, pattern, i), F.lit(""))
    return scenario.withColumns({
        "fault_type": part(1), "target_id": part(2), "severity": part(3).try_cast("double") / 100, "start_hour": part(4).try_cast("double"),
        "end_hour": part(5).try_cast("double"),
    })
