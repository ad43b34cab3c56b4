"""Experiment configurations (YAML) and ``.env`` files. They are read on the driver: configuration isn't data."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rillflow.operators import scenarios


@dataclass(frozen=True)
class Fault:
    type: str
    target_id: str
    severity: float
    start_hour: float
    end_hour: float | None = None
    params: Mapping = field(default_factory=dict)

    def __post_init__(self):
        if not 0 < self.severity <= 1:
            raise ValueError(f"severity must be over 0 and at most 1, not {self.severity}")
        if self.start_hour < 0:
            raise ValueError("start_hour must not be negative")
        if self.end_hour is not None and self.end_hour <= self.start_hour:
            raise ValueError("end_hour must be after start_hour")


@dataclass(frozen=True)
class Experiment:
    network_file: str
    duration_hours: float = 24.0
    hydraulic_step_s: int = 3600
    report_step_s: int = 3600
    report_average: bool = False
    pressure_floor_m: float | None = None
    faults: tuple[Fault, ...] = ()
    generation: Mapping = field(default_factory=dict)

    def scenario_matrix(self, spark: SparkSession) -> DataFrame:
        blocks = {k: v for k, v in self.generation.items() if isinstance(v, Mapping)}
        return scenarios.matrix(spark, blocks, bool(self.generation.get("enabled", False)))


def experiment(raw: Mapping) -> Experiment:
    """The configuration of parsed YAML."""
    if not raw.get("network_file"):
        raise ValueError("network_file is missing")
    run = raw.get("simulation") or {}
    faults = tuple(
        Fault(str(f["type"]), str(f["target_id"]), float(f["severity"]), float(f["start_hour"]), f.get("end_hour"), f.get("params") or {})
        for f in raw.get("faults") or ()
    )
    generation = raw.get("scenario_generation") or {}
    for name, block in generation.items():
        if isinstance(block, Mapping):
            for s in block.get("severities", ()):
                Fault(name, "any", float(s), 0.0)
    floor = run.get("pressure_floor_m")
    return Experiment(
        str(raw["network_file"]).replace("\\", "/"), float(run.get("duration_hours", 24)), int(run.get("hydraulic_timestep_seconds", 3600)),
        int(run.get("report_timestep_seconds", 3600)), bool(run.get("report_average", False)), None if floor is None else float(floor), faults, generation,
    )


def load_experiment(path: str) -> Experiment:
    import yaml

    with open(path, encoding="utf-8") as f:
        return experiment(yaml.safe_load(f) or {})


def load_env(text: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; what is set already stays."""
    env = os.environ if env is None else env
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and key and not key.startswith("#"):
            env.setdefault(key.strip(), value.strip().strip("'\""))
    return env
