"""Row types of the engine. Readings are long-format: one row per scenario, time step, asset and parameter."""

from __future__ import annotations

KEY = ["timestamp_s", "asset_id", "asset_type", "parameter"]
#: asset ids are strings even where they look like numbers, so the type is never inferred
READINGS_DDL = "timestamp_s long, asset_id string, asset_type string, parameter string, value double, scenario string, state string"
MANIFEST_DDL = (
    "scenario_id long, scenario string, fault_type string, target_id string, severity double, start_hour double, "
    "end_hour double, dataset_file string, metadata_file string, rows long"
)
EVENT_COLUMNS = [
    "event_id", "scenario", "event_number", "start_timestamp_s", "end_timestamp_s", "event_span_s", "timestamp_count",
    "anomaly_record_count", "peak_severity", "peak_abs_residual", "mean_abs_residual", "affected_asset_count", "affected_assets",
    "affected_asset_types", "affected_parameters", "pressure_anomaly_count", "flowrate_anomaly_count", "ground_truth_states",
]
PARAMETERS = ("pressure", "demand", "flowrate")
ASSET_TYPES = ("node", "link")
STATES = ("normal", "fault_active", "recovery")
SEVERITIES = ("normal", "anomaly", "warning", "critical")
#: parameter -> thresholds of (anomaly, warning, critical); m and m3/s
THRESHOLDS = {"pressure": (0.5, 1.5, 5.0), "flowrate": (0.005, 0.020, 0.100)}
