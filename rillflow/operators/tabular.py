"""Table pipeline: align a reference run with scenarios, residuals, severity tiers, gap-split events, profiles.

Thresholds are absolute and inclusive, and one asset opens an event; the sensor pipeline in ``detect`` differs on purpose.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import by_parameter, joined, severity, severity_rank
from rillflow.functions.lineage import cut
from rillflow.operators.contracts import ContractError
from rillflow.operators.selection import quantiles
from rillflow.schemas import EVENT_COLUMNS, KEY, SEVERITIES


def align(expected: DataFrame, observed: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Readings of the scenarios beside those of the reference run, by key; keys are unique on both sides.

    An inner equi-join: Spark broadcasts the reference run when its size allows, and else hashes both sides on the key.
    """
    e = expected.select(*by, F.col("value").alias("expected_value"))
    o = observed.select(*by, *(c for c in ("scenario", "state") if c not in by), F.col("value").alias("observed_value"))
    return o.join(e, list(by))


def align_counts(expected: DataFrame, observed: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """One row: matched keys and keys on one side only. One aggregation over both sides; no outer join."""
    both = expected.select(*by, F.lit(1).alias("e"), F.lit(0).alias("o")).union(observed.select(*by, F.lit(0), F.lit(1)))
    keys = both.groupBy(*by).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    return keys.agg(
        F.count_if(F.expr("e = 1 AND o = 1")).alias("matched"), F.count_if(F.expr("o = 0")).alias("baseline_only"), F.count_if(F.expr("e = 0")).alias("scenario_only")
    )


def align_exact(expected: DataFrame, observed: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """``align``, or an error if a key is on one side only."""
    r = align_counts(expected, observed, by).first()
    if r.baseline_only or r.scenario_only:
        raise ContractError("unmatched", f"keys that do not match: {r.baseline_only} in the baseline, {r.scenario_only} in the scenario")
    return align(expected, observed, by)


def residuals(aligned: DataFrame) -> DataFrame:
    r = F.col("observed_value").cast("double") - F.col("expected_value").cast("double")
    return aligned.withColumns({"residual": r, "abs_residual": F.abs(r)})


def classify(rows: DataFrame, thresholds: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Severity of each residual, its thresholds (null where the parameter is not monitored) and whether it is an anomaly."""
    p = F.col("parameter")
    level = severity(p, F.col("abs_residual"), thresholds)
    return rows.withColumns(
        {"is_monitored": p.isin(*thresholds)}
        | {
            f"threshold_{name}": by_parameter({k: float(v[i]) for k, v in thresholds.items()}, p).cast("double")
            for i, name in enumerate(SEVERITIES[1:])
        }
        | {"severity": level, "is_anomaly": p.isin(*thresholds) & (level != SEVERITIES[0])}
    )


def islands(rows: DataFrame, max_gap_s: int, by: Sequence[str] = ("scenario",), ts: str = "timestamp_s") -> DataFrame:
    """(by, ts, event_number): distinct times, numbered anew after each gap of more than max_gap_s seconds.

    The window runs over distinct times only, so its partitions hold a scenario's time steps, not its readings.
    """
    if max_gap_s < 0:
        raise ValueError("max_gap_s must not be negative")
    w = Window.partitionBy(*by).orderBy(ts)
    opens = F.coalesce((F.col(ts) - F.lag(ts).over(w) > max_gap_s).cast("int"), F.lit(1))
    steps = rows.select(*by, ts).distinct().withColumn("_opens", opens)
    number = F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select(*by, ts, number.cast("int").alias("event_number"))


def _numbered(detected: DataFrame, max_gap_s: int) -> DataFrame:
    bad = detected.where("is_anomaly")
    return bad.join(islands(bad, max_gap_s), ["scenario", "timestamp_s"])


def event_id(scenario: Column, number: Column) -> Column:
    return F.concat(scenario, F.format_string("_event_%02d", number))


def events(detected: DataFrame, max_gap_s: int) -> DataFrame:
    """One row for each run of anomalous time steps of a scenario; no anomalies, no rows."""
    peak = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank(F.col("severity"))) + 1)
    out = _numbered(detected, max_gap_s).groupBy("scenario", "event_number").agg(
        F.min("timestamp_s").alias("start_timestamp_s"), F.max("timestamp_s").alias("end_timestamp_s"),
        F.count_distinct("timestamp_s").alias("timestamp_count"), F.count(F.lit(1)).alias("anomaly_record_count"),
        peak.alias("peak_severity"), F.max("abs_residual").alias("peak_abs_residual"), F.avg("abs_residual").alias("mean_abs_residual"),
        F.count_distinct("asset_id").alias("affected_asset_count"), joined(F.col("asset_id")).alias("affected_assets"),
        joined(F.col("asset_type")).alias("affected_asset_types"), joined(F.col("parameter")).alias("affected_parameters"),
        F.count_if(F.expr("parameter = 'pressure'")).alias("pressure_anomaly_count"), F.count_if(F.expr("parameter = 'flowrate'")).alias("flowrate_anomaly_count"),
        joined(F.col("state")).alias("ground_truth_states"),
    )
    out = out.withColumns(
        {"event_id": event_id(F.col("scenario"), F.col("event_number")), "event_span_s": F.col("end_timestamp_s") - F.col("start_timestamp_s")}
    )
    return out.select(*EVENT_COLUMNS)


def evidence(detected: DataFrame, max_gap_s: int) -> DataFrame:
    """The anomalous readings with the number and id of their event."""
    rows = _numbered(detected, max_gap_s)
    return rows.select(event_id(F.col("scenario"), F.col("event_number")).alias("event_id"), "event_number",
                       *(c for c in detected.columns if c not in ("is_monitored",)))


def label_evidence(evidence_rows: DataFrame, labelled_events: DataFrame) -> DataFrame:
    """Evidence with its event's evaluation label. Evidence of an event that has none fails in the plan itself, so the rows are read once."""
    rows = evidence_rows.join(labelled_events.select("event_id", "evaluation_label"), "event_id", "left")
    missing = F.raise_error(F.concat(F.lit("no evaluation label for event "), F.coalesce("event_id", F.lit("(null)"))))
    return rows.withColumn("evaluation_label", F.coalesce("evaluation_label", missing.cast("string")))


def most_frequent(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by..., most_frequent): the commonest value of each group, at ties the least; nulls are no values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("most_frequent"))


def with_answers(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows with their scenario's fault type, target, severity and window; rows of unknown scenarios get nulls."""
    answers = manifest.select("scenario", "fault_type", "target_id", F.col("severity").alias("configured_severity"), F.col("start_hour").alias("fault_start_hour"),
                              F.col("end_hour").alias("fault_end_hour"))
    return rows.join(answers, "scenario", "left")


def profile(expected: DataFrame, observed: DataFrame, manifest: DataFrame, top: int = 10) -> DataFrame:
    """The most affected channels of every scenario of a manifest, with its answer: one job for the whole batch."""
    rows = residuals(align(expected, observed.join(manifest.select("scenario"), "scenario", "left_semi")))
    return with_answers(rank_assets(rows, top=top), manifest)


def residual_profile(rows: DataFrame) -> DataFrame:
    """Exact quantiles and the share of changed readings by scenario, state and parameter; a group of any size is counted in all tasks."""
    by, a = ["scenario", "state", "parameter"], F.col("abs_residual")
    rows = cut(rows.select(*by, "abs_residual"))
    about = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(a > 0).alias("changed_count"), F.avg(a).alias("mean_abs"), F.max(a).alias("max_abs"))
    q = quantiles(rows, by, "abs_residual", (0.5, 0.95, 0.99))
    same = F.lit(True)
    for c in by:
        same = same & about[c].eqNullSafe(q[c])
    return about.join(q, same, "left").select(
        *(about[c] for c in by), "row_count", "changed_count", "mean_abs", F.col("q")[0].alias("median_abs"), F.col("q")[1].alias("p95_abs"),
        F.col("q")[2].alias("p99_abs"), "max_abs", (F.col("changed_count") / F.col("row_count")).alias("changed_fraction"),
    )


def rank_assets(rows: DataFrame, state: str = "fault_active", top: int = 10) -> DataFrame:
    """The channels with the largest residuals of each scenario in a state; ties by asset and parameter, the earliest peak first."""
    a = F.col("abs_residual")
    out = rows.where(F.col("state") == state).groupBy("scenario", "asset_id", "asset_type", "parameter").agg(
        F.avg(a).alias("mean_abs_residual"), F.max(a).alias("max_abs_residual"),
        F.max_by("residual", F.struct(a, -F.col("timestamp_s"))).alias("residual_at_peak"),
        F.min(F.when(a > 0, F.col("timestamp_s"))).alias("first_change_s"),
    )
    order = Window.partitionBy("scenario").orderBy(F.desc("max_abs_residual"), "asset_id", "parameter", "asset_type")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def point_summary(detected: DataFrame) -> DataFrame:
    """Anomaly counts by state, fault-window counts by parameter, first detection and delay of each scenario."""
    bad, active = F.col("is_anomaly"), F.col("state") == "fault_active"
    first = F.min(F.when(bad & active, F.col("timestamp_s")))
    begin = F.min(F.when(active, F.col("timestamp_s")))
    return detected.groupBy("scenario").agg(
        *(F.count_if(bad & (F.col("state") == s)).alias(f"{s}_anomalies") for s in ("normal", "fault_active", "recovery")),
        *(F.count_if(bad & active & (F.col("parameter") == p)).alias(f"{p}_anomalies") for p in ("pressure", "flowrate")),
        (F.count_if(bad & active) > 0).alias("fault_detected"), first.alias("first_detection_s"), (first - begin).alias("detection_delay_s"),
    )
