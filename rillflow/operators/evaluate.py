"""Scores against the answer key: event summaries, time steps, localisation, intervals, seed studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import phase
from rillflow.operators.graph import ranked_first
from rillflow.operators.selection import quantiles


def label_events(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Events with their phase and their scenario's answer (fault type, target, configured severity and window)."""
    m = manifest.select("scenario", "fault_type", "target_id", F.col("severity").alias("configured_severity"),
                        F.col("start_hour").alias("fault_start_hour"), F.col("end_hour").alias("fault_end_hour"))
    return events.withColumn("evaluation_label", phase(F.col("ground_truth_states"))).join(m, "scenario", "left")


def scenario_summary(labelled: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row for each scenario of the manifest: its primary and recovery events. One conditional aggregate, one join."""
    primary, recovery = F.col("evaluation_label") == "primary", F.col("evaluation_label") == "recovery_transient"

    def own(cond, c: str):
        return F.when(cond, F.col(c))

    sums = labelled.groupBy("scenario").agg(
        F.count_if(primary).alias("primary_event_count"), F.min(own(primary, "start_timestamp_s")).alias("first_detection_timestamp_s"),
        F.sum(own(primary, "event_span_s")).alias("primary_event_span_s"), F.sum(own(primary, "anomaly_record_count")).alias("primary_anomaly_record_count"),
        F.max(own(primary, "affected_asset_count")).alias("primary_affected_asset_count"), F.max(own(primary, "peak_abs_residual")).alias("primary_peak_abs_residual"),
        F.count_if(recovery).alias("recovery_event_count"), F.sum(own(recovery, "anomaly_record_count")).alias("recovery_anomaly_record_count"),
    )
    counts = ["primary_event_count", "primary_event_span_s", "primary_anomaly_record_count", "primary_affected_asset_count", "recovery_event_count",
              "recovery_anomaly_record_count"]
    m = manifest.select("scenario", "fault_type", "target_id", F.col("severity").alias("configured_severity"),
                        F.col("start_hour").alias("fault_start_hour"), F.col("end_hour").alias("fault_end_hour"))
    out = m.join(sums, "scenario", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    delay = F.col("first_detection_timestamp_s") - (F.col("fault_start_hour") * 3600).cast("long")
    return out.withColumns({"detection_delay_s": delay, "detected": F.col("primary_event_count") > 0}).withColumns(
        {"detection_delay_h": F.col("detection_delay_s") / 3600, "primary_event_span_h": F.col("primary_event_span_s") / 3600}
    )


def fault_type_summary(summary: DataFrame) -> DataFrame:
    """Means, medians and extremes of the scenarios of each fault type."""
    return summary.groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("scenario_count"), F.count_if("detected").alias("detected_scenario_count"),
        F.sum("primary_event_count").alias("primary_event_count"), F.sum("recovery_event_count").alias("recovery_event_count"),
        *(f(F.col(f"detection_delay_{u}")).alias(f"{n}_detection_delay_{u}") for u in "sh" for n, f in (("mean", F.avg), ("median", F.median), ("maximum", F.max))),
        *(f(F.col(f"primary_event_span_{u}")).alias(f"{n}_primary_event_span_{u}") for u in "sh" for n, f in (("mean", F.avg), ("median", F.median))),
        F.avg("primary_anomaly_record_count").alias("mean_primary_anomaly_records"), F.avg("primary_affected_asset_count").alias("mean_affected_asset_count"),
        F.avg("primary_peak_abs_residual").alias("mean_peak_abs_residual"),
    ).withColumn("detection_rate", F.col("detected_scenario_count") / F.col("scenario_count")).withColumn("detection_rate_percent", F.col("detection_rate") * 100)


def fired_steps(timeline: DataFrame, incidents: DataFrame) -> DataFrame:
    """Timeline steps(scenario, timestamp_s) with whether any incident [detected_at_s, last_seen_s] holds them.

    Incidents of a scenario don't overlap and are few, so the interval test rides on an equi-join by scenario of the steps with the last incident begun.
    """
    begun = incidents.select("scenario", F.col("detected_at_s").alias("timestamp_s"), F.col("last_seen_s").alias("_until"))
    marks = timeline.select("scenario", "timestamp_s", F.lit(None).cast("long").alias("_until"), F.lit(True).alias("_step")).union(
        begun.select("scenario", "timestamp_s", "_until", F.lit(False))
    )
    w = Window.partitionBy("scenario").orderBy("timestamp_s", "_step").rowsBetween(Window.unboundedPreceding, 0)
    until = F.max("_until").over(w)
    return marks.withColumn("_reach", until).where("_step").select(
        "scenario", "timestamp_s", F.coalesce(F.col("_reach") >= F.col("timestamp_s"), F.lit(False)).alias("fired")
    )


def step_scores(states: DataFrame, incidents: DataFrame) -> DataFrame:
    """True and missed steps of the fault window, false alarms before it, steps fired in recovery, and the latency; states(scenario, timestamp_s, state)."""
    steps = states.select("scenario", "timestamp_s", "state").distinct()
    rows = steps.join(fired_steps(steps, incidents), ["scenario", "timestamp_s"])
    active, fired = F.col("state") == "fault_active", F.col("fired")
    first = F.min(F.when(active & fired, F.col("timestamp_s")))
    return rows.groupBy("scenario").agg(
        F.count_if(active & fired).alias("true_positive"), F.count_if(active & ~fired).alias("false_negative"),
        F.count_if((F.col("state") == "normal") & fired).alias("false_positive"), F.count_if((F.col("state") == "recovery") & fired).alias("recovery_fired"),
        F.count_if(F.col("state") == "normal").alias("normal_steps"), F.count_if(F.col("state") == "recovery").alias("recovery_steps"),
        (first - F.min(F.when(active, F.col("timestamp_s")))).alias("latency_s"),
    )


def overall(scored: DataFrame, control: DataFrame | None = None, ks: Sequence[int] = (1, 3, 5, 10), by: str | None = None) -> DataFrame:
    """One row over all scenarios, or one for each ``by`` and 'all': rates over all steps, the median latency and the share of hits.

    ``scored`` joins ``step_scores``, ``hits_at`` and ``detected`` by scenario, maybe with ``epicenter_hops``; ``control`` are the step scores of runs without a fault, whose
    steps count as normal time. A rate without steps is null.
    """
    c = {"_fp": 0, "_normal": 0, "clean": None}
    if control is not None:
        r = control.agg(F.sum("false_positive").alias("_fp"), F.sum("normal_steps").alias("_normal"), F.max("fired").alias("fired")).first()
        c = {"_fp": r[0] or 0, "_normal": r[1] or 0, "clean": None if r[2] is None else not r[2]}
    tp, fp = F.sum("true_positive"), F.sum("false_positive") + c["_fp"]
    rates = {
        "scenarios": F.count(F.lit(1)), "detected": F.count_if("detected"), "fault_active_recall": F.try_divide(tp, tp + F.sum("false_negative")),
        "precision": F.try_divide(tp, tp + fp), "false_alarm_rate_normal_time": F.try_divide(fp, F.sum("normal_steps") + c["_normal"]),
        "median_latency_hours": F.median(F.col("latency_s") / 3600), "recovery_firing_rate": F.try_divide(F.sum("recovery_fired"), F.sum("recovery_steps")),
        **{f"hit_at_{k}": F.avg(F.col(f"hit_at_{k}").cast("int")) for k in ks},
    }
    if "epicenter_hops" in scored.columns:
        rates["median_epicenter_hops"] = F.median("epicenter_hops")
    out = all_and_each(scored, by, **rates) if by else scored.agg(*(v.alias(k) for k, v in rates.items()))
    return out if control is None else out.withColumn("baseline_control_clean", F.lit(c["clean"]))


def report_text(summary: DataFrame) -> DataFrame:
    """(report): the rows of ``overall`` in words, a line for each figure; unknown ones are ``n/a``."""
    def share(c: str) -> Column:
        return F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.1f%%", F.col(c) * 100))

    lines = [F.format_string("Scenarios with an incident: %d of %d", "detected", "scenarios")]
    lines += [F.concat(F.lit(f"{words}: "), share(c)) for c, words in (
        ("fault_active_recall", "Steps of faults that fired"), ("precision", "Precision against normal time"), ("false_alarm_rate_normal_time", "False alarms in normal time"),
        ("recovery_firing_rate", "Steps of recovery that fired"))]
    lines.append(F.concat(F.lit("Median latency: "), F.when(F.col("median_latency_hours").isNull(), "n/a").otherwise(F.format_string("%.1f h", "median_latency_hours"))))
    lines += [F.concat(F.lit(f"Target within the first {c.rpartition('_')[2]}: "), share(c)) for c in summary.columns if c.startswith("hit_at_")]
    return summary.select(F.concat_ws("\n", *lines).alias("report"))


def scored_incident(incidents: DataFrame, active: DataFrame) -> DataFrame:
    """The incident of each scenario that is scored: the first that overlaps the active time(scenario, begin_s, end_s), else the first with candidates."""
    rows = incidents.join(active, "scenario", "left")
    overlaps = (F.col("detected_at_s") < F.col("end_s")) & (F.col("last_seen_s") >= F.col("begin_s"))
    w = Window.partitionBy("scenario").orderBy(F.desc(F.coalesce(overlaps.cast("int"), F.lit(0))), "incident_no")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "begin_s", "end_s")


def hits_at(candidates: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """First rank of a true asset(scenario, asset_id) among the candidates (scenario, position, asset_id), and whether it is within k."""
    t = truth.select("scenario", "asset_id").distinct()
    best = candidates.join(t, ["scenario", "asset_id"], "left_semi").groupBy("scenario").agg(F.min("position").alias("first_hit_rank"))
    rows = t.select("scenario").distinct().join(best, "scenario", "left")
    return rows.withColumns({f"hit_at_{k}": F.coalesce(F.col("first_hit_rank") <= k, F.lit(False)) for k in ks})


def all_and_each(rows: DataFrame, by: str, **aggregates) -> DataFrame:
    """The aggregates over all rows (``by`` is 'all') and for each value of by, in one pass. Without rows there is still the one of 'all', as of any whole table."""
    aggregates = [v.alias(k) for k, v in aggregates.items()]
    out = rows.rollup(by).agg(F.grouping(by).cast("int").alias("_all"), *aggregates)
    # a rollup of no rows has no total; this one, of nothing, reads nothing and gives way to a total that is there
    nothing = rows.where(F.lit(False)).agg(*aggregates).select(F.lit(None).cast(rows.schema[by].dataType).alias(by), F.lit(1).alias("_all"), "*")
    both = out.withColumn("_spare", F.lit(False)).unionByName(nothing.withColumn("_spare", F.lit(True)))
    one = ranked_first(both, ["_all", by], "_spare")
    return one.withColumn(by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by))).drop("_all", "_spare")


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """The value at rank round(q * (n - 1)), halves to even, of each group."""
    return quantiles(rows, by, value, (q,), "nearest").select(*by, F.col("q")[0].alias("value"))
