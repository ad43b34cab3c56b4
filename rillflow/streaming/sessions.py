"""Events, report means and incidents over streams of readings.

The reference has no late-data policy. Here a watermark of ``late`` decides: readings later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.functions.columns import joined
from rillflow.functions.shipping import ship
from rillflow.operators.scenarios import report_means as batch_means


def timed(rows: DataFrame, late: str | None = None) -> DataFrame:
    out = rows.withColumn("ts", F.timestamp_seconds("timestamp_s"))
    return out.withWatermark("ts", late) if late else out


def session_events(anomalies: DataFrame, max_gap_s: int, late: str | None = None) -> DataFrame:
    """Anomalous readings grouped into sessions of a scenario; the same plan for batch and stream (with a watermark).

    A gap of exactly max_gap_s still belongs to the session, as in the batch events.
    """
    rows = timed(anomalies, late)
    out = rows.groupBy("scenario", F.session_window("ts", f"{max_gap_s} seconds").alias("w")).agg(
        F.min("timestamp_s").alias("start_timestamp_s"), F.max("timestamp_s").alias("end_timestamp_s"), F.count(F.lit(1)).alias("anomaly_record_count"),
        F.max("abs_residual").alias("peak_abs_residual"), joined(F.col("asset_id")).alias("affected_assets"),
    )
    return out.drop("w")


def report_means(readings: DataFrame, period_s: int, late: str | None = None) -> DataFrame:
    """Means over (t - period, t]: tumbling windows over the time moved by a microsecond, as Spark's are closed on the left."""
    if late:
        ahead = period_s * (86_400 // period_s + 1)  # a watermark begins at 1970, and step 0 lies just before it
        ts = F.timestamp_seconds(F.col("timestamp_s") + ahead) - F.expr("INTERVAL 1 MICROSECOND")
        rows = readings.withColumn("ts", ts).withWatermark("ts", late)
        w = F.window("ts", f"{period_s} seconds")
        out = rows.groupBy(w.alias("w"), "scenario", "asset_id", "asset_type", "parameter").agg(F.avg("value").alias("value"))
        return out.select("scenario", (F.unix_timestamp("w.end") - ahead).alias("timestamp_s"), "asset_id", "asset_type", "parameter", "value")
    return batch_means(readings, period_s)


INCIDENT_DDL = "scenario string, detected_at_s long, last_seen_s long, step_count long"


def stream_incidents(steps: DataFrame, late: str = "1 hour") -> DataFrame:
    """Runs of positive steps from a stream of steps(scenario, timestamp_s, positive), one row for each step of the timeline.

    State by scenario: the steps not yet settled. A step is settled once the watermark has passed it; then a quiet step closes the open
    run and emits it. The last run is emitted when a quiet step, or nothing more, follows within the watermark.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, count, waiting = state.get if state.exists else (None, None, 0, [])
        waiting = [tuple(x) for x in waiting]
        for b in batches:
            waiting += [(int(t), bool(p)) for t, p in zip(b["timestamp_s"], b["positive"])]
        mark = state.getCurrentWatermarkMs() // 1000
        out, rest = [], []
        for t, positive in sorted(set(waiting)):
            if t > mark:
                rest.append((t, positive))
            elif positive:
                begin, last, count = (t if begin is None else begin), t, count + 1
            elif begin is not None:
                out.append((key[0], begin, last, count))
                begin, last, count = None, None, 0
        if state.hasTimedOut and begin is not None and not rest:
            out.append((key[0], begin, last, count))
            begin, last, count = None, None, 0
        if begin is None and not rest:
            state.remove()
        else:
            state.update((begin, last, count, [list(x) for x in rest]))
            state.setTimeoutTimestamp((max([t for t, _ in rest] + [last or 0]) + 1) * 1000 + 1 if rest or last else mark * 1000 + 1000)
        yield pd.DataFrame(out, columns=["scenario", "detected_at_s", "last_seen_s", "step_count"])

    ship(steps.sparkSession)
    state_type = "begin long, last long, count long, waiting array<struct<t: long, positive: boolean>>"
    return timed(steps, late).groupBy("scenario").applyInPandasWithState(
        advance, INCIDENT_DDL, state_type, "append", GroupStateTimeout.EventTimeTimeout
    )


CHANGES_DDL = "scenario string, as_of_s long, kind string, root string, confidence double, severity string"


def stream_changes(diagnoses: DataFrame) -> DataFrame:
    """ALERT for a scenario's first diagnosis and UPDATE whenever root, confidence or severity change after it, from a stream of
    diagnoses(scenario, as_of_s, root, confidence, severity). Rows of one batch are taken by time; an older row than the last one changes nothing."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        rows = sorted((int(t), r, float(c), s) for b in batches for t, r, c, s in zip(b["as_of_s"], b["root"], b["confidence"], b["severity"]))
        for t, root, confidence, severity in rows:
            if last is not None and t < last[0]:
                continue
            if last is None or (root, confidence, severity) != tuple(last[1:]):
                out.append((key[0], t, "ALERT" if last is None else "UPDATE", root, confidence, severity))
            last = (t, root, confidence, severity)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES_DDL.split(", ")])

    ship(diagnoses.sparkSession)
    return diagnoses.groupBy("scenario").applyInPandasWithState(
        advance, CHANGES_DDL, "as_of_s long, root string, confidence double, severity string", "append", GroupStateTimeout.NoTimeout
    )
