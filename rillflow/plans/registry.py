"""All queries of the water-network engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import gaussian, noise_scale, phase, severity_rank, wilson
from rillflow.functions.lineage import cut
from rillflow.operators import contracts, day, detect, diagnosis, evaluate, graph, retrieval, scenarios, tabular
from rillflow.operators.selection import quantiles
from rillflow.plans import fixtures as fx
from rillflow.schemas import KEY
from rillflow.streaming.sessions import session_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CELL = ["scenario", *KEY]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; 32-bit integers widened."""
    def tidy(name: str, kind: str):
        c = F.col(name)
        c = F.round(c, digits) if kind == "double" else c.cast("long") if kind == "int" else c
        return c.alias(name)

    return df.select(*(tidy(*t) for t in df.dtypes))


# ---- SQL pieces shared by the checks

READINGS = """readings AS (
  SELECT 'S' || CAST((user_id // 10) % 3 AS VARCHAR) AS scenario,
    CAST(floor((epoch(ts) - 1704067200) / 21600) * 21600 AS BIGINT) AS timestamp_s,
    'A' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS asset_id,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'link' ELSE 'node' END AS asset_type,
    CASE WHEN event_type IN ('click', 'view') THEN 'pressure' WHEN event_type IN ('purchase', 'error') THEN 'flowrate' ELSE 'demand' END AS parameter,
    CAST(event_id % 2 AS BIGINT) AS half, avg(value) AS value
  FROM events GROUP BY ALL),
base AS (SELECT * EXCLUDE (half) FROM readings WHERE half = 0),
obs AS (SELECT * EXCLUDE (half), CASE WHEN timestamp_s < 864000 THEN 'normal' WHEN timestamp_s < 1728000 THEN 'fault_active' ELSE 'recovery' END AS state
  FROM readings WHERE half = 1)"""

ALIGNED = READINGS + """,
aligned AS (SELECT o.scenario, o.timestamp_s, o.asset_id, o.asset_type, o.parameter, o.state, b.value AS expected_value, o.value AS observed_value,
    o.value - b.value AS residual, abs(o.value - b.value) AS abs_residual
  FROM obs o JOIN base b USING (scenario, timestamp_s, asset_id, asset_type, parameter))"""

DETECTED = ALIGNED + """,
tiers AS (SELECT * FROM (VALUES ('pressure', 60.0::DOUBLE, 90.0::DOUBLE, 130.0::DOUBLE), ('flowrate', 80.0, 110.0, 150.0)) t(parameter, t1, t2, t3)),
detected AS (SELECT a.*, t.parameter IS NOT NULL AS is_monitored, t.t1 AS threshold_anomaly, t.t2 AS threshold_warning, t.t3 AS threshold_critical,
    CASE WHEN abs_residual >= t3 THEN 'critical' WHEN abs_residual >= t2 THEN 'warning' WHEN abs_residual >= t1 THEN 'anomaly' ELSE 'normal' END AS severity,
    coalesce(abs_residual >= t1, false) AS is_anomaly
  FROM aligned a LEFT JOIN tiers t USING (parameter))"""

ISLANDS = DETECTED + """,
bad AS (SELECT * FROM detected WHERE is_anomaly),
steps AS (SELECT DISTINCT scenario, timestamp_s FROM bad),
opened AS (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER w <= 21600 THEN 0 ELSE 1 END AS opens FROM steps WINDOW w AS (PARTITION BY scenario ORDER BY timestamp_s)),
islands AS (SELECT scenario, timestamp_s, CAST(sum(opens) OVER (PARTITION BY scenario ORDER BY timestamp_s) AS BIGINT) AS event_number FROM opened),
evidence AS (SELECT b.*, i.event_number FROM bad b JOIN islands i USING (scenario, timestamp_s))"""

EVENTS = ISLANDS + """,
ranks AS (SELECT * FROM (VALUES ('normal', 0), ('anomaly', 1), ('warning', 2), ('critical', 3)) t(severity, level)),
events_out AS (SELECT scenario || '_event_' || lpad(CAST(event_number AS VARCHAR), 2, '0') AS event_id, scenario, event_number,
    min(timestamp_s) AS start_timestamp_s, max(timestamp_s) AS end_timestamp_s, max(timestamp_s) - min(timestamp_s) AS event_span_s,
    count(DISTINCT timestamp_s) AS timestamp_count, count(*) AS anomaly_record_count, arg_max(severity, level) AS peak_severity,
    round(max(abs_residual), 6) AS peak_abs_residual, round(avg(abs_residual), 6) AS mean_abs_residual, count(DISTINCT asset_id) AS affected_asset_count,
    string_agg(DISTINCT asset_id, '|' ORDER BY asset_id) AS affected_assets, string_agg(DISTINCT asset_type, '|' ORDER BY asset_type) AS affected_asset_types,
    string_agg(DISTINCT parameter, '|' ORDER BY parameter) AS affected_parameters, count(*) FILTER (parameter = 'pressure') AS pressure_anomaly_count,
    count(*) FILTER (parameter = 'flowrate') AS flowrate_anomaly_count, string_agg(DISTINCT state, '|' ORDER BY state) AS ground_truth_states
  FROM evidence JOIN ranks USING (severity) GROUP BY scenario, event_number)"""

LABELLED = EVENTS + """,
labelled AS (SELECT *, CASE WHEN contains(ground_truth_states, 'fault_active') THEN 'primary' WHEN ground_truth_states = 'recovery' THEN 'recovery_transient'
    WHEN ground_truth_states = 'normal' THEN 'pre_fault_false_positive' ELSE 'mixed_or_unknown' END AS evaluation_label FROM events_out)"""

SCORED = READINGS + """,
scored AS (SELECT o.scenario, o.timestamp_s, o.asset_id, o.asset_type, o.parameter, o.state, o.value AS observed, b.value AS expected, o.value - b.value AS residual,
    CASE WHEN o.parameter = 'pressure' THEN 20 + 0.05 * abs(o.value) ELSE 30 + 0.05 * abs(o.value) END AS noise_std,
    abs(o.value - b.value) / (CASE WHEN o.parameter = 'pressure' THEN 20 + 0.05 * abs(o.value) ELSE 30 + 0.05 * abs(o.value) END) AS score
  FROM obs o JOIN base b USING (scenario, timestamp_s, asset_id, parameter) WHERE o.parameter IN ('pressure', 'flowrate'))"""

INCIDENTS = SCORED + """,
flagged AS (SELECT * FROM scored WHERE score > 1.5),
timeline AS (SELECT scenario, timestamp_s, row_number() OVER (PARTITION BY scenario ORDER BY timestamp_s) AS pos
  FROM (SELECT DISTINCT scenario, timestamp_s FROM obs WHERE parameter IN ('pressure', 'flowrate'))),
positives AS (SELECT scenario, timestamp_s, count(DISTINCT (asset_type, asset_id)) AS asset_count FROM flagged GROUP BY ALL HAVING count(DISTINCT (asset_type, asset_id)) >= 2),
runs AS (SELECT p.scenario, p.timestamp_s, t.pos - row_number() OVER (PARTITION BY p.scenario ORDER BY p.timestamp_s) AS run FROM positives p JOIN timeline t USING (scenario, timestamp_s)),
numbered AS (SELECT scenario, timestamp_s, dense_rank() OVER (PARTITION BY scenario ORDER BY run) AS incident_no FROM runs),
members AS (SELECT f.*, n.incident_no FROM flagged f JOIN numbered n USING (scenario, timestamp_s)),
incidents AS (SELECT scenario, incident_no, min(timestamp_s) AS detected_at_s, max(timestamp_s) AS last_seen_s, count(*) AS event_count,
    string_agg(DISTINCT parameter, '|' ORDER BY parameter) AS parameters FROM members GROUP BY ALL),
best AS (SELECT scenario, incident_no, parameter, asset_id, asset_type, score, residual, timestamp_s AS peak_at_s,
    min(timestamp_s) OVER (PARTITION BY scenario, incident_no, parameter, asset_id) AS first_seen_s,
    row_number() OVER (PARTITION BY scenario, incident_no, parameter, asset_id ORDER BY score DESC, timestamp_s) AS rn FROM members),
channel AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY scenario, incident_no, parameter ORDER BY score DESC, first_seen_s, parameter, asset_id) AS channel_rank FROM best WHERE rn = 1),
candidates AS (SELECT *, row_number() OVER (PARTITION BY scenario, incident_no ORDER BY channel_rank, score DESC, first_seen_s, parameter, asset_id) AS position FROM channel)"""

TREE = """tree AS (
  SELECT 'R' || r_regionkey AS child, 'WORLD' AS parent FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""

CLOSURE = "WITH RECURSIVE " + TREE + """,
closure AS (SELECT child AS ancestor, child AS descendant, CAST(0 AS BIGINT) AS distance FROM tree
  UNION ALL SELECT t.parent, c.descendant, c.distance + 1 FROM closure c JOIN tree t ON t.child = c.ancestor)"""

LINKS = """links AS (SELECT 'P' || l_partkey AS a, 'S' || l_suppkey AS b, l_quantity - 25 AS flow FROM lineitem),
seed AS (SELECT 'P' || min(CAST(substr(a, 2) AS BIGINT)) AS node FROM links)"""


def _detected(spark: SparkSession, d: str) -> DataFrame:
    aligned = tabular.align(fx.expected(spark, d), fx.observed(spark, d), CELL)
    return tabular.classify(tabular.residuals(aligned), fx.THRESHOLDS)


def _manifest(spark: SparkSession) -> DataFrame:
    rows = [(f"S{i}", kind, f"A0{i}", 0.5, 240.0, 480.0) for i, kind in enumerate(("leak", "blockage", "leak"))]
    return spark.createDataFrame(rows, "scenario string, fault_type string, target_id string, severity double, start_hour double, end_hour double")


MANIFEST = "manifest AS (SELECT * FROM (VALUES ('S0', 'leak', 'A00'), ('S1', 'blockage', 'A01'), ('S2', 'leak', 'A02')) t(scenario, fault_type, target_id))"


# ---- table pipeline


@query("WITH " + READINGS + " SELECT scenario, timestamp_s, asset_id, asset_type, parameter, half, round(value, 6) AS value FROM readings")
def readings_long(spark, d):
    return rounded(fx.readings(spark, d).drop("state"))


@query("WITH " + ALIGNED + " SELECT scenario, timestamp_s, asset_id, asset_type, parameter, state, round(expected_value, 6) AS expected_value, round(observed_value, 6) AS observed_value FROM aligned")
def align_exact(spark, d):
    """Of the keys that both sides have, else the operator would raise."""
    e, o = fx.expected(spark, d), fx.observed(spark, d)
    return rounded(tabular.align_exact(e.join(o, CELL, "left_semi"), o.join(e, CELL, "left_semi"), CELL))


@query("WITH " + READINGS + """ SELECT count(*) FILTER (b.value IS NOT NULL AND o.value IS NOT NULL) AS matched, count(*) FILTER (o.value IS NULL) AS baseline_only,
  count(*) FILTER (b.value IS NULL) AS scenario_only FROM base b FULL JOIN obs o USING (scenario, timestamp_s, asset_id, asset_type, parameter)""")
def align_unmatched(spark, d):
    return tabular.align_counts(fx.expected(spark, d), fx.observed(spark, d), CELL)


@query("WITH " + ALIGNED + " SELECT scenario, timestamp_s, asset_id, asset_type, parameter, round(residual, 6) AS residual, round(abs_residual, 6) AS abs_residual FROM aligned")
def residuals(spark, d):
    rows = tabular.residuals(tabular.align(fx.expected(spark, d), fx.observed(spark, d), CELL))
    return rounded(rows.select(*CELL, "residual", "abs_residual"))


@query("WITH " + DETECTED + """ SELECT scenario, timestamp_s, asset_id, asset_type, parameter, is_monitored, threshold_anomaly, threshold_warning, threshold_critical, severity, is_anomaly FROM detected""")
def severity_tiers(spark, d):
    return _detected(spark, d).select(*CELL, "is_monitored", "threshold_anomaly", "threshold_warning", "threshold_critical", "severity", "is_anomaly")


@query("WITH " + ISLANDS + " SELECT * FROM islands")
def event_islands(spark, d):
    return rounded(tabular.islands(_detected(spark, d).where("is_anomaly"), fx.STEP_S))


@query("WITH " + EVENTS + " SELECT * FROM events_out")
def anomaly_events(spark, d):
    return rounded(tabular.events(_detected(spark, d), fx.STEP_S))


@query("WITH " + ISLANDS + """ SELECT scenario || '_event_' || lpad(CAST(event_number AS VARCHAR), 2, '0') AS event_id, event_number, scenario, timestamp_s, asset_id, asset_type, parameter,
  state, severity, round(abs_residual, 6) AS abs_residual FROM evidence""")
def event_evidence(spark, d):
    rows = tabular.evidence(_detected(spark, d), fx.STEP_S)
    return rounded(rows.select("event_id", "event_number", *CELL, "state", "severity", "abs_residual"))


@query("WITH " + LABELLED + " SELECT event_id, ground_truth_states, evaluation_label FROM labelled")
def event_phase(spark, d):
    rows = tabular.events(_detected(spark, d), fx.STEP_S)
    return rows.select("event_id", "ground_truth_states", phase(F.col("ground_truth_states")).alias("evaluation_label"))


@query("WITH " + ALIGNED + """ SELECT scenario, state, parameter, count(*) AS row_count, count(*) FILTER (abs_residual > 0) AS changed_count, round(avg(abs_residual), 6) AS mean_abs,
  round(quantile_cont(abs_residual, 0.5), 6) AS median_abs, round(quantile_cont(abs_residual, 0.95), 6) AS p95_abs, round(quantile_cont(abs_residual, 0.99), 6) AS p99_abs,
  round(max(abs_residual), 6) AS max_abs, round(count(*) FILTER (abs_residual > 0) / count(*), 6) AS changed_fraction FROM aligned GROUP BY scenario, state, parameter""")
def residual_profile(spark, d):
    return rounded(tabular.residual_profile(tabular.residuals(tabular.align(fx.expected(spark, d), fx.observed(spark, d), CELL))))


@query("WITH " + ALIGNED + """, x AS (SELECT *, row_number() OVER (PARTITION BY scenario, asset_id, asset_type, parameter ORDER BY abs_residual DESC, timestamp_s) AS rn FROM aligned WHERE state = 'fault_active'),
g AS (SELECT scenario, asset_id, asset_type, parameter, round(avg(abs_residual), 6) AS mean_abs_residual, max(abs_residual) AS m, round(max(abs_residual), 6) AS max_abs_residual,
  round(max(residual) FILTER (rn = 1), 6) AS residual_at_peak, min(timestamp_s) FILTER (abs_residual > 0) AS first_change_s FROM x GROUP BY ALL),
o AS (SELECT * EXCLUDE (m), row_number() OVER (PARTITION BY scenario ORDER BY m DESC, asset_id, parameter, asset_type) AS rank FROM g)
SELECT * FROM o WHERE rank <= 10""")
def asset_ranking(spark, d):
    rows = tabular.residuals(tabular.align(fx.expected(spark, d), fx.observed(spark, d), CELL))
    return rounded(tabular.rank_assets(rows))


@query("WITH " + DETECTED + """ SELECT scenario, count(*) FILTER (is_anomaly AND state = 'normal') AS normal_anomalies, count(*) FILTER (is_anomaly AND state = 'fault_active') AS fault_active_anomalies,
  count(*) FILTER (is_anomaly AND state = 'recovery') AS recovery_anomalies, count(*) FILTER (is_anomaly AND state = 'fault_active' AND parameter = 'pressure') AS pressure_anomalies,
  count(*) FILTER (is_anomaly AND state = 'fault_active' AND parameter = 'flowrate') AS flowrate_anomalies, count(*) FILTER (is_anomaly AND state = 'fault_active') > 0 AS fault_detected,
  min(timestamp_s) FILTER (is_anomaly AND state = 'fault_active') AS first_detection_s,
  min(timestamp_s) FILTER (is_anomaly AND state = 'fault_active') - min(timestamp_s) FILTER (state = 'fault_active') AS detection_delay_s FROM detected GROUP BY scenario""")
def point_summary(spark, d):
    return tabular.point_summary(_detected(spark, d))


SUMMARY = LABELLED + ", " + MANIFEST + """,
p AS (SELECT scenario, count(*) FILTER (evaluation_label = 'primary') AS pn, min(start_timestamp_s) FILTER (evaluation_label = 'primary') AS first_detection_timestamp_s,
  sum(event_span_s) FILTER (evaluation_label = 'primary') AS span, sum(anomaly_record_count) FILTER (evaluation_label = 'primary') AS recs,
  max(affected_asset_count) FILTER (evaluation_label = 'primary') AS assets, max(peak_abs_residual) FILTER (evaluation_label = 'primary') AS primary_peak_abs_residual,
  count(*) FILTER (evaluation_label = 'recovery_transient') AS rn, sum(anomaly_record_count) FILTER (evaluation_label = 'recovery_transient') AS rrecs FROM labelled GROUP BY scenario),
summary AS (SELECT scenario, fault_type, target_id, CAST(coalesce(pn, 0) AS BIGINT) AS primary_event_count, first_detection_timestamp_s,
  first_detection_timestamp_s - 864000 AS detection_delay_s, CAST(coalesce(span, 0) AS BIGINT) AS primary_event_span_s, CAST(coalesce(recs, 0) AS BIGINT) AS primary_anomaly_record_count,
  CAST(coalesce(assets, 0) AS BIGINT) AS primary_affected_asset_count, primary_peak_abs_residual, CAST(coalesce(rn, 0) AS BIGINT) AS recovery_event_count,
  CAST(coalesce(rrecs, 0) AS BIGINT) AS recovery_anomaly_record_count, coalesce(pn, 0) > 0 AS detected FROM manifest LEFT JOIN p USING (scenario))"""


def _summary(spark, d):
    m = _manifest(spark)
    labelled = evaluate.label_events(tabular.events(_detected(spark, d), fx.STEP_S), m)
    return evaluate.scenario_summary(labelled, m)


@query("WITH " + SUMMARY + " SELECT * FROM summary")
def scenario_summary(spark, d):
    rows = _summary(spark, d).drop("configured_severity", "fault_start_hour", "fault_end_hour", "detection_delay_h", "primary_event_span_h")
    return rounded(rows)


@query("WITH " + SUMMARY + """ SELECT fault_type, count(*) AS scenario_count, count(*) FILTER (detected) AS detected_scenario_count, CAST(sum(primary_event_count) AS BIGINT) AS primary_event_count,
  round(avg(detection_delay_s), 6) AS mean_detection_delay_s, round(median(detection_delay_s), 6) AS median_detection_delay_s, max(detection_delay_s) AS maximum_detection_delay_s,
  round(avg(primary_event_span_s / 3600), 6) AS mean_primary_event_span_h, round(avg(primary_anomaly_record_count), 6) AS mean_primary_anomaly_records,
  round(avg(primary_peak_abs_residual), 5) AS mean_peak_abs_residual, round(100 * count(*) FILTER (detected) / count(*), 6) AS detection_rate_percent FROM summary GROUP BY fault_type""")
def fault_type_summary(spark, d):
    rows = evaluate.fault_type_summary(_summary(spark, d)).withColumn("mean_peak_abs_residual", F.round("mean_peak_abs_residual", 5))
    return rounded(rows.select("fault_type", "scenario_count", "detected_scenario_count", "primary_event_count", "mean_detection_delay_s", "median_detection_delay_s",
                               "maximum_detection_delay_s", "mean_primary_event_span_h", "mean_primary_anomaly_records", "mean_peak_abs_residual", "detection_rate_percent"))


@query("WITH " + LABELLED + """ SELECT coalesce(evaluation_label, 'all') AS evaluation_label, count(*) AS event_count, CAST(sum(anomaly_record_count) AS BIGINT) AS records
  FROM labelled GROUP BY GROUPING SETS ((), (evaluation_label))""")
def events_all_and_by_phase(spark, d):
    rows = tabular.events(_detected(spark, d), fx.STEP_S).withColumn("evaluation_label", phase(F.col("ground_truth_states")))
    return evaluate.all_and_each(rows, "evaluation_label", event_count=F.count(F.lit(1)), records=F.sum("anomaly_record_count"))


# ---- sensor pipeline


@query("WITH " + READINGS + """ SELECT scenario, timestamp_s, asset_id, asset_type, parameter, round(CASE parameter WHEN 'pressure' THEN 20 + 0.05 * abs(value) WHEN 'flowrate' THEN 30 + 0.05 * abs(value)
  ELSE 0 END, 6) AS noise_std FROM obs""")
def sensor_noise_scale(spark, d):
    return rounded(fx.observed(spark, d).select(*CELL, noise_scale(F.col("parameter"), F.col("value"), fx.NOISE).alias("noise_std")))


@query()
def keyed_noise_stats(spark, d):
    """Mean and deviation of the keyed draws, which should be near 0 and 1."""
    z = gaussian(42, *(F.col(c) for c in CELL))
    return rounded(fx.observed(spark, d).select(z.alias("z")).agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd")))


@query("WITH " + READINGS + """ SELECT scenario, timestamp_s, asset_id, asset_type, parameter, round(value, 6) AS value FROM obs
  WHERE asset_id IN (SELECT asset_id FROM obs WHERE parameter = 'demand' AND scenario = 'S0')""")
def coverage_semi(spark, d):
    rows = fx.observed(spark, d)
    sensors = rows.where("parameter = 'demand' AND scenario = 'S0'").select("asset_id")
    return rounded(detect.observe(rows, fx.NOISE, sensors, noise=False).select(*CELL, "value"))


@query("WITH " + READINGS + " SELECT DISTINCT asset_type, asset_id FROM obs WHERE asset_id >= 'A05'")
def unknown_assets_anti(spark, d):
    rows = fx.observed(spark, d)
    known = rows.where("asset_id < 'A05'").select("asset_id").distinct()
    return contracts.unknown_assets(rows, known, known)


def _observed(spark, d):
    return detect.observe(fx.observed(spark, d), fx.NOISE, noise=False)


BY = ("scenario", "timestamp_s", "asset_id", "parameter")


def _scored(spark, d):
    return detect.residual_scores(_observed(spark, d), fx.expected(spark, d), BY)


def _incident():
    return F.concat_ws("-", "scenario", "incident_no").alias("incident")


def _flagged_members(spark, d):
    """Flags, and those of incidents."""
    flagged = detect.flag(_scored(spark, d), 1.5)
    return flagged, detect.members(_observed(spark, d), flagged)


def _heads(rows):
    spans = rows.groupBy("scenario", "incident_no").agg(F.min("timestamp_s").alias("detected_at_s"), F.max("timestamp_s").alias("last_seen_s"))
    return spans.withColumn("incident", _incident())


def _building(readings):
    """All assets of readings as junctions, with a sensor for each of their parameters."""
    assets = readings.select("asset_id", F.lit("junction").alias("kind"), F.lit(None).cast("string").alias("role")).distinct()
    return retrieval.Building(assets, None, readings.select("asset_id", "parameter").distinct())


def _members(spark, d):
    observed = _observed(spark, d)
    return detect.members(observed, detect.flag(detect.residual_scores(observed, fx.expected(spark, d), BY), 1.5))


@query("WITH " + SCORED + " SELECT scenario, timestamp_s, asset_id, asset_type, parameter, round(residual, 6) AS residual, round(score, 6) AS score FROM scored")
def residual_sigma_score(spark, d):
    return rounded(_scored(spark, d).select(*CELL, "residual", "score"))


@query("WITH " + READINGS + """, m AS (SELECT *, median(value) OVER (PARTITION BY scenario, parameter, asset_id) AS med FROM obs WHERE parameter IN ('pressure', 'flowrate')),
s AS (SELECT *, value - med AS residual, median(abs(value - med)) OVER (PARTITION BY scenario, parameter, asset_id) AS mad FROM m)
SELECT scenario, timestamp_s, asset_id, asset_type, parameter, round(med, 6) AS expected, round(residual, 6) AS residual,
  round(abs(residual) / greatest(1.4826 * mad, CASE parameter WHEN 'pressure' THEN 20 + 0.05 * abs(value) ELSE 30 + 0.05 * abs(value) END), 6) AS score FROM s""")
def statistical_mad_score(spark, d):
    return rounded(detect.mad_scores(_observed(spark, d)).select(*CELL, "expected", "residual", "score"))


@query("WITH " + INCIDENTS + " SELECT * FROM positives")
def positive_timestamps(spark, d):
    return detect.positive_steps(detect.flag(_scored(spark, d), 1.5))


@query("WITH " + INCIDENTS + """ SELECT scenario, incident_no, detected_at_s, last_seen_s, event_count, parameters, c.asset_id AS epicenter
  FROM incidents JOIN (SELECT scenario, incident_no, asset_id FROM candidates WHERE position = 1) c USING (scenario, incident_no)""")
def incidents(spark, d):
    return rounded(detect.incidents(_members(spark, d)).withColumn("parameters", F.array_join("parameters", "|")).drop("candidates"))


@query("WITH " + INCIDENTS + """ SELECT scenario, incident_no, position, parameter, asset_id, asset_type, round(score, 6) AS score, round(residual, 6) AS residual, peak_at_s, first_seen_s, channel_rank
  FROM candidates""")
def incident_candidates(spark, d):
    return rounded(detect.candidates(_members(spark, d)))


@query("WITH " + INCIDENTS + """, truth AS (SELECT * FROM (VALUES ('S0', 'A00'), ('S1', 'A01'), ('S2', 'A02')) t(scenario, asset_id)),
s AS (SELECT i.scenario, i.incident_no, row_number() OVER (PARTITION BY scenario ORDER BY CASE WHEN detected_at_s < 1728000 AND last_seen_s >= 864000 THEN 0 ELSE 1 END, incident_no) AS rn FROM incidents i),
h AS (SELECT c.scenario, min(position) AS first_hit_rank FROM candidates c JOIN s USING (scenario, incident_no) JOIN truth t ON t.scenario = c.scenario AND t.asset_id = c.asset_id WHERE rn = 1 GROUP BY c.scenario)
SELECT scenario, first_hit_rank, coalesce(first_hit_rank <= 1, false) AS hit_at_1, coalesce(first_hit_rank <= 3, false) AS hit_at_3, coalesce(first_hit_rank <= 5, false) AS hit_at_5,
  coalesce(first_hit_rank <= 10, false) AS hit_at_10 FROM truth LEFT JOIN h USING (scenario)""")
def hit_at_k(spark, d):
    found = detect.incidents(_members(spark, d))
    active = spark.createDataFrame([(f"S{i}", fx.FAULT_START_S, fx.FAULT_END_S) for i in range(3)], "scenario string, begin_s long, end_s long")
    rows = evaluate.scored_incident(found, active).select("scenario", F.explode("candidates").alias("c")).select("scenario", "c.position", "c.asset_id")
    truth = _manifest(spark).select("scenario", F.col("target_id").alias("asset_id"))
    return rounded(evaluate.hits_at(rows, truth))


@query("WITH " + INCIDENTS + """, st AS (SELECT DISTINCT scenario, timestamp_s, state FROM obs),
f AS (SELECT st.*, EXISTS (SELECT 1 FROM incidents i WHERE i.scenario = st.scenario AND st.timestamp_s BETWEEN i.detected_at_s AND i.last_seen_s) AS fired FROM st)
SELECT scenario, count(*) FILTER (state = 'fault_active' AND fired) AS true_positive, count(*) FILTER (state = 'fault_active' AND NOT fired) AS false_negative,
  count(*) FILTER (state = 'normal' AND fired) AS false_positive, count(*) FILTER (state = 'recovery' AND fired) AS recovery_fired,
  min(timestamp_s) FILTER (state = 'fault_active' AND fired) - min(timestamp_s) FILTER (state = 'fault_active') AS latency_s,
  count(*) FILTER (state = 'normal') AS normal_steps, count(*) FILTER (state = 'recovery') AS recovery_steps FROM f GROUP BY scenario""")
def step_scoring(spark, d):
    return evaluate.step_scores(fx.observed(spark, d), detect.incidents(_members(spark, d)))


@query("WITH s AS (" + ORACLES["step_scoring"] + "), h AS (" + ORACLES["hit_at_k"] + "), i AS (" + ORACLES["incidents"] + """)
SELECT count(*) AS scenarios, count(*) FILTER (scenario IN (SELECT scenario FROM i)) AS detected, round(sum(true_positive) / nullif(sum(true_positive + false_negative), 0), 6) AS fault_active_recall,
  round(sum(true_positive) / nullif(sum(true_positive + false_positive), 0), 6) AS precision, round(sum(false_positive) / nullif(sum(normal_steps), 0), 6) AS false_alarm_rate_normal_time,
  round(median(latency_s / 3600), 6) AS median_latency_hours, round(sum(recovery_fired) / nullif(sum(recovery_steps), 0), 6) AS recovery_firing_rate, round(avg(hit_at_1::INT), 6) AS hit_at_1,
  round(avg(hit_at_3::INT), 6) AS hit_at_3, round(avg(hit_at_5::INT), 6) AS hit_at_5, round(avg(hit_at_10::INT), 6) AS hit_at_10 FROM s JOIN h USING (scenario)""")
def evaluation_overall(spark, d):
    found = cut(detect.incidents(_members(spark, d)))
    active = spark.createDataFrame([(f"S{i}", fx.FAULT_START_S, fx.FAULT_END_S) for i in range(3)], "scenario string, begin_s long, end_s long")
    first = evaluate.scored_incident(found, active).select("scenario", F.explode("candidates").alias("c")).select("scenario", "c.position", "c.asset_id")
    hits = evaluate.hits_at(first, _manifest(spark).select("scenario", F.col("target_id").alias("asset_id")))
    fired = found.select("scenario", F.lit(True).alias("_f")).distinct()
    rows = evaluate.step_scores(fx.observed(spark, d), found).join(hits, "scenario").join(fired, "scenario", "left")
    return rounded(evaluate.overall(rows.withColumn("detected", F.coalesce("_f", F.lit(False)))))


@query("WITH " + INCIDENTS + """, e AS (SELECT i.scenario || '-' || i.incident_no AS incident, f.* FROM incidents i JOIN flagged f ON f.scenario = i.scenario
    AND f.timestamp_s >= i.detected_at_s - 43200 AND f.timestamp_s < i.detected_at_s
  WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.scenario = i.scenario AND c.incident_no = i.incident_no AND c.asset_id = f.asset_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY incident, asset_id ORDER BY score DESC, timestamp_s) AS k, min(timestamp_s) OVER (PARTITION BY incident, asset_id) AS first_seen_s FROM e)
SELECT incident, asset_id, parameter, round(score, 6) AS score, round(residual, 6) AS residual, first_seen_s, timestamp_s AS peak_at_s, true AS early FROM k WHERE k = 1""")
def early_evidence(spark, d):
    """The strongest flag of each asset in the twelve hours before an incident that does not name it."""
    flagged, rows = _flagged_members(spark, d)
    heads = _heads(rows)
    named = rows.select(_incident(), "asset_id").distinct()
    return rounded(retrieval.early_alarms(named, heads, flagged, _building(flagged), retrieval.Retrieval(lookback_hours=12)))


@query("WITH " + INCIDENTS + """ SELECT DISTINCT i.scenario || '-' || i.incident_no AS incident, f.asset_id, f.parameter, f.timestamp_s, round(f.residual, 6) AS deviation, round(f.observed, 6) AS observed,
    round(f.expected, 6) AS expected FROM incidents i JOIN candidates c USING (scenario, incident_no)
  JOIN flagged f ON f.scenario = i.scenario AND f.asset_id = c.asset_id AND f.parameter = c.parameter AND f.timestamp_s BETWEEN i.detected_at_s - 43200 AND i.last_seen_s""")
def timelines(spark, d):
    flagged, rows = _flagged_members(spark, d)
    alarm_rows = rows.select(_incident(), "asset_id", "parameter").distinct()
    return rounded(retrieval.timelines(alarm_rows, flagged, _heads(rows), retrieval.Retrieval(lookback_hours=12)))


@query("WITH " + INCIDENTS + """, sensors AS (SELECT DISTINCT asset_id FROM obs WHERE parameter = 'pressure'),
al AS (SELECT scenario, incident_no, asset_id, residual FROM candidates WHERE parameter = 'pressure')
SELECT i.scenario || '-' || i.incident_no AS incident, round(median(coalesce(al.residual, 0)), 6) AS shift FROM incidents i CROSS JOIN sensors s
  LEFT JOIN al ON al.scenario = i.scenario AND al.incident_no = i.incident_no AND al.asset_id = s.asset_id GROUP BY ALL""")
def common_shift(spark, d):
    rows = detect.candidates(_members(spark, d)).withColumn("incident", _incident())
    return rounded(retrieval.common_shift(rows, _building(fx.observed(spark, d))))


@query("WITH " + READINGS + """, l AS (SELECT scenario, CAST(ceil(max(timestamp_s) / 432000) * 432000 AS BIGINT) AS last FROM obs GROUP BY scenario),
h AS (SELECT scenario, unnest(range(0, last + 1, 432000)) AS as_of_s FROM l)
SELECT scenario, as_of_s, count(*) AS known, max(timestamp_s) AS latest, round(avg(value), 6) AS mean_value FROM obs JOIN h USING (scenario) WHERE timestamp_s <= as_of_s GROUP BY ALL""")
def live_prefix(spark, d):
    rows = detect.as_of(fx.observed(spark, d), 432_000)
    return rounded(rows.groupBy("scenario", "as_of_s").agg(F.count(F.lit(1)).alias("known"), F.max("timestamp_s").alias("latest"), F.avg("value").alias("mean_value")))


@query("WITH " + ISLANDS + """ SELECT scenario, min(timestamp_s) AS start_timestamp_s, max(timestamp_s) AS end_timestamp_s, count(*) AS anomaly_record_count,
  round(max(abs_residual), 6) AS peak_abs_residual, string_agg(DISTINCT asset_id, '|' ORDER BY asset_id) AS affected_assets FROM evidence GROUP BY scenario, event_number""")
def session_events_batch(spark, d):
    return rounded(session_events(_detected(spark, d).where("is_anomaly"), fx.STEP_S))


# ---- scenarios and contracts


@query("WITH " + READINGS + """ SELECT scenario, CAST(ceil(timestamp_s / 86400) * 86400 AS BIGINT) AS timestamp_s, asset_id, asset_type, parameter,
  round(avg(CASE WHEN parameter = 'pressure' THEN greatest(value, 20) ELSE value END), 6) AS value FROM obs GROUP BY ALL""")
def report_means(spark, d):
    return rounded(scenarios.report_means(fx.observed(spark, d), 86_400, 20.0))


@query("WITH " + READINGS + """, w AS (SELECT * FROM (VALUES ('S0', 432000, 864000), ('S1', 864000, NULL), ('S2', 0, 1296000)) t(scenario, a, b))
SELECT scenario, CASE WHEN timestamp_s < a THEN 'normal' WHEN b IS NULL OR timestamp_s < b THEN 'fault_active' ELSE 'recovery' END AS state, count(*) AS n FROM obs JOIN w USING (scenario) GROUP BY ALL""")
def state_labels(spark, d):
    windows = spark.createDataFrame([("S0", 432_000, 864_000), ("S1", 864_000, None), ("S2", 0, 1_296_000)], "scenario string, start_s long, end_s long")
    return scenarios.label_states(fx.observed(spark, d), windows).groupBy("scenario", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'leak_N' || n_nationkey || printf('_sev%02d_t%02d_%02d', s, h, h + 6) AS scenario,
  'N' || n_nationkey AS target_id, s / 100.0::DOUBLE AS severity, CAST(h AS DOUBLE) AS start_hour, CAST(h + 6 AS DOUBLE) AS end_hour
  FROM nation, (SELECT unnest([25, 50, 100]) AS s), (SELECT unnest([2, 8]) AS h)""")
def scenario_matrix(spark, d):
    targets = fx.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("target_id"))
    rows = scenarios.matrix_from(targets, [0.25, 0.5, 1.0], [2.0, 8.0], 6.0, "leak")
    return rows.drop("fault_type")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rounded(contracts.duplicate_keys(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]))


@query("WITH " + READINGS + """ SELECT count(*) AS row_count, count(*) FILTER (timestamp_s IS NULL) AS null_timestamp_s, count(*) FILTER (asset_id IS NULL) AS null_asset_id,
  count(*) FILTER (value IS NULL OR isnan(value)) AS null_value, count(*) FILTER (parameter NOT IN ('pressure', 'demand', 'flowrate')) AS unknown_parameter,
  CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM obs GROUP BY timestamp_s, asset_id, asset_type, parameter HAVING count(*) > 1)) AS BIGINT) AS duplicate_key_rows FROM obs""")
def contract_report(spark, d):
    return contracts.violations(fx.observed(spark, d), KEY, ["timestamp_s", "asset_id", "value"])


@query("""SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS keys, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS without FROM events GROUP BY event_type""")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k")
    return fx.table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("keys"), F.count_if(k.isNull()).alias("without"))


@query("""WITH t AS (SELECT event_type AS grp, CAST(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM events GROUP BY event_type),
x AS (SELECT *, hits / n AS p, 1.96 * 1.96 AS zz FROM t)
SELECT grp, hits, n, round(greatest((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 0), 6) AS low,
  round(least((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 1), 6) AS high FROM x""")
def wilson_interval(spark, d):
    rows = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("grp")).agg(F.count_if(F.expr("value > 60")).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return rounded(rows.withColumns({"low": low, "high": high}))


@query("WITH " + READINGS + """, v AS (SELECT parameter, list(value ORDER BY value) AS v FROM obs GROUP BY parameter)
SELECT parameter, round(v[CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT) + 1], 6) AS value FROM v""")
def nearest_rank_percentile(spark, d):
    return rounded(evaluate.nearest_rank(fx.observed(spark, d), ["parameter"], "value", 0.95))


@query("WITH " + DETECTED + """, c AS (SELECT scenario, severity, count(*) AS n FROM detected GROUP BY ALL) SELECT scenario, severity AS most_frequent FROM c QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY n DESC, severity) = 1""")
def severity_mode(spark, d):
    return tabular.most_frequent(_detected(spark, d), ["scenario"], "severity")


@query("""WITH v AS (SELECT l_returnflag, l_linestatus, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL)
SELECT l_returnflag, l_linestatus, CAST(len(v) AS BIGINT) AS n, round(quantile_cont_list[1], 6) AS p01, round(quantile_cont_list[2], 6) AS p50, round(quantile_cont_list[3], 6) AS p999 FROM (
  SELECT *, list_transform([0.01, 0.5, 0.999], lambda p: v[CAST(floor(p * (len(v) - 1)) AS BIGINT) + 1] * (1 - (p * (len(v) - 1) - floor(p * (len(v) - 1)))) + v[CAST(ceil(p * (len(v) - 1)) AS BIGINT) + 1] * (p * (len(v) - 1) - floor(p * (len(v) - 1)))) AS quantile_cont_list FROM v)""")
def price_quantiles(spark, d):
    """Quantiles of all order lines' prices in a few large groups, by narrowing ranges."""
    by = ["l_returnflag", "l_linestatus"]
    q = quantiles(fx.table(spark, d, "lineitem"), by, "l_extendedprice", (0.01, 0.5, 0.999), whole=1000)
    return rounded(q.select(*by, "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("p01", "p50", "p999")))))


@query("WITH RECURSIVE " + TREE + """, own AS (SELECT CAST(c_nationkey % 5 AS VARCHAR) AS incident, 'C' || c_custkey AS asset FROM customer WHERE c_acctbal > 0
  UNION SELECT CAST(c_nationkey % 5 AS VARCHAR), 'N' || c_nationkey FROM customer UNION SELECT CAST(c_nationkey % 5 AS VARCHAR), 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3
  UNION SELECT CAST(c_nationkey % 5 AS VARCHAR), 'O' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
arcs AS (SELECT a.incident, child, parent FROM tree JOIN own a ON a.asset = child JOIN own b ON b.asset = parent AND b.incident = a.incident),
closure AS (SELECT incident, child AS ancestor, child AS descendant, 0 AS distance FROM arcs UNION ALL SELECT c.incident, a.parent, c.descendant, c.distance + 1 FROM closure c JOIN arcs a ON a.child = c.ancestor AND a.incident = c.incident)
SELECT incident, ancestor, count(*) AS below, CAST(max(distance) AS BIGINT) AS farthest FROM closure GROUP BY ALL""")
def parted_closure(spark, d):
    """Closures inside parts of the supply tree that fall apart, each part by itself: what each asset feeds there, and how far below."""
    rows = fx.table(spark, d, "customer").join(fx.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = fx.table(spark, d, "orders").join(rows, F.col("o_custkey") == F.col("c_custkey"))
    incident = (F.col("c_nationkey") % 5).cast("string").alias("incident")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("asset")
    own = rows.where("c_acctbal > 0").select(incident, text("C", "c_custkey")).union(rows.select(incident, text("N", "c_nationkey"))).union(
        rows.where("n_regionkey < 3").select(incident, text("R", "n_regionkey"))).union(orders.select(incident, text("O", "o_orderkey"))).distinct()
    tree = fx.supply_tree(spark, d)
    arcs = tree.join(own.withColumnRenamed("asset", "child"), "child").join(own.withColumnRenamed("asset", "parent"), ["incident", "parent"])
    closure = graph.supply_closure(arcs.select("incident", "child", "parent"), by=["incident"])
    return rounded(closure.groupBy("incident", "ancestor").agg(F.count(F.lit(1)).alias("below"), F.max("distance").alias("farthest")))


# ---- graphs


@query("WITH " + LINKS + """, n AS (SELECT a AS node FROM links UNION SELECT b FROM links) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM links) AS links""")
def topology_counts(spark, d):
    links = fx.multigraph(spark, d)
    nodes = links.select(F.explode(F.array("start", "end")).alias("asset_id")).distinct()
    return graph.topology_size(nodes, links)


@query("WITH RECURSIVE " + TREE + """, up AS (SELECT child AS node, parent AS top FROM tree UNION ALL SELECT u.node, t.parent FROM up u JOIN tree t ON t.child = u.top)
SELECT (SELECT count(DISTINCT child) + 1 FROM tree) AS nodes, CAST(1 AS BIGINT) AS components, (SELECT count(*) FROM tree) AS links, true AS connected""")
def topology_summary(spark, d):
    tree = fx.supply_tree(spark, d)
    edges = tree.select(F.col("child").alias("asset_id"), F.col("parent").alias("start"), F.col("child").alias("end"))
    nodes = tree.select("child").union(tree.select("parent")).distinct().withColumnRenamed("child", "asset_id")
    return graph.topology_summary(nodes, edges)


@query("WITH RECURSIVE " + LINKS + """, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
w AS (SELECT node, 0 AS hops FROM seed UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 3)
SELECT (SELECT node FROM seed) AS seed, node, CAST(min(hops) AS BIGINT) AS hops FROM w GROUP BY node HAVING min(hops) > 0""")
def khop_neighbours(spark, d):
    links = fx.multigraph(spark, d)
    return rounded(graph.neighbours(links, fx.first_part(links), 3))


@query("WITH RECURSIVE " + LINKS + """, e AS (SELECT DISTINCT CASE WHEN flow >= 0 THEN a ELSE b END AS a, CASE WHEN flow >= 0 THEN b ELSE a END AS b FROM links),
w AS (SELECT a AS seed, a AS node, 0 AS hops FROM e UNION SELECT w.seed, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 4)
SELECT seed, node, CAST(min(hops) AS BIGINT) AS hops FROM w WHERE node <> seed GROUP BY seed, node""")
def flow_reachability(spark, d):
    arcs = graph.directed(graph.oriented(fx.multigraph(spark, d)))
    return rounded(graph.downstream(arcs, arcs.select(F.col("src").alias("node")), 4))


@query("WITH " + LINKS + " SELECT a AS start, b AS \"end\", flow AS flowrate, CASE WHEN flow >= 0 THEN a ELSE b END AS flow_from, CASE WHEN flow >= 0 THEN b ELSE a END AS flow_to FROM links")
def flow_orientation(spark, d):
    return graph.oriented(fx.multigraph(spark, d)).drop("asset_id")


@query("WITH " + READINGS + """ SELECT scenario, timestamp_s, asset_type, asset_id, round(max(value) FILTER (parameter = 'pressure'), 6) AS pressure, round(max(value) FILTER (parameter = 'demand'), 6) AS demand,
  round(max(value) FILTER (parameter = 'flowrate'), 6) AS flowrate FROM obs GROUP BY ALL""")
def snapshot_pivot(spark, d):
    return rounded(graph.snapshot_values(fx.observed(spark, d), ("pressure", "demand", "flowrate"), ["scenario"]))


@query(CLOSURE + " SELECT * FROM closure")
def supply_closure(spark, d):
    return rounded(graph.supply_closure(fx.supply_tree(spark, d)))


@query(CLOSURE + """ SELECT descendant AS node, string_agg(ancestor, '>' ORDER BY distance) AS path, max(distance) AS depth FROM closure
  WHERE descendant IN (SELECT 'O' || o_orderkey FROM orders) GROUP BY descendant""")
def upstream_path(spark, d):
    nodes = fx.table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node"))
    return rounded(graph.upstream_path(fx.supply_tree(spark, d), nodes))


@query(CLOSURE + " SELECT ancestor AS node, descendant, distance FROM closure WHERE ancestor IN ('N3', 'N7', 'C10') AND distance > 0")
def downstream_set(spark, d):
    nodes = spark.createDataFrame([("N3",), ("N7",), ("C10",)], "node string")
    return rounded(graph.downstream_set(fx.supply_tree(spark, d), nodes))


def _tree_groups(spark, d):
    """Orders and customers of one customer, one nation, one region or one market segment, so that points of every depth are common."""
    customers = fx.table(spark, d, "customer").join(fx.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = fx.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by = F.col("o_custkey") % 4
    text = lambda prefix, *cols: F.concat(F.lit(prefix), *(F.col(c).cast("string") for c in cols))
    grp = F.when(by == 0, text("c", "o_custkey")).when(by == 1, text("n", "c_nationkey")).when(by == 2, text("r", "n_regionkey", "o_orderpriority")).otherwise(text("s", "c_mktsegment"))
    rows = rows.select("o_orderkey", "c_custkey", grp.alias("grp"))
    return rows.select("grp", text("O", "o_orderkey").alias("member")).union(rows.where("o_orderkey % 3 = 0").select("grp", text("C", "c_custkey")))


TREE_GROUPS = """grouped AS (SELECT o_orderkey, c_custkey, c_nationkey, n_regionkey, CASE o_custkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'n' || c_nationkey WHEN 2 THEN 'r' || n_regionkey || o_orderpriority ELSE 's' || c_mktsegment END AS grp
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
members AS (SELECT DISTINCT grp, 'O' || o_orderkey AS member FROM grouped UNION SELECT grp, 'C' || c_custkey FROM grouped WHERE o_orderkey % 3 = 0)"""


@query(CLOSURE + ", " + TREE_GROUPS + """,
sizes AS (SELECT grp, count(*) AS n FROM members GROUP BY grp),
shared AS (SELECT m.grp, c.ancestor, sum(c.distance) AS total FROM members m JOIN closure c ON c.descendant = m.member JOIN sizes s ON s.grp = m.grp GROUP BY m.grp, c.ancestor, s.n HAVING count(*) = s.n)
SELECT grp, arg_min(ancestor, total) AS common FROM shared GROUP BY grp""")
def common_supply_point(spark, d):
    return graph.common_supply_point(fx.supply_tree(spark, d), _tree_groups(spark, d))


@query(CLOSURE + ", " + TREE_GROUPS + """
SELECT m.grp, m.member FROM members m WHERE NOT EXISTS (SELECT 1 FROM members o JOIN closure c ON c.descendant = o.member AND c.distance > 0 WHERE o.grp = m.grp AND c.ancestor = m.member)""")
def deepest_members(spark, d):
    return graph.deepest(fx.supply_tree(spark, d), _tree_groups(spark, d))


@query(CLOSURE + """, numbered AS (SELECT ancestor AS node, count(*) AS size FROM closure GROUP BY ancestor), up AS (SELECT descendant AS node, max(distance) AS depth FROM closure GROUP BY descendant)
SELECT up.node, coalesce(t.parent, '') AS parent, up.depth, coalesce(size, 1) AS size FROM up LEFT JOIN tree t ON t.child = up.node LEFT JOIN numbered n ON n.node = up.node""")
def tree_intervals(spark, d):
    """Depth and subtree size of every node below the root, from the labels."""
    nodes = graph.tree_labels(fx.supply_tree(spark, d)).nodes.where("depth > 0")
    return rounded(nodes.select("node", "parent", "depth", (F.col("last") - F.col("pre") + 1).alias("size")))


@query("WITH " + TREE + """ SELECT parent AS subject, 'FEEDS' AS relation, parent || '-' || child AS object FROM tree
  UNION ALL SELECT parent || '-' || child, 'FEEDS', child FROM tree
  UNION ALL SELECT 'C' || c_custkey, 'LOCATED_IN', CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'flat:' || c_mktsegment END FROM customer
  UNION ALL SELECT DISTINCT 'flat:' || c_mktsegment, 'PART_OF', 'building' FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'SENSOR' || s_suppkey, 'MONITORS', 'C' || s_suppkey FROM supplier""")
def triples_export(spark, d):
    return _triples(spark, d, fx.supply_tree(spark, d))


def _triples(spark, d, tree):
    tree = tree.withColumn("link", F.concat_ws("-", "parent", "child"))
    none = F.lit(None).cast("string")
    flat = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    assets = fx.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("asset_id"), none.alias("room"), flat.alias("flat"), F.lit(None).cast("int").alias("floor"))
    sensors = fx.table(spark, d, "supplier").select(F.concat(F.lit("SENSOR"), F.col("s_suppkey").cast("string")).alias("sensor_id"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("asset_id"))
    return graph.triples(tree, assets, sensors)


# ---- nested results, checked by tests


@query()
def incidents_json(spark, d):
    rows = detect.incidents(_members(spark, d))
    return rows.select("scenario", "incident_no", F.to_json(F.struct("detected_at_s", "last_seen_s", "event_count", "parameters", "epicenter", "candidates")).alias("incident"))


@query("WITH " + DETECTED + """ SELECT scenario, CAST(max(CASE severity WHEN 'normal' THEN 0 WHEN 'anomaly' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 END) AS BIGINT) AS peak_rank,
  count(*) FILTER (is_anomaly) AS anomalies FROM detected GROUP BY scenario""")
def peak_severity_by_scenario(spark, d):
    top = F.max(severity_rank(F.col("severity")))
    return _detected(spark, d).groupBy("scenario").agg(top.cast("long").alias("peak_rank"), F.count_if("is_anomaly").alias("anomalies"))


def _tree_building(spark: SparkSession, d: str) -> retrieval.Building:
    """The supply tree down to nations as a building: a pressure sensor for each nation, and below each nation a branch with a flow sensor and a tap."""
    tree = fx.supply_tree(spark, d).where("child LIKE 'R%' OR child LIKE 'N%'")
    number = F.col("n_nationkey").cast("string")
    branches = fx.table(spark, d, "nation").select(F.explode(F.array(*(F.struct(F.concat(F.lit(c), number).alias("child"), F.concat(F.lit(p), number).alias("parent")) for c, p in (("B", "N"), ("T", "B"))))).alias("x")).select("x.*")
    tree = tree.select("child", "parent").union(branches)
    first = F.substring("child", 1, 1)
    none = F.lit(None).cast("string")

    def by_first(**values):
        out = F.lit(None).cast("string")
        for k, v in values.items():
            out = F.when(first == k, v).otherwise(out)
        return out

    own = tree.select(
        F.col("child").alias("asset_id"), by_first(R="pipe", N="junction", B="pipe", T="junction").alias("kind"), by_first(R="downtake", N="flat_inlet", B="room_branch", T="fixture").alias("role"),
        F.col("child").alias("label"), none.alias("room"), F.concat(F.lit("N"), F.when(first != "R", F.substring("child", 2, 9))).alias("flat"), F.lit(0).alias("floor"))
    root = spark.createDataFrame([("WORLD", "reservoir", "source", "WORLD", None, None, 0)], own.schema)
    sensors = tree.where("child LIKE 'N%' OR child LIKE 'B%'").select(
        F.concat(F.lit("s"), "child").alias("sensor_id"), F.col("child").alias("asset_id"), F.when(first == "N", "pressure").otherwise("flowrate").alias("parameter"))
    return retrieval.Building(own.union(root), tree, sensors)


def _placed(df: DataFrame) -> DataFrame:
    """Pressures at the nation, and flows at the branch, of the asset's number."""
    number = F.substring("asset_id", 2, 2).cast("int").cast("string")
    return df.where("parameter IN ('pressure', 'flowrate')").withColumn("asset_id", F.concat(F.when(F.col("parameter") == "pressure", "N").otherwise("B"), number))


def _case(spark: SparkSession, d: str) -> day.Evidence:
    """The evidence of all incidents of the placed readings."""
    observed = _placed(_observed(spark, d))
    flagged = detect.flag(detect.residual_scores(observed, _placed(fx.expected(spark, d)), BY), 1.5)
    return day.evidence(observed, flagged, _tree_building(spark, d))


@query()
def evidence_packets(spark, d):
    return _case(spark, d).packets


@query()
def diagnoses(spark, d):
    """What the packets give by themselves."""
    out = diagnosis.diagnose(diagnosis.from_packets(_case(spark, d).packets))
    return out.withColumn("alternatives", F.to_json("alternatives"))


@query()
def day_diagnoses(spark, d):
    """Every incident of the placed readings, with packet and diagnosis."""
    return day.run(_placed(_observed(spark, d)), _placed(fx.expected(spark, d)), _tree_building(spark, d), 1.5, by=BY)


@query()
def live_diagnoses(spark, d):
    """The same as known every five days."""
    return day.run_live(_placed(_observed(spark, d)), _placed(fx.expected(spark, d)), _tree_building(spark, d), 432_000, 1.5, by=BY)
