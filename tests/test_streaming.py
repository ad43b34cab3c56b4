from pyspark.sql import functions as F

from rillflow.operators import tabular
from rillflow.streaming import sessions

DDL = "scenario string, timestamp_s long, asset_id string, asset_type string, parameter string, value double, abs_residual double"


def feed(spark, tmp_path, batches, ddl):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.createDataFrame([], ddl).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def anomalies():
    times = [0, 3600, 7200, 20000, 23000, 90000]
    return [("s", t, f"a{t % 7}", "node", "pressure", 1.0, float(t % 11)) for t in times] + [("r", 100, "b", "node", "pressure", 1.0, 2.0), ("r", 200_000, "b", "node", "pressure", 1.0, 2.0)]


def test_sessions_equal_islands(spark, tmp_path):
    rows = spark.createDataFrame(anomalies(), DDL)
    batch = {(r.scenario, r.start_timestamp_s, r.end_timestamp_s, r.anomaly_record_count) for r in sessions.session_events(rows, 3600).collect()}
    isl = rows.join(tabular.islands(rows, 3600), ["scenario", "timestamp_s"]).groupBy("scenario", "event_number").agg(
        F.min("timestamp_s").alias("a"), F.max("timestamp_s").alias("b"), F.count(F.lit(1)).alias("n"))
    assert batch == {(r.scenario, r.a, r.b, r.n) for r in isl.collect()}
    stream = feed(spark, tmp_path, [anomalies()[:3], anomalies()[3:]], DDL)
    got = drain(sessions.session_events(stream, 3600, "1 hour"), "sess")
    done = {(r.scenario, r.start_timestamp_s, r.end_timestamp_s, r.anomaly_record_count) for r in got.collect()}
    assert done <= batch and ("s", 0, 7200, 3) in done and ("s", 90000, 90000, 1) in done


def test_report_means_stream(spark, tmp_path):
    rows = [("s", t, "a", "node", "pressure", float(t), 0.0) for t in (0, 1800, 3600, 3601, 7200, 40_000)]
    got = drain(sessions.report_means(feed(spark, tmp_path, [rows], DDL), 3600, "1 hour"), "means")
    assert {r.timestamp_s: r.value for r in got.collect()} == {0: 0.0, 3600: 2700.0, 7200: 5400.5}


def test_incident_stream(spark, tmp_path):
    ddl = "scenario string, timestamp_s long, positive boolean"
    steps = [("s", h * 3600, h in (2, 3, 6)) for h in range(10)]
    batches = [steps[:4], list(reversed(steps[4:8])), steps[8:], [("s", 40 * 3600, False)], [("s", 80 * 3600, False)]]
    got = drain(sessions.stream_incidents(feed(spark, tmp_path, batches, ddl)), "inc")
    assert {tuple(r) for r in got.collect()} == {("s", 7200, 10800, 2), ("s", 21600, 21600, 1)}


def test_changes_are_announced_once(spark, tmp_path):
    ddl = "scenario string, as_of_s long, root string, confidence double, severity string"
    rows = [("s", 1, "A", 0.5, "warning"), ("s", 2, "A", 0.5, "warning"), ("s", 3, "A", 0.7, "warning"), ("r", 3, "B", 0.6, "critical"), ("s", 4, "C", 0.7, "critical"), ("s", 5, "C", 0.7, "critical")]
    got = drain(sessions.stream_changes(feed(spark, tmp_path, [rows[:2], rows[2:5], rows[5:]], ddl)), "chg")
    assert {(r.scenario, r.as_of_s, r.kind, r.root) for r in got.collect()} == {("s", 1, "ALERT", "A"), ("s", 3, "UPDATE", "A"), ("r", 3, "ALERT", "B"), ("s", 4, "UPDATE", "C")}
