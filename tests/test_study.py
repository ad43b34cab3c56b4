from pyspark.sql import functions as F

from rillflow.__main__ import main
from rillflow.plans import study
from tests.test_operators import SPEC, frame


def test_seed_study(spark):
    drop = {t: -9.0 for t in (5, 6)}
    rows = frame(spark, {100: drop, 101: drop}, "leak").union(frame(spark, scenario="normal"))
    every = frame(spark).select("asset_id", "parameter").distinct()
    layouts = {"full": every, "few": every.where("asset_id > '104'")}
    truth = spark.createDataFrame([("leak", "101")], "scenario string, target_id string")
    runs, table = study.seed_study(rows, frame(spark), truth, layouts, [1, 2, 3], SPEC)
    got = {r.layout: (r.seeds, r.detected, r.detected_sd, r.hit_at_3, r.false_alarms) for r in table.collect()}
    assert got == {"full": (3, 1.0, 0.0, 1.0, 0), "few": (3, 0.0, 0.0, 0.0, 0)} and runs.count() == 12


def test_batch_problems_and_counts(spark):
    good = frame(spark, scenario="a").withColumn("state", F.when(F.col("timestamp_s") < 7200, "normal").when(F.col("timestamp_s") < 10800, "fault_active").otherwise("recovery"))
    bad = good.where("timestamp_s <> 3600").withColumn("scenario", F.lit("b"))
    m = spark.createDataFrame([(n, "leak", "1", 2.0, 3.0) for n in "abc"], "scenario string, fault_type string, target_id string, start_hour double, end_hour double")
    got = {r.scenario: r.problems for r in study.batch_problems(good.union(bad), m, 250, 86400, 3600).collect()}
    assert got == {"b": ["240 rows", "time steps are missing"], "c": ["missing"]}
    counts = {r.fault_type: r.scenarios for r in study.matrix_counts(m, "x").collect()}
    assert counts == {"all": 3, "leak": 3}
    live = spark.createDataFrame([("s", 1, None), ("s", 2, "A"), ("s", 3, "A"), ("s", 4, "B"), ("s", 5, "A")], "scenario string, as_of_s long, incident string")
    assert [r.as_of_s for r in study.incident_snapshots(live).orderBy("as_of_s").collect()] == [1, 2, 4, 5]


def test_command_line(spark, tmp_path):
    drop = {t: -9.0 for t in (5, 6)}
    for name, df in (("base", frame(spark, scenario="normal")), ("s1", frame(spark, {100: drop, 101: drop, 102: drop}, "s1"))):
        df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}")
    main(["detect", f"{tmp_path}/base", f"{tmp_path}/s1", f"{tmp_path}/out", "--no-noise"])
    rows = {r.scenario: r for r in spark.read.option("header", True).csv(f"{tmp_path}/out/summary").collect()}
    assert rows["normal"].incident_count == "0" and rows["s1"].top_candidates == "100|101|102"
    main(["events", f"{tmp_path}/base", f"{tmp_path}/s1", f"{tmp_path}/ev"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/ev/events").first().affected_assets == "100|101|102"
