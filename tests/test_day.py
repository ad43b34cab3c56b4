import json

import pytest
from pyspark.sql import functions as F
from tests.test_diagnosis import building  # noqa: F401  the small building

from rillflow.__main__ import main
from rillflow.operators import building as plan
from rillflow.operators import contracts, day, detect, evaluate, retrieval

NORMAL = {("BA", "flowrate"): 1e-4, ("BB", "flowrate"): 1e-4, ("OUT", "flowrate"): 7.2e-4, ("IA", "pressure"): 20.0, ("IB", "pressure"): 21.0, ("ROOF", "pressure"): 2.5, ("PUMP", "flowrate"): 1e-3}


def readings(spark, scenario, changed, hours=12):
    """changed: (asset, parameter, hour) -> value; everything else as normal."""
    rows = [(h * 3600, a, "node", p, changed.get((a, p, h), v), scenario, "normal") for h in range(hours) for (a, p), v in NORMAL.items()]
    return spark.createDataFrame(rows, "timestamp_s long, asset_id string, asset_type string, parameter string, value double, scenario string, state string")


@pytest.fixture(scope="module")
def days(spark):
    leak = {("BA", "flowrate", h): 3e-4 for h in (8, 9)} | {("OUT", "flowrate", h): 9.2e-4 for h in (8, 9)}
    cut_off = {(a, "pressure", h): 0.2 for a in ("IA",) for h in (6, 7)} | {("BA", "flowrate", h): 0.0 for h in (6, 7)}
    return readings(spark, "leak_BA", leak).union(readings(spark, "blockage_VA", cut_off)).union(readings(spark, "quiet", {})), readings(spark, "normal", {})


def test_a_day_is_diagnosed_scenario_by_scenario(spark, building, days):  # noqa: F811
    rows, base = days
    seen = day.building_observed(rows, building, noise=False)
    got = {r.scenario: r for r in day.run(seen, base, building).collect()}
    assert set(got) == {"leak_BA", "blockage_VA"}
    leak = json.loads(got["leak_BA"].diagnosis)
    assert (leak["root_cause_asset"], leak["severity"], got["leak_BA"].first_alarm_hour, got["leak_BA"].last_alarm_hour) == ("KA", "critical", 8, 9)
    assert leak["summary"] == "Since 08:00 about 720 litres an hour more than expected flow at KA. A burst or an open fixture is likely."
    assert json.loads(got["blockage_VA"].diagnosis)["root_cause_asset"] == "VA" and got["blockage_VA"].grounded and got["leak_BA"].grounded
    packet = json.loads(got["leak_BA"].packet)
    assert packet["incident"]["id"] == "INC-1" and packet["building"] == "building" and "leak_BA" not in got["leak_BA"].packet
    assert packet["topology_facts"]["extra_flow"] == {"deepest_assets_with_extra_flow": ["BA"], "supplied_through_them": ["KA"]}
    alarm = next(o for o in packet["observations"] if o["asset"] == "BA")
    assert (alarm["sensor"], alarm["observed_at_peak"], alarm["expected_at_peak"], alarm["reading"]) == ("sensor:s3", 0.3, 0.1, "peak 0.200 L/s above expectation at 08:00")
    assert {a["asset_id"]: a["metered"] for a in packet["assets"]}["BA"]
    loss = json.loads(got["blockage_VA"].packet)["topology_facts"]["pressure_loss"]
    assert (loss["common_supply_point"], loss["suspect_span_upward"], loss["nearest_upstream_point_still_feeding_a_healthy_sensor"]) == ("IA", ["IA", "VA"], "T1")


def test_a_replay_knows_only_the_past_and_ends_as_the_day(spark, building, days):  # noqa: F811
    rows, base = days
    seen = day.building_observed(rows, building, seed=3)
    live = day.run_live(seen, base, building).collect()
    whole = {(r.incident, r.diagnosis, r.packet) for r in day.run(seen, base, building).collect()}
    last = max(r.as_of_s for r in live)
    assert last == 11 * 3600 and {(r.incident, r.diagnosis, r.packet) for r in live if r.as_of_s == last} == whole
    assert all(r.last_alarm_hour * 3600 <= r.as_of_s for r in live)
    assert min(r.as_of_s for r in live if r.scenario == "leak_BA") == 8 * 3600
    early = readings(spark, "leak_BA", {("BA", "flowrate", h): 3e-4 for h in (8, 9)} | {("OUT", "flowrate", h): 9.2e-4 for h in (8, 9)}, hours=9)
    alone = day.run(day.building_observed(early, building, seed=3), base, building).first()
    assert alone.packet == next(r.packet for r in live if r.scenario == "leak_BA" and r.as_of_s == 8 * 3600)


def test_no_incident_gives_no_row(spark, building, days):  # noqa: F811
    rows, base = days
    quiet = day.building_observed(rows.where("scenario = 'quiet'"), building, noise=False)
    assert day.run(quiet, base, building).count() == 0 and day.run_live(quiet, base, building).count() == 0


def test_early_flags_facts_and_retrieval_scores(spark, building, days):  # noqa: F811
    changed = {("PUMP", "flowrate", 4): 0.0} | {("ROOF", "pressure", h): 0.5 for h in (6, 7)} | {("OUT", "flowrate", h): 5e-4 for h in (6, 7)}
    seen = day.building_observed(readings(spark, "pump_1", changed), building, noise=False)
    flagged = detect.flag(detect.residual_scores(seen, days[1]))
    found = day.evidence(seen, flagged, building)
    packet = json.loads(found.packets.first().packet)
    assert {o["asset"] for o in packet["observations"] if o["status"] == "alarm (before the incident)"} == {"PUMP"}
    assert packet["topology_facts"]["tank_level_change"] == {"ROOF": "2.00 m below expectation"}
    assert packet["topology_facts"]["low_tank_supply_chain"] == {"ROOF": ["ROOF", "PUMP"]} and "extra_flow" not in packet["topology_facts"]
    truth = spark.createDataFrame([("pump_1-1", "PUMP")], "incident string, target_id string")
    score = day.retrieval_scores(found, truth, building).first()
    assert score.target_in_packet and score.target_at_focus and score.focus == "PUMP ROOF" and score.assets == len(packet["assets"])
    assert json.loads(day.diagnosed(found, building).first().diagnosis)["fault_type"] == "pump_failure"


def test_instruments_of_the_building(spark, building, days):  # noqa: F811
    demand = days[1].withColumn("parameter", F.lit("demand")).unionByName(days[1]).unionByName(days[1].withColumn("asset_id", F.lit("XX")))
    seen = day.building_observed(demand, building, seed=1)
    assert {(r.asset_id, r.parameter) for r in seen.collect()} == set(NORMAL) and seen.where("abs(value - truth) > 6 * noise_std").count() == 0
    assert {(r.asset_id, r.sensor_id) for r in day.sensor_readings(seen, building).collect()} == {("BA", "s3"), ("BB", "s4"), ("IA", "s1"), ("IB", "s2"), ("OUT", "s9"), ("PUMP", "s6"), ("ROOF", "s5")}
    flagged = spark.createDataFrame([("s", 2, 5.0, "a", "p"), ("s", 1, 4.0, "a", "p"), ("s", 1, 9.0, "b", "p")], "scenario string, timestamp_s int, score double, asset_id string, parameter string")
    assert [r.score for r in detect.in_order(flagged).collect()] == [9.0, 4.0, 5.0]


def test_overall_rates(spark):
    ddl = ("scenario string, fault_type string, detected boolean, true_positive long, false_negative long, false_positive long, recovery_fired long, normal_steps long, recovery_steps long, "
           "latency_s long, hit_at_1 boolean")
    rows = spark.createDataFrame([("a", "leak", True, 3, 1, 1, 2, 10, 4, 3600, True), ("b", "pump", False, 0, 4, 0, 0, 10, 4, None, False)], ddl)
    control = spark.createDataFrame([("normal", 1, 20, True)], "scenario string, false_positive long, normal_steps long, fired boolean")
    r = evaluate.overall(rows, control, (1,)).first()
    assert (r.scenarios, r.detected, r.fault_active_recall, r.precision, r.false_alarm_rate_normal_time, r.recovery_firing_rate, r.median_latency_hours, r.hit_at_1) == (2, 1, 0.375, 0.6, 0.05, 0.25, 1.0, 0.5)
    assert r.baseline_control_clean is False
    by = {x.fault_type: x for x in evaluate.overall(rows, None, (1,), "fault_type").collect()}
    assert (by["leak"].fault_active_recall, by["pump"].precision, by["all"].precision) == (0.75, None, 0.75)
    text = evaluate.report_text(evaluate.overall(rows.limit(0), None, (1,))).first().report
    assert "Scenarios with an incident: 0 of 0" in text and "Precision against normal time: n/a" in text and len(text.split("\n")) == 7


def test_contracts_of_events_and_types(spark):
    ddl = "timestamp_s long, asset_id string, asset_type string, parameter string, scenario string, state string, severity string, is_anomaly boolean, abs_residual double"
    row = (0, "a", "node", "pressure", "s", "normal", "warning", True, 1.0)
    assert contracts.check_detected(spark.createDataFrame([row], ddl)).count() == 1
    for rule, rows in (("empty", []), ("severities", [row[:6] + ("bad", True, 1.0)]), ("nulls", [(None, *row[1:])]), ("nulls", [row[:4] + (None,) + row[5:]])):
        with pytest.raises(contracts.ContractError) as e:
            contracts.check_detected(spark.createDataFrame(rows, ddl))
        assert e.value.rule == rule
    values = spark.createDataFrame([("x", None), ("x", "1"), (None, "2")], "a string, b string")
    assert contracts.single_optional(values, "a") == "x" and contracts.single_optional(values, "none") is None
    with pytest.raises(contracts.ContractError, match="1, 2"):
        contracts.single_optional(values, "b")
    types = spark.createDataFrame([(" Pipe ",), ("TANK",)], "kind string")
    assert {r.kind for r in contracts.asset_types(types, "kind", ("pipe", "tank")).collect()} == {"pipe", "tank"}
    with pytest.raises(contracts.ContractError, match="tank"):
        contracts.asset_types(types, "kind", ("pipe",))


def test_commands(spark, tmp_path):
    net = plan.generate(spark)
    plan.layout(net).write.text(str(tmp_path / "layout"))
    house = net.building()
    meters = [(r.asset_id, r.parameter) for r in house.sensors.collect()]
    leaf = next(a for a, p in meters if a == "F3A-KIT-BR")

    def csv(name, scenario):
        def value(a, p, h):
            v = 20.0 if p == "pressure" else 1e-4
            return v + 2e-4 if scenario != "normal" and p == "flowrate" and a in (leaf, "OHT-OUTLET") and 6 <= h < 9 else v

        rows = [(h * 3600, a, "node", p, value(a, p, h), scenario, "fault_active" if scenario != "normal" and 6 <= h < 9 else "normal") for h in range(10) for a, p in meters]
        ddl = "timestamp_s long, asset_id string, asset_type string, parameter string, value double, scenario string, state string"
        spark.createDataFrame(rows, ddl).write.option("header", True).csv(str(tmp_path / name))

    csv("base", "normal")
    csv("leak", "leak_K")
    (tmp_path / "m.csv").write_text(f"scenario_id,scenario,fault_type,target_id,severity,start_hour,end_hour,dataset_file,metadata_file,rows\n1,leak_K,leak,{leaf},0.1,6,9,leak,,1\n")
    args = [str(tmp_path / "base"), str(tmp_path / "leak"), str(tmp_path / "out"), "--no-noise", "--min-assets", "2", "--instruments", "building"]
    for command in ("packets", "diagnose", "replay"):
        main([command, *args, "--layout", str(tmp_path / "layout")])
    told = spark.read.json(str(tmp_path / "out/diagnose")).first()
    assert (told.scenario, told.first_alarm_hour, json.loads(told.diagnosis)["root_cause_asset"]) == ("leak_K", 6, "F3A-KIT")
    assert "diagnosis" not in spark.read.json(str(tmp_path / "out/packets")).columns
    assert spark.read.json(str(tmp_path / "out/replay")).agg(F.min("as_of_s")).first()[0] == 6 * 3600
    main(["evaluate", *args, "--manifest", str(tmp_path / "m.csv")])
    r = spark.read.json(str(tmp_path / "out/summary")).first()
    assert (r.scenarios, r.detected, r.fault_active_recall, r.precision, r.baseline_control_clean, r.hit_at_3) == (1, 1, 1.0, 1.0, True, 1.0)
    with pytest.raises(SystemExit):
        main(["diagnose", *args])
