import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillflow.operators import contracts, evaluate, graph, scenarios, tabular
from rillflow.plans import registry
from tests.test_oracles import compare


def test_evidence_without_a_label_fails_in_the_plan(spark):
    rows = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "event_id string, x int")
    labels = spark.createDataFrame([("e1", "primary")], "event_id string, evaluation_label string")
    assert [r.evaluation_label for r in tabular.label_evidence(rows.where("event_id = 'e1'"), labels).collect()] == ["primary"] * 2
    with pytest.raises(PySparkException, match="no evaluation label for event e2"):
        tabular.label_evidence(rows, labels).collect()


def test_most_frequent_takes_the_least_at_ties_and_no_nulls(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("a", None), ("a", None), ("b", "z"), ("c", None)], "g string, v string")
    assert {(r.g, r.most_frequent) for r in tabular.most_frequent(rows, ["g"], "v").collect()} == {("a", "x"), ("b", "z")}


def test_leaks_name_the_tokens(spark):
    rows = spark.createDataFrame([(1, "the LEAK is at A1"), (2, "nothing"), (3, None)], "i int, text string")
    assert [(r.i, r.tokens) for r in contracts.leaks(rows, "text", ["leak", "a1", "zz"]).collect()] == [(1, ["leak", "a1"])]


def test_targets_must_suit_their_fault(spark):
    v = spark.createDataFrame([("J", "junction"), ("T", "tank")], "asset_id string, kind string")
    e = spark.createDataFrame([("P", "pipe"), ("U", "pump")], "asset_id string, kind string")
    s = spark.createDataFrame([("leak", "J"), ("leak", "T"), ("pump_failure", "U"), ("pump_failure", "P"), ("blockage", "P"), ("blockage", "J")], "fault_type string, target_id string")
    assert {tuple(r) for r in scenarios.check_targets(s, v, e).select("fault_type", "target_id").collect()} == {("leak", "T"), ("pump_failure", "P"), ("blockage", "J")}


def test_melt_and_leak_pattern(spark):
    wide = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 4.0)], "timestamp_s long, a double, b double")
    assert {tuple(r) for r in scenarios.melt(wide, "pressure").collect()} == {(0, "a", 1.0, "pressure"), (0, "b", None, "pressure"), (1, "a", 3.0, "pressure"), (1, "b", 4.0, "pressure")}
    gate = lambda *a: [r.gate for r in scenarios.leak_pattern(*a, spark).orderBy("timestamp_s").collect()]
    assert gate(2, 4, 5, 1) == [0, 0, 1, 1, 0, 0] and gate(2, None, 4, 1) == [0, 0, 1, 1, 1]


def test_triples_and_links_inside_a_part(spark):
    t = spark.createDataFrame([("a", "FEEDS", "b"), ("b", "FEEDS", "c"), ("c", "FEEDS", "d")], "subject string, relation string, object string")
    near = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {(r.subject, r.object) for r in graph.triples_within(t, near).collect()} == {("a", "b"), ("b", "c")}
    e = spark.createDataFrame([("l1", "a", "b"), ("l2", "c", "d")], "asset_id string, start string, end string")
    assert [r.asset_id for r in graph.neighbourhood_edges(e, near).collect()] == ["l1"]


def test_rooms_without_assets_are_places(spark):
    tree = spark.createDataFrame([("b", "a", "l")], "child string, parent string, link string")
    assets = spark.createDataFrame([("b", "K", "F1", 1)], "asset_id string, room string, flat string, floor int")
    sensors = spark.createDataFrame([("s", "b")], "sensor_id string, asset_id string")
    rooms = spark.createDataFrame([("K", "F1", 1), ("BATH", "F2", 1), (None, None, 2)], "room string, flat string, floor int")
    part = lambda *more: {(r.subject, r.object) for r in graph.triples(tree, assets, sensors, *more).where("relation = 'PART_OF'").collect()}
    assert part() == {("room:K", "flat:F1"), ("flat:F1", "floor:1"), ("floor:1", "building")}
    assert part(rooms) == part() | {("room:BATH", "flat:F2"), ("flat:F2", "floor:1"), ("floor:2", "building")}


def test_a_total_of_no_rows(spark, tmp_path):
    """Events whose two halves agree have no anomalies, and the SQL's total still is a row."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("value", F.lit(1.0)).write.parquet(f"{tmp_path}/events")
    rows = spark.read.parquet(f"{tmp_path}/events")
    rows.coalesce(1).toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    compare(spark, registry.QUERIES["events_all_and_by_phase"], registry.ORACLES["events_all_and_by_phase"], str(tmp_path))
    assert [tuple(r) for r in registry.QUERIES["events_all_and_by_phase"](spark, str(tmp_path)).collect()] == [("all", 0, None)]
    some = spark.createDataFrame([("all", 1), (None, 2), ("x", 3)], "k string, v long")
    got = [tuple(r) for r in evaluate.all_and_each(some, "k", n=F.count(F.lit(1)), s=F.sum("v")).collect()]
    assert sorted(got, key=str) == [("all", 1, 1), ("all", 3, 6), ("x", 1, 3), (None, 1, 2)]
