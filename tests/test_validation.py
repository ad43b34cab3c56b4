import pytest
from pyspark.sql import functions as F

from rillflow.operators import building, detect, graph, tabular
from rillflow.schemas import READINGS_DDL
from rillflow.sources import network, tables

V = [("a", "junction", 1.0, 0.0, None, None, None, None, None, None, 0.0, 0.0), ("r", "reservoir", 9.0, None, None, 9.0, None, None, None, None, 0.0, 0.0),
     ("t", "tank", 5.0, None, None, None, 1.0, 0.0, 2.0, 3.0, 0.0, 0.0)]
E = [("p", "pipe", "r", "a", 10.0, 0.1, 100.0, "OPEN", None), ("q", "pipe", "a", "t", 10.0, 0.1, 100.0, "OPEN", None)]


def change(row, names, **new):
    return tuple(new.get(n, x) for n, x in zip(names, row))


VN = [f.split()[0] for f in network.VERTICES_DDL.split(", ")]
EN = [f.split()[0] for f in network.EDGES_DDL.split(", ")]


@pytest.mark.parametrize("rule, asset, v, e", [
    (None, None, V, E),
    ("unknown kind", "a", [change(V[0], VN, kind="well"), *V[1:]], E),
    ("unknown kind", "p", V, [change(E[0], EN, kind="hose"), E[1]]),
    ("missing attribute", "a", [change(V[0], VN, elevation=None), *V[1:]], E),
    ("missing attribute", "q", V, [E[0], change(E[1], EN, roughness=None)]),
    ("tank levels", "t", [*V[:2], change(V[2], VN, init_level=5.0)], E),
    ("size", "p", V, [change(E[0], EN, length=0.0), E[1]]),
    ("repeated node", "a", [V[0], *V], E),
    ("repeated link", "p", V, [E[0], *E]),
    ("unknown endpoint", "q", V, [E[0], change(E[1], EN, end="zz"), ("x", "pipe", "a", "t", 1.0, 0.1, 100.0, "OPEN", None)]),
    ("self loop", "x", V, [*E, ("x", "pipe", "a", "a", 1.0, 0.1, 100.0, "OPEN", None)]),
    ("not connected", "t", V, E[:1]),
    ("empty id", " ", [*V, change(V[0], VN, asset_id=" ")], [*E, ("x", "pipe", "a", " ", 1.0, 0.1, 100.0, "OPEN", None)]),
])
def test_each_corruption_is_found(spark, rule, asset, v, e):
    got = {(r.rule, r.asset_id) for r in graph.validate(*network.frames(spark, v, e)).collect()}
    assert got == ({(rule, asset)} if rule else set())


def test_places(spark):
    net = building.generate(spark, building.Plan().changed("[building]\nfloors = 2"))
    t = net.triples()
    nodes = spark.createDataFrame([("F1B-KIT",), ("OHT",)], "node string")
    got = {(r.node, r.place) for r in graph.places_of(t, nodes).collect()}
    assert got == {("F1B-KIT", x) for x in ("room:F1B-KIT", "flat:F1B", "floor:1", "building")} | {("OHT", "building")}
    words = net.nodes.where("asset_id IN ('F1B-KIT', 'OHT', 'DTA-0')").select("asset_id", graph.location(F.col("floor"), F.col("flat"), F.col("room")).alias("w"))
    assert {r.asset_id: r.w for r in words.collect()} == {"F1B-KIT": "Floor 1, Flat 1B, F1B-KIT", "OHT": "building supply", "DTA-0": "Ground floor"}
    assert {r.relation for r in graph.relation_counts(t).collect()} == {"FEEDS", "LOCATED_IN", "PART_OF", "MONITORS"}


def test_profile_flags_and_incident_files(spark, tmp_path):
    base = spark.createDataFrame([(t, "1", "node", "pressure", 5.0, "normal", "normal") for t in range(3)], READINGS_DDL).drop("scenario", "state")
    seen = spark.createDataFrame([(t, "1", "node", "pressure", 5.0 - t, s, "fault_active") for t in range(3) for s in ("s", "x")], READINGS_DDL)
    manifest = spark.createDataFrame([("s", "leak", "1", 0.5, 0.0, 1.0)], "scenario string, fault_type string, target_id string, severity double, start_hour double, end_hour double")
    r = tabular.profile(base, seen, manifest).collect()
    assert [(x.scenario, x.rank, x.max_abs_residual, x.residual_at_peak, x.first_change_s, x.fault_type) for x in r] == [("s", 1, 2.0, -2.0, 1, "leak")]
    scored = spark.createDataFrame([(4.0,), (4.1,), (float("nan"),), (None,)], "score double")
    assert detect.flag(scored).count() == 1 and detect.flag(scored, inclusive=True).count() == 2
    rows = spark.createDataFrame([("s", 0, a, "node", "pressure", 9.0, 1.0) for a in "ab"], "scenario string, timestamp_s long, asset_id string, asset_type string, parameter string, score double, residual double").withColumn("incident_no", F.lit(1))
    found = detect.incidents(rows)
    found.write.json(str(tmp_path / "i"))
    back = tables.read_incidents(spark, str(tmp_path / "i")).first()
    assert back.epicenter == "a" and [c.asset_id for c in back.candidates] == ["a", "b"]
