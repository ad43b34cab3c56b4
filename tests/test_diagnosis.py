import pytest
from pyspark.sql import functions as F

from rillflow.operators import diagnosis, retrieval as r

# source - inlet - sump - pump - tank - outlet - manifold - riser link - tees, two flats with a room branch and a tap each
ASSETS = [
    ("SRC", "reservoir", "source", None, None), ("INLET", "pipe", "municipal_inlet", None, None), ("SUMP", "tank", "sump", None, None), ("PUMP", "pump", "transfer_pump", None, None),
    ("ROOF", "tank", "roof_tank", None, None), ("OUT", "pipe", "tank_outlet", None, None), ("MAN", "junction", "roof_manifold", None, None), ("RISE", "pipe", "downtake", None, None),
    ("T1", "junction", "tee", None, None), ("VA", "valve", "flat_valve", "A", None), ("IA", "junction", "flat_inlet", "A", None), ("BA", "pipe", "room_branch", "A", "A-K"),
    ("KA", "junction", "fixture", "A", "A-K"), ("VB", "valve", "flat_valve", "B", None), ("IB", "junction", "flat_inlet", "B", None), ("BB", "pipe", "room_branch", "B", "B-K"), ("KB", "junction", "fixture", "B", "B-K"),
]
FEEDS = [("INLET", "SRC"), ("SUMP", "INLET"), ("PUMP", "SUMP"), ("ROOF", "PUMP"), ("OUT", "ROOF"), ("MAN", "OUT"), ("RISE", "MAN"), ("T1", "RISE"), ("VA", "T1"), ("IA", "VA"), ("BA", "IA"),
         ("KA", "BA"), ("VB", "T1"), ("IB", "VB"), ("BB", "IB"), ("KB", "BB")]
SENSORS = [("s1", "IA", "pressure"), ("s2", "IB", "pressure"), ("s3", "BA", "flowrate"), ("s4", "BB", "flowrate"), ("s5", "ROOF", "pressure"), ("s6", "PUMP", "flowrate"), ("s7", "INLET", "flowrate"),
           ("s8", "SUMP", "pressure"), ("s9", "OUT", "flowrate")]


@pytest.fixture(scope="module")
def building(spark):
    rows = [(a, k, x, f"{x} {a}", room, flat, 1) for a, k, x, flat, room in ASSETS]
    return r.Building(
        spark.createDataFrame(rows, "asset_id string, kind string, role string, label string, room string, flat string, floor int"),
        spark.createDataFrame(FEEDS, "child string, parent string"), spark.createDataFrame(SENSORS, "sensor_id string, asset_id string, parameter string"))


def solve(spark, building, readings):
    """readings: (hour, asset, parameter, observed, expected) that were flagged; the incident holds them all from the first on."""
    sigma = {"pressure": 0.25, "flowrate": 2e-6}
    ev = [("s", h * 3600, a, p, o, e, o - e, abs(o - e) / sigma[p]) for h, a, p, o, e in readings]
    events = spark.createDataFrame(ev, "scenario string, timestamp_s long, asset_id string, parameter string, observed double, expected double, residual double, score double")
    begin, end = min(x[1] for x in ev), max(x[1] for x in ev)
    heads = spark.createDataFrame([("INC", "s", begin, end)], "incident string, scenario string, detected_at_s long, last_seen_s long")
    best = {}
    for _, t, a, p, _, _, res, score in ev:
        old = best.get(a)
        best[a] = (a, p, max(score, old[2]) if old else score, res if not old or score > old[2] else old[3], min(t, old[4]) if old else t, t if not old or score > old[2] else old[5])
    cand = spark.createDataFrame([("INC", i + 1, *x) for i, x in enumerate(sorted(best.values(), key=lambda x: -x[2]))],
                                 "incident string, position int, asset_id string, parameter string, score double, residual double, first_seen_s long, peak_at_s long")
    named = r.alarms(cand, building)
    rows = r.classified(named, events, heads, building)
    span, bounds = r.suspect_spans(rows, building)
    series = r.timelines(named, events, heads)
    near = r.context(rows, span, bounds, r.low_tank_chains(rows, building), building)
    packet = r.packets(rows, near, series, heads, building)
    found = diagnosis.hypotheses(rows, series, span, bounds, heads, building)
    return diagnosis.grounding(diagnosis.diagnose(found), packet).first(), packet.first(), rows, span, bounds


def test_leak_is_placed_at_the_tap(spark, building):
    d, packet, rows, *_ = solve(spark, building, [(h, "BA", "flowrate", 3e-4, 1e-4) for h in (8, 9)] + [(h, "OUT", "flowrate", 9e-4, 7.2e-4) for h in (8, 9)])
    assert (d.root_cause_asset, d.fault_type, d.start_hour, d.confidence, d.grounded) == ("KA", "leak", 8, 0.9, True)
    assert "sensor:s1" in packet.allowed_ids and '"status":"normal"' in packet.packet and packet.tokens > 100


def test_a_dry_flat_beside_a_healthy_one_is_its_valve(spark, building):
    d, _, _, span, bounds = solve(spark, building, [(h, "IA", "pressure", 0.2, 20.0) for h in (6, 7)])
    assert (d.root_cause_asset, d.fault_type, d.kind, d.confidence) == ("VA", "blockage", "no_water", 0.9)
    assert bounds.first().bound == "T1" and {x.asset_id for x in span.collect()} == {"IA", "VA"}


def test_all_flats_down_without_an_outlet_drop_is_no_closed_pipe(spark, building):
    manifold = building.assets.withColumn("role", F.when(F.col("asset_id") == "T1", "roof_manifold").otherwise(F.col("role")))
    d, *_ = solve(spark, r.Building(manifold, building.feeds, building.sensors), [(h, a, "pressure", 0.5, 20.0 + 4 * (a == "IB")) for a in ("IA", "IB") for h in (6, 7)])
    assert d.kind == "no_water" and d.confidence == 0.4 and d.severity == "review" and d.title.startswith("Unconfirmed")


def test_pump_failure_with_a_low_tank(spark, building):
    d, *_ = solve(spark, building, [(6, "PUMP", "flowrate", 0.0, 1e-3)] + [(h, "ROOF", "pressure", 0.5, 2.5) for h in (7, 8, 9)])
    assert (d.root_cause_asset, d.fault_type, d.confidence, d.start_hour) == ("PUMP", "pump_failure", 0.7, 6)
    d, *_ = solve(spark, building, [(6, "PUMP", "flowrate", 0.0, 1e-3)])
    assert d.confidence == 0.35 and d.severity == "review"


def test_street_supply_and_stopped_branches(spark, building):
    d, *_ = solve(spark, building, [(5, "INLET", "flowrate", 0.0, 1e-3), (6, "SUMP", "pressure", 0.5, 2.0)])
    assert (d.root_cause_asset, d.fault_type, d.start_hour) == ("INLET", "other", 5)
    d, *_ = solve(spark, building, [(9, a, "flowrate", 0.0, 1e-4) for a in ("BA", "BB")])
    assert (d.root_cause_asset, d.kind, d.confidence) == ("RISE", "no_flow", 0.6)


def test_a_common_shift_is_not_local(spark, building):
    _, _, rows, *_ = solve(spark, building, [(6, a, "pressure", 18.0, 20.0) for a in ("IA", "IB")])
    assert rows.where("common").count() == 2 and rows.where("loss").count() == 0


def test_texts(spark, building):
    d = spark.createDataFrame([("INC", "VA", "critical", "Supply cut below VA", "three sensors", "Open VA.", 0.9, ["IA", "BB", "ROOF"], [("PUMP", "weaker evidence")])],
                              "incident string, root_cause_asset string, severity string, title string, reasoning string, recommended_action string, confidence double, affected_assets array<string>, "
                              "alternatives array<struct<asset:string,why_less_likely:string>>")
    assert diagnosis.flats_text(d, building).first().flats == "Flats A, B"
    assert diagnosis.message_text(d).first().message == "[CRITICAL] Supply cut below VA\nWhy: three sensors\nLess likely: PUMP: weaker evidence\nAction: Open VA.\nConfidence: 90%"
    s = spark.createDataFrame([("I", "a", "pressure", h * 3600, -h / 4) for h in range(12)] + [("I", "b", "flowrate", 0, 0.00012345)], "incident string, asset_id string, parameter string, timestamp_s long, deviation double")
    got = {r.asset_id: r.series for r in r_texts(s)}
    assert got["a"] == ["00:00 +0.0", "01:00 -0.2", "02:00 -0.5", "03:00 -0.8", "04:00 -1.0", "...", "10:00 -2.5", "11:00 -2.8"] and got["b"] == ["00:00 +0.1234"]


def r_texts(series):
    return r.series_texts(series).collect()


def test_scores_and_ungrounded_ids(spark, building):
    d = spark.createDataFrame([("INC", "IA", "leak", 1.5, ["IA", "XX"], [])], "incident string, root_cause_asset string, fault_type string, confidence double, affected_assets array<string>, alternatives array<struct<asset:string>>")
    allowed = spark.createDataFrame([("INC", ["IA"])], "incident string, allowed_ids array<string>")
    g = diagnosis.grounding(d, allowed).first()
    assert not g.grounded and g.violations == ["unknown ids: XX", "confidence out of range"]
    truth = spark.createDataFrame([("INC", "VA", "blockage")], "incident string, target_id string, fault_type string")
    s = diagnosis.scores(d, truth, building).first()
    assert (s.exact, s.room, s.near, s.type) == (False, False, True, False)
    assert spark.range(1).select(r.truth_tokens(F.lit('{"a": "LEAK_101"}'), ["leak_", "zz"])).first()[0]


def packet_of(spark, building, readings):
    """The packet with topology facts, and the hypotheses from the whole building, of flagged (hour, asset, parameter, observed, expected)."""
    from rillflow.operators import day

    sigma = {"pressure": 0.25, "flowrate": 2e-6}
    ev = [("s", h * 3600, a, p, o, e, o - e, abs(o - e) / sigma[p]) for h, a, p, o, e in readings]
    flagged = spark.createDataFrame(ev, "scenario string, timestamp_s long, asset_id string, parameter string, observed double, expected double, residual double, score double")
    flagged = flagged.withColumn("asset_type", F.lit("node"))
    steps = spark.createDataFrame([("s", h * 3600, p) for h in range(24) for p in sigma], "scenario string, timestamp_s long, parameter string")
    found = day.evidence(steps, flagged, building, min_assets=1)
    return found, diagnosis.hypotheses(found.rows, found.series, found.span, found.bounds, found.heads, building)


CASES = [
    [(h, "BA", "flowrate", 3e-4, 1e-4) for h in (8, 9)] + [(h, "OUT", "flowrate", 9e-4, 7.2e-4) for h in (8, 9)],
    [(h, "IA", "pressure", 0.2, 20.0) for h in (6, 7)],
    [(h, a, "pressure", 0.5, 20.0 + 4 * (a == "IB")) for a in ("IA", "IB") for h in (6, 7)],
    [(6, "PUMP", "flowrate", 0.0, 1e-3)] + [(h, "ROOF", "pressure", 0.5, 2.5) for h in (6, 7, 8, 9)],
    [(5, "INLET", "flowrate", 0.0, 1e-3), (5, "SUMP", "pressure", 0.5, 2.0)],
    [(9, a, "flowrate", 0.0, 1e-4) for a in ("BA", "BB")],
]


@pytest.mark.parametrize("readings", CASES, ids=("leak", "dry flat", "all flats", "pump", "street", "stopped"))
def test_packets_alone_give_what_the_whole_building_gives(spark, building, readings):
    found, whole = packet_of(spark, building, readings)
    keep = ["incident", "generator", "fault_type", "kind", "root", "start_hour", "confidence", "affected"]
    alone = diagnosis.from_packets(found.packets)
    assert alone.count() > 0
    assert sorted(alone.select(*keep).collect()) == sorted(whole.select(*keep).collect())


def hand_made(relations, observations, assets=None):
    import json

    known = assets or sorted({x for a, _, b in relations for x in (a, b)})
    kind = {a: (k, x, flat) for a, k, x, flat, _ in ASSETS}
    return json.dumps({
        "incident": {"id": "INC-1", "first_alarm": "09:00", "last_alarm": "10:00"}, "relations": relations,
        "assets": [{"asset_id": a, "kind": kind[a][0], "role": kind[a][1], "label": a, "flat": kind[a][2]} for a in known],
        "observations": [{"asset": a, "parameter": "flowrate", "status": "alarm", "score": 9.0, "peak_deviation": -0.1, "unit": "L/s", "first_seen": "09:00",
                          "hourly": [{"at": "09:00", "deviation": -0.1, "observed": 0.0, "expected": 0.1}]} for a in observations]})


def test_a_packet_that_falls_apart_ends_ways_at_its_border(spark):
    whole = [["T1", "FEEDS", "VA"], ["VA", "FEEDS", "IA"], ["IA", "FEEDS", "BA"], ["T1", "FEEDS", "VB"], ["VB", "FEEDS", "IB"], ["IB", "FEEDS", "BB"], ["RISE", "FEEDS", "T1"]]
    parted = [r for r in whole if r != ["VB", "FEEDS", "IB"]]
    packets = spark.createDataFrame([("whole", hand_made(whole, ["BA", "BB"])), ("parted", hand_made(parted, ["BA", "BB"])), ("one", hand_made(parted, ["BB"])), ("lone", hand_made([], ["BB"], ["BB"]))], "incident string, packet string")
    view = diagnosis.PacketView(packets)
    up = {(x.incident, x.descendant): set() for x in view.closure.collect()}
    for x in view.closure.collect():
        up[x.incident, x.descendant].add((x.ancestor, x.distance))
    assert up["whole", "BB"] == {("BB", 0), ("IB", 1), ("VB", 2), ("T1", 3), ("RISE", 4)}
    assert up["parted", "BB"] == {("BB", 0), ("IB", 1)} and up["parted", "BA"] == {("BA", 0), ("IA", 1), ("VA", 2), ("T1", 3), ("RISE", 4)}
    assert up["lone", "BB"] == {("BB", 0)}
    found = {x.incident: x for x in diagnosis.from_packets(packets).where("kind = 'no_flow'").collect()}
    assert found["whole"].root == "RISE" and found["whole"].confidence == 0.6
    assert "parted" not in found  # two branches without a common supply point inside the packet
    assert found["one"].root == "BB" and found["lone"].root == "BB" and found["lone"].start_hour == 9
    assert diagnosis.from_packets(packets.limit(0)).count() == 0


def test_closure_by_doubling(spark):
    from rillflow.operators import graph
    from rillflow.operators.contracts import ContractError

    chain = spark.createDataFrame([("x", f"n{i + 1}", f"n{i}") for i in range(37)] + [("y", "n5", "n4"), ("y", "n4", "n2")], "k string, child string, parent string")
    got = {tuple(r) for r in graph.supply_closure(chain, by=["k"]).select("k", "ancestor", "descendant", "distance").collect()}
    want = {("x", f"n{a}", f"n{d}", d - a) for d in range(1, 38) for a in range(d + 1)} | {("y", "n5", "n5", 0), ("y", "n4", "n4", 0), ("y", "n4", "n5", 1), ("y", "n2", "n4", 1), ("y", "n2", "n5", 2)}
    assert got == want
    with pytest.raises(ContractError):
        graph.supply_closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), 20)
