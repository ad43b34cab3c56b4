import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow.functions import columns as c
from rillflow.operators import contracts, detect, evaluate, graph, scenarios, tabular
from rillflow.schemas import READINGS_DDL, THRESHOLDS

SPEC = {"pressure": (1.0, 0.0), "flowrate": (0.001, 0.0)}


def frame(spark, offsets=None, scenario="s", assets=range(100, 110), steps=25):
    """Flat pressures of 50 m, with deviations {asset: {hour: delta}}."""
    offsets = offsets or {}
    rows = [(t * 3600, str(a), "node", "pressure", 50.0 + offsets.get(a, {}).get(t, 0.0), scenario, "normal") for a in assets for t in range(steps)]
    return spark.createDataFrame(rows, READINGS_DDL)


def run(spark, offsets, **more):
    base = detect.observe(frame(spark), SPEC, noise=False)
    seen = detect.observe(frame(spark, offsets), SPEC, noise=False)
    return detect.detect(seen, base, **more)


def test_a_residual_needs_support_and_more_than_the_threshold(spark):
    flagged, found = run(spark, {100: {5: -8.0}, 101: {5: -8.0}, 102: {5: 4.0}})
    assert flagged.count() == 2  # exactly at the threshold is no flag
    r = found.first()
    assert (r.detected_at_s, r.last_seen_s, r.event_count, r.epicenter) == (5 * 3600, 5 * 3600, 2, "100")
    assert run(spark, {100: {5: -8.0}})[1].count() == 0
    assert run(spark, {})[0].count() == 0


def test_a_quiet_step_separates_incidents(spark):
    both = {t: -9.0 for t in (3, 4, 6)}
    _, found = run(spark, {100: both, 101: both})
    assert [(r.incident_no, r.detected_at_s // 3600, r.last_seen_s // 3600) for r in found.orderBy("incident_no").collect()] == [(1, 3, 4), (2, 6, 6)]


def test_candidates_rank_by_score_first_seen_and_channel(spark):
    _, found = run(spark, {100: {3: -9.0, 4: -9.0}, 101: {3: -20.0, 4: -5.0}, 102: {4: 9.0}})
    got = [(x.asset_id, x.first_seen_s // 3600, x.peak_at_s // 3600, x.channel_rank) for x in found.first().candidates]
    assert got == [("101", 3, 3, 1), ("100", 3, 3, 2), ("102", 4, 4, 3)]


def test_channels_interleave_and_namespaces_stay_apart(spark):
    rows = []
    for a in (101, 102, 103):
        for t in range(3):
            rows.append((t * 3600, str(a), "node", "pressure", 50.0 - (30.0 - a % 10) * (t == 1), "s", "normal"))
            rows.append((t * 3600, str(a), "link", "flowrate", 0.5 - 0.01 * a * (t == 1) * (a < 103), "s", "normal"))
    seen = detect.observe(spark.createDataFrame(rows, READINGS_DDL), SPEC, noise=False)
    flat = [(t, a, k, p, 50.0 if p == "pressure" else 0.5, s, x) for t, a, k, p, _, s, x in rows]
    base = detect.observe(spark.createDataFrame(flat, READINGS_DDL), SPEC, noise=False)
    got = [(x.parameter, x.asset_id) for x in detect.detect(seen, base)[1].first().candidates]
    assert got == [("flowrate", "102"), ("pressure", "101"), ("flowrate", "101"), ("pressure", "102"), ("pressure", "103")]


def test_floor_and_zero_noise(spark):
    base, seen = frame(spark), frame(spark, {100: {5: 8.0}, 101: {5: 8.0}})
    scored = detect.residual_scores(detect.observe(seen, SPEC, noise=False), base, floors={"pressure": 10.0})
    assert detect.flag(scored).count() == 0
    scored = detect.residual_scores(detect.observe(seen, {}, noise=False), base)  # no instrument, no noise: any deviation is infinite
    assert {r.score for r in scored.where("residual <> 0").collect()} == {math.inf} and scored.where("score IS NULL").count() == 248
    assert detect.flag(scored).count() == 2


def test_statistical_needs_no_baseline_and_inverts_for_long_faults(spark):
    short = {t: -20.0 for t in (5, 6)}
    seen = detect.observe(frame(spark, {100: short, 101: short}), SPEC, noise=False)
    flagged, found = detect.detect(seen, None, "statistical")
    assert sorted({r.timestamp_s // 3600 for r in flagged.collect()}) == [5, 6] and found.first().event_count == 4
    long = {t: -20.0 for t in range(4, 25)}
    flagged, _ = detect.detect(detect.observe(frame(spark, {100: long, 101: long}), SPEC, noise=False), None, "statistical")
    assert sorted({r.timestamp_s // 3600 for r in flagged.collect()}) == [0, 1, 2, 3]


def test_sensor_noise_is_keyed(spark):
    rows = frame(spark)
    a = {(r.asset_id, r.timestamp_s): r.value for r in detect.observe(rows, SPEC, seed=1).collect()}
    b = {(r.asset_id, r.timestamp_s): r.value for r in detect.observe(rows.repartition(7).where("timestamp_s < 40000"), SPEC, seed=1).collect()}
    assert all(a[k] == v for k, v in b.items()) and len(set(a.values())) > 200
    assert a != {(r.asset_id, r.timestamp_s): r.value for r in detect.observe(rows, SPEC, seed=2).collect()}
    z = [v - 50 for v in a.values()]
    assert abs(sum(z) / len(z)) < 0.25 and 0.8 < math.sqrt(sum(x * x for x in z) / len(z)) < 1.2
    some = spark.createDataFrame([(103,), (103,)], "asset_id int")
    got = detect.observe(rows, {"pressure": (0.1, 0.02)}, some, noise=False)
    assert got.count() == 25 and got.first().noise_std == pytest.approx(1.1) and got.first().truth == 50.0


def test_tiers_are_inclusive(spark):
    rows = spark.createDataFrame([("pressure", x) for x in (0.49, 0.5, 1.5, 5.0)] + [("demand", 99.0)], "parameter string, abs_residual double")
    got = tabular.classify(rows, THRESHOLDS).collect()
    assert [r.severity for r in got] == ["normal", "anomaly", "warning", "critical", "normal"]
    assert [r.is_anomaly for r in got] == [False, True, True, True, False] and got[-1].threshold_anomaly is None and not got[-1].is_monitored


def test_gap_equal_to_the_limit_joins(spark):
    rows = spark.createDataFrame([("s", t) for t in (0, 3600, 7200, 10801)] + [("r", 0)], "scenario string, timestamp_s long")
    got = {(r.scenario, r.timestamp_s): r.event_number for r in tabular.islands(rows, 3600).collect()}
    assert got == {("s", 0): 1, ("s", 3600): 1, ("s", 7200): 1, ("s", 10801): 2, ("r", 0): 1}
    with pytest.raises(ValueError):
        tabular.islands(rows, -1)


def test_alignment_must_match(spark):
    a, b = frame(spark), frame(spark, scenario="x").where("timestamp_s < 86400")
    with pytest.raises(contracts.ContractError, match="10 in the baseline, 0"):
        tabular.align_exact(a.drop("scenario", "state"), b)
    got = tabular.align_exact(frame(spark).drop("scenario", "state"), frame(spark, {100: {1: 2.0}}, "x"))
    assert tabular.residuals(got).where("residual = 2").count() == 1
    events = tabular.events(tabular.classify(tabular.residuals(got), {"pressure": (9.0, 10.0, 11.0)}), 3600)
    assert events.count() == 0 and len(events.columns) == 18


def test_phases(spark):
    texts = ["fault_active|recovery", "recovery", "normal", "normal|recovery", "", " recovery | recovery"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(c.phase(F.col("s")).alias("p"))
    assert [r.p for r in rows.collect()] == ["primary", "recovery_transient", "pre_fault_false_positive", "mixed_or_unknown", "mixed_or_unknown", "recovery_transient"]


def test_states_names_means(spark):
    t = spark.createDataFrame([(x,) for x in (0, 8, 17, 18)], "t long")
    assert [r[0] for r in t.select(c.state_at(F.col("t"), F.lit(8), F.lit(18))).collect()] == ["normal", "fault_active", "fault_active", "recovery"]
    assert [r[0] for r in t.select(c.state_at(F.col("t"), F.lit(8), F.lit(None).cast("long"))).collect()][-1] == "fault_active"
    rows = spark.createDataFrame([(x, "1", "node", "pressure", v, "s", "normal") for x, v in ((0, 1.0), (900, 2.0), (3600, -4.0), (3601, None))], READINGS_DDL)
    got = {r.timestamp_s: r.value for r in scenarios.report_means(rows, 3600, 0.0).collect()}
    assert got == {0: 1.0, 3600: 1.0, 7200: None}
    path = spark.sql("SELECT array(array(0D,0D,0D), array(3D,4D,0D), array(3D,4D,2D)) AS p, array(array(1D,1D,1D)) AS q")
    assert tuple(path.select(scenarios.polyline_length(F.col("p")), scenarios.polyline_length(F.col("q"))).first()) == (7.0, 0.0)


def test_step_scores_and_hits(spark):
    states = spark.createDataFrame([("s", t, "normal" if t < 3 else "fault_active" if t < 6 else "recovery") for t in range(8)], "scenario string, timestamp_s long, state string")
    found = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 4, 6)], "scenario string, incident_no int, detected_at_s long, last_seen_s long")
    r = evaluate.step_scores(states, found).first()
    assert (r.true_positive, r.false_negative, r.false_positive, r.recovery_fired, r.latency_s) == (2, 1, 1, 1, 1)
    active = spark.createDataFrame([("s", 3, 6)], "scenario string, begin_s long, end_s long")
    assert evaluate.scored_incident(found, active).first().incident_no == 2
    cand = spark.createDataFrame([("s", 1, "a"), ("s", 4, "b")], "scenario string, position int, asset_id string")
    truth = spark.createDataFrame([("s", "b"), ("r", "b")], "scenario string, asset_id string")
    got = {x.scenario: (x.first_hit_rank, x.hit_at_3, x.hit_at_5) for x in evaluate.hits_at(cand, truth).collect()}
    assert got == {"s": (4, False, True), "r": (None, False, False)}
    low, high = spark.range(1).select(*c.wilson(F.lit(8), F.lit(10))).first()
    assert (low, high) == pytest.approx((0.4901625, 0.9433178), abs=1e-4)
    assert tuple(spark.range(1).select(*c.wilson(F.lit(0), F.lit(0))).first()) == (None, None)


TREE = [("a", "r", "ra"), ("b", "a", "ab"), ("c", "a", "ac"), ("d", "c", "cd"), ("e", "r", "re")]


def test_supply_tree(spark):
    edges = spark.createDataFrame([(k, p, x) if i % 2 else (k, x, p) for i, (x, p, k) in enumerate(TREE)], "asset_id string, start string, end string")
    tree = graph.orient(edges, "r")
    assert sorted((r.child, r.parent, r.link) for r in tree.collect()) == sorted(TREE)
    loop = edges.union(spark.createDataFrame([("x", "d", "e")], edges.schema))
    with pytest.raises(contracts.ContractError):
        graph.orient(loop, "r")
    groups = spark.createDataFrame([("1", "b"), ("1", "d"), ("2", "d"), ("3", "b"), ("3", "e"), ("4", "c"), ("4", "d")], "grp string, member string")
    got = {r.grp: r.common for r in graph.common_supply_point(tree, groups).collect()}
    assert got == {"1": "a", "2": "d", "3": "r", "4": "c"}
    assert sorted((r.grp, r.member) for r in graph.deepest(tree, groups).collect()) == [("1", "b"), ("1", "d"), ("2", "d"), ("3", "b"), ("3", "e"), ("4", "d")]
    nodes = spark.createDataFrame([("d",), ("r",)], "node string")
    assert {r.node: (r.path, r.depth) for r in graph.upstream_path(tree, nodes).collect()} == {"d": ("d>c>a>r", 3), "r": ("r", 0)}
    assert sorted(r.descendant for r in graph.downstream_set(tree, spark.createDataFrame([("a",)], "node string")).collect()) == ["b", "c", "d"]


def test_walks_on_a_cyclic_multigraph(spark):
    rows = [("1", "a", "b", 1.0), ("2", "a", "b", -1.0), ("3", "b", "c", 0.0), ("4", "c", "a", None), ("5", "x", "y", 2.0)]
    edges = spark.createDataFrame(rows, "asset_id string, start string, end string, flowrate double")
    a = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.neighbours(edges, a, 5).collect()} == {("b", 1), ("c", 1)}
    assert graph.neighbours(edges, a, 0).count() == 0
    arcs = graph.directed(graph.oriented(edges))
    assert {(r.node, r.hops) for r in graph.downstream(arcs, a).collect()} == {("b", 1), ("c", 2)}
    assert {(r.node, r.hops) for r in graph.upstream(arcs, a).collect()} == {("b", 1)}
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "asset_id string")
    assert {r.asset_id: r.component for r in graph.components(edges, nodes).collect()} == dict(a="a", b="a", c="a", x="x", y="x", z="z")
    far = graph.hop_distance(edges, a, spark.createDataFrame([("c",), ("z",)], "node string")).collect()
    assert {r.node: r.hops for r in far} == {"c": 1, "z": None}


def test_live_prefixes_never_see_the_future(spark):
    rows = detect.as_of(frame(spark, steps=4), 7200)
    assert rows.where("timestamp_s > as_of_s").count() == 0
    assert {r.as_of_s: r["count"] for r in rows.groupBy("as_of_s").count().collect()} == {0: 10, 7200: 30, 14400: 40}


def test_snapshot_contract(spark):
    v = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    e = spark.createDataFrame([("l", "a", "b")], "asset_id string, start string, end string")
    good = [(0, "a", "node", "pressure", 1.0, "s", "normal"), (0, "l", "link", "flowrate", -1.0, "s", "normal")]
    rows = spark.createDataFrame(good, READINGS_DDL)
    nodes, links = graph.snapshot(v, e, contracts.check_snapshot(rows, v, e))
    assert nodes.count() == 2 and (links.first().flow_from, links.first().flow_to) == ("b", "a")
    for bad, rule in [((0, "q", "node", "pressure", 1.0, "s", "n"), "unknown"), ((0, "a", "node", "flowrate", 1.0, "s", "n"), "assignment"),
                      ((0, " ", "node", "pressure", 1.0, "s", "n"), "ids"), ((0, "a", "pipe", "pressure", 1.0, "s", "n"), "types"), (good[0], "duplicates")]:
        with pytest.raises(contracts.ContractError) as x:
            contracts.check_snapshot(rows.union(spark.createDataFrame([bad], READINGS_DDL)), v, e)
        assert x.value.rule == rule


def test_a_search_keeps_parts_of_a_graph_in_blocks_of_their_own(spark):
    """Two parts of 1,200 seeds with names that alternate: each node meets the bitmaps of its own part's seeds, and the pairs are those of both parts."""
    arcs = spark.range(2400).select(F.format_string("a%05d", "id").alias("src"), F.format_string("z%d", F.col("id") % 2).alias("dst"))
    seeds = arcs.select(F.col("src").alias("node"))
    blocks = graph._blocks(arcs, seeds).groupBy("block").agg(F.count_distinct(F.substring("seed", 6, 1).cast("int") % 2).alias("parts"), F.count("seed").alias("n")).collect()
    assert sum(b.n for b in blocks) == 2400 and max(b.n for b in blocks) <= 512
    assert sum(b.parts == 2 for b in blocks) <= 1
    pairs = graph.downstream(arcs, seeds).collect()
    assert sorted((r.seed, r.node, r.hops) for r in pairs) == [(f"a{i:05d}", f"z{i % 2}", 1) for i in range(2400)]


def test_a_search_deals_the_pairs_of_one_block_to_many_tasks(spark, monkeypatch):
    """40 seeds in one block reach 4,000 nodes in one to three hops: their pairs are made by many tasks, none with much of them, and the hops are right."""
    monkeypatch.setattr(graph, "LOT", 1000, raising=False)
    rows = [(f"s{i:02d}", "m0") for i in range(40)] + [("m0", f"m{k}") for k in (1, 2)] + [(f"m{1 + k % 2}", f"t{k}") for k in range(4000)]
    arcs = spark.createDataFrame(rows, "src string, dst string")
    seeds = arcs.where("dst = 'm0'").select(F.col("src").alias("node"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = graph.downstream(arcs, seeds).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, was)
    near = {"m0": 1, "m1": 2, "m2": 2} | {f"t{k}": 3 for k in range(4000)}
    assert len(got) == 40 * len(near) and {(r.seed, r.node, r.hops) for r in got} == {(f"s{i:02d}", n, h) for i in range(40) for n, h in near.items()}
    assert max(Counter(r.task for r in got).values()) < len(got) / 4
