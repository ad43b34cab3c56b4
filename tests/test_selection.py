import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import graph
from rillflow.operators.contracts import ContractError
from rillflow.operators.selection import quantiles


@pytest.mark.parametrize("whole", (0, 1 << 20))
def test_quantiles_equal_numpy(spark, whole):
    rng = random.Random(4)
    draws = {
        "flat": [rng.uniform(-1, 1) for _ in range(1000)], "ties": [float(rng.randrange(3)) for _ in range(500)], "one": [7.25] * 90, "tiny": [5e-324 * rng.randrange(9) for _ in range(100)], "below": [-1e-9 * 1.5 ** rng.randrange(90) for _ in range(300)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 308) for _ in range(200)], "edges": [-math.inf, math.inf, -1.7e308, 1.7e308, 0.0, -0.0] * 5, "single": [3.0], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in draws.items() for v in vs] + [("flat", None), ("flat", math.nan), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, x double").repartition(5)
    ps = (0.0, 0.05, 0.5, 0.93)
    near = {r.grp: (r.n, r.q) for r in quantiles(df, ["grp"], "x", ps, "nearest", whole).collect()}
    between = {r.grp: r.q for r in quantiles(df, ["grp"], "x", ps, "linear", whole).collect()}
    assert set(near) == set(draws)
    for g, vs in draws.items():
        v = sorted(vs)
        assert near[g] == (len(v), [v[round(p * (len(v) - 1))] for p in ps])
        if g not in ("edges", "wide"):
            assert np.allclose(between[g], np.quantile(v, ps), rtol=1e-12, atol=1e-300), (g, between[g], np.quantile(v, ps))
    all_rows = quantiles(df.where("grp = 'flat'"), [], "x", (0.5,), whole=whole).collect()
    assert len(all_rows) == 1 and all_rows[0].n == 1000
    assert quantiles(df.limit(0), ["grp"], "x", (0.5,), whole=whole).count() == 0
    with pytest.raises(ValueError):
        quantiles(df, ["grp"], "x", (0.5,), "odd")


def test_reach_of_many_seeds_equals_single_searches(spark):
    rng = random.Random(9)
    arcs = [(f"n{rng.randrange(700)}", f"n{rng.randrange(700)}") for _ in range(900)] + [("n1", "n1"), ("n2", "n3"), ("n2", "n3")]
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)

    def plain(seed, most):
        at, seen, hops = {seed}, {seed: 0}, 0
        while at and (most is None or hops < most):
            hops += 1
            at = {b for a in at for b in out.get(a, ())} - set(seen)
            seen |= {b: hops for b in at}
        return seen

    df = spark.createDataFrame(arcs, "src string, dst string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(600)] + [("n5",), (None,), ("outside",)], "node string").repartition(3)
    for most in (2, None):
        got = {}
        for r in graph.reach(df, seeds, most).collect():
            assert (r.seed, r.node) not in got
            got[r.seed, r.node] = r.hops
        assert got == {(s, n): h for s in [f"n{i}" for i in range(600)] + ["outside"] for n, h in plain(s, most).items()}
    assert graph.reach(df, seeds.limit(0)).count() == 0 and graph.reach(df.limit(0), seeds.where(F.col("node") == "n5")).count() == 1


def test_labels_and_common_points_of_random_trees(spark):
    rng = random.Random(6)
    parent = {f"a{i}": f"a{max(0, i - rng.choice([1, 1, 1, 5, 40]))}" for i in range(1, 160)} | {"b1": "b0", "b2": "b1"}
    df = spark.createDataFrame(list(parent.items()), "child string, parent string")

    def way(n):
        out = [n]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    labels = graph.tree_labels(df)
    nodes = {r.node: r for r in labels.nodes.collect()}
    assert set(nodes) == set(parent) | {"a0", "b0"}
    for a in nodes.values():
        assert (a.root, a.depth) == (way(a.node)[-1], len(way(a.node)) - 1)
        assert a.last - a.pre + 1 == sum(a.node in way(n) for n in nodes)
        assert all((a.node in way(b.node)) == (a.root == b.root and a.pre <= b.pre <= a.last) for b in nodes.values())
    groups = [(g, rng.choice(list(nodes))) for g in range(60) for _ in range(rng.randrange(1, 4))] + [(100, "a5"), (100, "b2"), (101, "a5"), (101, "nowhere"), (102, "a0"), (103, "a9"), (103, "a9")]
    gdf = spark.createDataFrame(groups, "grp int, member string")
    want, deep = {}, set()
    for g in {g for g, _ in groups}:
        own = {m for k, m in groups if k == g}
        shared = [n for n in way(next(iter(own))) if all(n in way(m) for m in own)] if own <= set(nodes) else []
        if shared:
            want[g] = shared[0]
        deep |= {(g, m) for m in own if not any(m in way(o)[1:] for o in own)}
    assert {r.grp: r.common for r in graph.common_points(labels, gdf).collect()} == want
    assert {(r.grp, r.member) for r in graph.deepest(df, gdf, labels).collect()} == deep
    with pytest.raises(ContractError):
        graph.tree_labels(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"), 50)
    with pytest.raises(ContractError):
        graph.tree_labels(spark.createDataFrame([("a", "b"), ("a", "c")], "child string, parent string"))


def test_labels_are_the_same_where_few_rows_of_a_key_may_meet(spark, monkeypatch):
    """Nodes with many below them are looked up apart from the shuffle, and windows span stretches of numbers: labels, common points and deepest members stay."""
    rng = random.Random(5)
    parent = {f"n{i:03d}": f"n{rng.randrange(max(0, i - 40), i) if i % 3 else 0:03d}" for i in range(1, 300)}
    tree = spark.createDataFrame(list(parent.items()), "child string, parent string")
    nodes = ["n000", *parent]
    groups = [(f"g{g}", m) for g in range(12) for m in rng.sample(nodes, 2 + g * g)] + [("all", m) for m in nodes] + [("g1", "stranger"), ("out", "stranger")]
    groups = spark.createDataFrame(groups, "grp string, member string")

    def results():
        labels = graph.tree_labels(tree)
        hot = {r.top for df in labels.hot for r in df.collect()}
        return hot, *(sorted(map(tuple, df.collect())) for df in (labels.nodes, graph.common_points(labels, groups), graph.deepest(tree, groups, labels)))

    whole = results()
    monkeypatch.setattr(graph, "HOT", 1)
    monkeypatch.setattr(graph, "STRETCH", 3)
    apart = results()
    assert whole[0] == set() and "n000" in apart[0] and len(apart[0]) > 3
    assert whole[1:] == apart[1:]
    under = {n: {n} for n in nodes}
    for n in parent:
        up = n
        while up in parent:
            up = parent[up]
            under[up].add(n)
    assert [m for g, m in apart[3] if g == "all"] == sorted(n for n in nodes if len(under[n]) == 1)


@pytest.mark.parametrize("hot", [1, 100_000])
def test_components_by_merging(spark, monkeypatch, hot):
    """A chain, a star, rings, parallel links, loops, lone nodes and links to strangers: each node's component is its least node, however few rows of a key may meet."""
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(8)
    links = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 40)] + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    links += [("p1", "p2"), ("p2", "p1"), ("p1", "p1"), ("x1", "stranger"), ("x2", "stranger"), ("x2", "x3"), ("c3", None)]
    links += [(f"m{rng.randrange(90)}", f"m{rng.randrange(90)}") for _ in range(70)]
    nodes = {n for link in links for n in link} - {"stranger", None} | {f"m{i}" for i in range(90)} | {"alone"}
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            if a in nodes and b in nodes:
                label[a] = label[b] = min(label[a], label[b])
    v = spark.createDataFrame([(n,) for n in nodes], "asset_id string")
    e = spark.createDataFrame([(str(i), *link) for i, link in enumerate(links)], "asset_id string, start string, end string")
    assert {tuple(r) for r in graph.components(e, v).collect()} == set(label.items())
    assert tuple(graph.topology_summary(v, e).first()) == (len(nodes), len(set(label.values())), len(links), False)
    # what hangs on one node goes in the first round; a link of two nodes may be left
    counts = [s.count() for s in graph._merges(e.where("start = 's0'"), v)]
    assert counts[0] == 40 and counts[2:] in ([], [2, 0])
    assert graph.components(e.limit(0), v).where("component <> asset_id").isEmpty()
