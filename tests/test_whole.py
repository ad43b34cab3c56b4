"""Queries that must cover their whole tables."""

from rillflow.plans import fixtures as fx
from rillflow.plans import registry

D = "/root/testdata/sf0.001"


def test_graph_queries_cover_every_order_line(spark):
    lines = spark.read.parquet(f"{D}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity").collect()
    nodes = {f"P{r.l_partkey}" for r in lines} | {f"S{r.l_suppkey}" for r in lines}
    assert tuple(registry.QUERIES["topology_counts"](spark, D).first()) == (len(nodes), len(lines))
    assert registry.QUERIES["flow_orientation"](spark, D).count() == len(lines)
    near, arcs = {}, {}
    for r in lines:
        a, b = f"P{r.l_partkey}", f"S{r.l_suppkey}"
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        start, end = (a, b) if r.l_quantity >= 25 else (b, a)
        arcs.setdefault(start, set()).add(end)

    def walk(graph, seed, most):
        hops, level = {seed: 0}, {seed}
        for n in range(1, most + 1):
            level = {y for x in level for y in graph.get(x, ())} - hops.keys()
            hops |= dict.fromkeys(level, n)
        return {(seed, x, n) for x, n in hops.items() if n}

    first = f"P{min(r.l_partkey for r in lines)}"
    assert {tuple(r) for r in registry.QUERIES["khop_neighbours"](spark, D).collect()} == walk(near, first, 3)
    want = set().union(*(walk(arcs, seed, 4) for seed in arcs))
    assert {tuple(r) for r in registry.QUERIES["flow_reachability"](spark, D).collect()} == want


def test_tree_queries_cover_every_order(spark):
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{D}/orders.parquet").collect()}
    nation = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{D}/customer.parquet").collect()}
    region = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{D}/nation.parquet").collect()}
    ways = {f"O{o}": [f"O{o}", f"C{c}", f"N{nation[c]}", f"R{region[nation[c]]}", "WORLD"] for o, c in orders.items()}
    got = {r.node: (r.path, r.depth) for r in registry.QUERIES["upstream_path"](spark, D).collect()}
    assert got == {o: (">".join(way), 4) for o, way in ways.items()}
    groups = {}
    for o in orders:
        groups.setdefault(f"g{o % 400}", []).append(ways[f"O{o}"])
    want = {g: next(x for x in all_ways[0] if all(x in way for way in all_ways)) for g, all_ways in groups.items()}
    assert {r.grp: r.common for r in registry.QUERIES["common_supply_point"](spark, D).collect()} == want
    fed = {r.object for r in registry.QUERIES["triples_export"](spark, D).where("relation = 'FEEDS'").collect()}
    assert set(ways) <= fed


def test_the_last_prefix_knows_every_reading(spark):
    want = {r.scenario: r["count"] for r in fx.observed(spark, D).groupBy("scenario").count().collect()}
    got = {}
    for r in registry.QUERIES["live_prefix"](spark, D).collect():
        got[r.scenario] = max(got.get(r.scenario, 0), r.known)
    assert got == want
