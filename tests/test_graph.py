import heapq
import random
from collections import deque

import numpy as np
import pytest

from urban_spark.operators import condense
from urban_spark.operators import graph as g


@pytest.fixture(scope="module")
def net(spark):
    rnd = random.Random(6)
    edges = sorted({(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(45)) if a != b})
    rows = [(a, b, float(rnd.randint(1, 9))) for a, b in edges]
    return spark.createDataFrame([(i,) for i in range(34)], "id int"), spark.createDataFrame(rows, "src int, dst int, weight double"), rows


def test_components_and_degrees(net):
    nodes, edges, rows = net
    label = list(range(34))
    for _ in range(34):
        for a, b, _w in rows:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in g.components(nodes, edges).collect()} == dict(enumerate(label))
    near = {i: {b for a, b, _ in rows if a == i} | {a for a, b, _ in rows if b == i} for i in range(34)}
    assert {r.id: r.degree for r in g.degrees(nodes, edges).collect()} == {i: len(v) for i, v in near.items()}


def test_shortest_paths(net):
    nodes, edges, rows = net
    got = {(r.source, r.id): r.distance for r in g.shortest_paths(edges, nodes.where("id < 3")).collect()}
    for s in range(3):
        best, queue = {s: 0.0}, [(0.0, s)]
        while queue:
            d, a = heapq.heappop(queue)
            for x, b, w in rows:
                if x == a and d + w < best.get(b, 1e9):
                    best[b] = d + w
                    heapq.heappush(queue, (d + w, b))
        assert {k: v for (q, k), v in got.items() if q == s} == best


def test_pagerank_sums_to_one(net):
    nodes, edges, rows = net
    out = {r.id: r.rank for r in g.pagerank(nodes, edges, rounds=8).collect()}
    m = np.zeros((34, 34))
    for a, b, _ in rows:
        m[b, a] = 1
    out_degree = m.sum(0)
    rank = np.full(34, 1 / 34)
    for _ in range(8):
        rank = 0.15 / 34 + 0.85 * ((m / np.maximum(out_degree, 1)) @ rank + rank[out_degree == 0].sum() / 34)
    assert np.isclose(sum(out.values()), 1) and np.allclose([out[i] for i in range(34)], rank)


def test_betweenness(net):
    nodes, edges, rows = net
    near = {i: sorted({b for a, b, _ in rows if a == i} | {a for a, b, _ in rows if b == i}) for i in range(34)}
    want = dict.fromkeys(range(34), 0.0)
    for s in range(4):
        level, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            a = queue.popleft()
            order.append(a)
            for b in near[a]:
                if b not in level:
                    level[b], paths[b] = level[a] + 1, 0.0
                    queue.append(b)
                if level[b] == level[a] + 1:
                    paths[b] += paths[a]
        delta = dict.fromkeys(order, 0.0)
        for b in reversed(order):
            for a in near[b]:
                if level.get(a) == level[b] - 1:
                    delta[a] += paths[a] / paths[b] * (1 + delta[b])
        for i, v in delta.items():
            want[i] += v * (i != s)
    got = {r.id: r.betweenness for r in g.betweenness(nodes, edges, nodes.where("id < 4")).collect()}
    assert np.allclose([got[i] for i in range(34)], [want[i] for i in range(34)])


def test_spectral_radius_and_weights(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 0, 0.5), (0, 2, 0.25)], "src int, dst int, weight double")
    m = np.zeros((3, 3))
    for a, b, w in [(0, 1, 0.5), (1, 2, 0.5), (2, 0, 0.5), (0, 2, 0.25)]:
        m[b, a] = w
    assert abs(g.spectral_radius(edges, rounds=24) - max(abs(np.linalg.eigvals(m)))) < 0.01
    signed = spark.createDataFrame([("a", "x", 1.0), ("b", "x", -3.0), ("a", "y", 0.0)], "src string, dst string, weight double")
    assert {(r.src, r.dst): r.weight for r in g.normalized_weights(signed).collect()} == {("a", "x"): 0.25, ("b", "x"): -0.75, ("a", "y"): 0.0}


def test_property_graph_and_chains(spark):
    wards = spark.createDataFrame([(1, "A", 10), (2, "B", 10)], "ward int, name string, sector int")
    nodes, edges = g.property_graph({"Ward": (wards, "ward"), "Sector": (wards.select("sector").distinct(), "sector")}, {"IN": (wards.select("ward", "sector"), "ward", "sector")})
    assert {(r.id, r.label, r.props_json) for r in nodes.collect()} == {("1", "Ward", '{"name":"A","sector":10}'), ("2", "Ward", '{"name":"B","sector":10}'), ("10", "Sector", "{}")}
    assert edges.count() == 2
    chains = spark.createDataFrame([("a > b > c", 2), ("a > c", 1), ("z", 5)], "c string, w int")
    assert {(r.src, r.dst): (r.n, round(r.share, 3)) for r in g.chain_transitions(chains, "c", "w").collect()} == {("a", "b"): (2, 0.667), ("b", "c"): (2, 1.0), ("a", "c"): (1, 0.333)}


def brandes(rows, nodes, sources):
    """Betweenness of nodes and undirected edges by weight, from some sources."""
    near = {i: {} for i in nodes}
    for a, b, w in rows:
        near[a][b] = near[b][a] = min(w, near[a].get(b, w))
    through, over = dict.fromkeys(nodes, 0.0), {(min(a, b), max(a, b)): 0.0 for a, b, _ in rows}
    for s in sources:
        far, queue, order = {s: 0.0}, [(0.0, s)], []
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a] or a in order:
                continue
            order.append(a)
            for b, w in near[a].items():
                if d + w < far.get(b, 1e18):
                    far[b] = d + w
                    heapq.heappush(queue, (d + w, b))
        paths = {s: 1.0}
        for b in order[1:]:
            paths[b] = sum(paths[a] for a, w in near[b].items() if far[a] + w == far[b])
        delta = dict.fromkeys(order, 0.0)
        for b in reversed(order):
            for a, w in near[b].items():
                if far[a] + w == far[b]:
                    part = paths[a] / paths[b] * (1 + delta[b])
                    delta[a] += part
                    over[min(a, b), max(a, b)] += part
        for i, v in delta.items():
            through[i] += v * (i != s)
    return through, over


def test_weighted_betweenness_of_nodes_and_edges(net):
    nodes, edges, rows = net
    through, over = brandes(rows, range(34), range(4))
    got = {r.id: r.betweenness for r in g.betweenness(nodes, edges, nodes.where("id < 4"), weight="weight").collect()}
    assert np.allclose([got[i] for i in range(34)], [through[i] for i in range(34)])
    got = {(r.src, r.dst): r.betweenness for r in g.edge_betweenness(edges, nodes.where("id < 4"), weight="weight").collect()}
    assert set(got) == set(over) and np.allclose([got[k] for k in over], [over[k] for k in over])


def test_betweenness_goes_to_the_end_of_long_paths(spark):
    nodes, edges = spark.range(66).select("id"), spark.range(65).selectExpr("id AS src", "id + 1 AS dst")
    got = {r.id: r.betweenness for r in g.betweenness(nodes, edges, nodes.where("id = 0")).collect()}
    assert got == {i: float(65 - i) if i else 0.0 for i in range(66)}
    with pytest.raises(RuntimeError):
        g.betweenness(nodes, edges, nodes.where("id = 0"), 5).collect()


def test_rank_and_radius_settle_or_fail(net, spark):
    nodes, edges, rows = net
    got = {r.id: r.rank for r in g.pagerank(nodes, edges, damping=0.5, rounds=100, tolerance=1e-7).collect()}
    m = np.zeros((34, 34))
    for a, b, _ in rows:
        m[b, a] = 1
    m = np.where(m.sum(0) > 0, m / np.maximum(m.sum(0), 1), 1 / 34)
    assert np.allclose([got[i] for i in range(34)], np.linalg.solve(np.eye(34) - 0.5 * m, np.full(34, 0.5 / 34)), atol=1e-6, rtol=0)
    with pytest.raises(RuntimeError):
        g.pagerank(nodes, edges, rounds=4, tolerance=1e-15)
    m = [(0, 0, 0.5), (0, 1, 0.5), (1, 2, 0.5), (2, 0, 0.5), (0, 2, 0.25)]
    dense = np.zeros((3, 3))
    for a, b, w in m:
        dense[b, a] = w
    flow = spark.createDataFrame(m, "src int, dst int, weight double")
    assert abs(g.spectral_radius(flow, 200, tolerance=1e-6) - max(abs(np.linalg.eigvals(dense)))) < 1e-5
    with pytest.raises(RuntimeError):
        g.spectral_radius(flow, 6, tolerance=1e-12)


def test_condensed_paths_are_those_of_brandes(spark):
    """A grid with many equally long ways, most nodes of which are taken out in rounds, and a part that no source reaches."""
    rnd, side, weights = random.Random(4), 7, (1.0, 2.0, 7.0)
    rows = [(x * side + y, u * side + v, rnd.choice(weights)) for x in range(side) for y in range(side) for u, v in ((x + 1, y), (x, y + 1)) if u < side and v < side and rnd.random() < 0.9]
    rows += [(900, 901, 1.0)]
    ids, chosen = [*range(side * side), 900, 901, 902], [0, 10, 48]
    through, over = brandes(rows, ids, chosen)
    edges, sources = spark.createDataFrame(rows, "src long, dst long, weight double"), spark.createDataFrame([(i,) for i in chosen], "id long")
    around = g.undirected(edges)
    c = condense.condense(condense.evened(around), sources, core=30)
    assert c.made
    core = condense._core(c)
    found, parts = condense.settled(c, core)
    flow = {(r.src, r.dst): r.flow for r in condense.flows(c, core, parts).collect()}
    assert all(flow.get((a, b), 0.0) + flow.get((b, a), 0.0) == pytest.approx(v, abs=1e-6) for (a, b), v in over.items())
    reached = {r.id: r.n for r in condense.reach(found).collect()}
    assert all(sum(f for (_, b), f in flow.items() if b == i) - reached.get(i, 0) == pytest.approx(through[i], abs=1e-6) for i in ids)


def test_condensed_closeness_goes_one_way(net):
    nodes, edges, rows = net
    some = nodes.where("id < 4")
    want = {r.id: r.closeness for r in g.closeness(g.shortest_paths(edges, some)).collect()}
    got = {r.id: r.closeness for r in g.closeness_from(edges, some, core=20).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
