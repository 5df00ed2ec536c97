import heapq
import random

import pytest

from urban_spark.operators import routes


def dijkstra(edges, source):
    around, best, heap = {}, {}, [(0.0, source)]
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = d
        for u, w in around.get(v, ()):
            if u not in best:
                heapq.heappush(heap, (d + w, u))
    return best


def found(spark, edges, sources, targets, **options):
    index = routes.route_index(spark.createDataFrame(edges, "src long, dst long, weight double"), **options)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    return {(r.source, r.target): r.distance for r in routes.distances(index, ids(sources), ids(targets)).collect()}, index


def same(got, edges, sources, targets):
    want = {(s, t): d for s in sources for t, d in dijkstra(edges, s).items() if t in set(targets)}
    want |= {(s, s): 0.0 for s in set(sources) & set(targets)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def grid(deal, side, one_way=0.1):
    out = []
    for x in range(side):
        for y in range(side):
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < side and v < side and deal.random() < 0.9:
                    a, b, w = x * side + y, u * side + v, deal.choice([1.0, 1.0, 2.5, 7.25])
                    out += [(a, b, w)] if deal.random() < one_way else [(a, b, w), (b, a, w)]
    return out


def test_grid_with_one_way_streets(spark):
    deal = random.Random(3)
    edges = grid(deal, 14) + [(5, 5, 1.0), (0, 1, 99.0), (1000, 1001, 2.0)]
    sources, targets = [0, 17, 1000, 5555], [*range(0, 196, 7), 0, 1001, 5555]
    got, index = found(spark, edges, sources, targets)
    same(got, edges, sources, targets)
    assert 0 < index.rounds < 16


def test_long_road_takes_few_rounds(spark):
    edges = [e for i in range(400) for e in ((i, i + 1, 1.0), (i + 1, i, 1.0))]
    got, index = found(spark, edges, [0, 200], [399, 7], core=8)
    assert got == {(0, 399): 399.0, (0, 7): 7.0, (200, 399): 199.0, (200, 7): 193.0} and index.rounds <= 16


def test_dense_graph_is_core(spark):
    deal = random.Random(1)
    edges = [(a, b, deal.random()) for a in range(30) for b in range(30) if a != b]
    got, index = found(spark, edges, range(30), range(30), core=4, growth=0.5)
    same(got, edges, range(30), range(30))
    assert index.rounds == 0


def test_bad_weights_and_empty(spark):
    with pytest.raises(ValueError):
        found(spark, [(1, 2, -1.0)], [1], [2])
    assert found(spark, [], [1], [1, 2])[0] == {(1, 1): 0.0}


def test_layers_transfers_and_fallback(spark):
    line = lambda *rows: spark.createDataFrame(rows, "src long, dst long, km double")
    transfers = spark.createDataFrame([("metro:1", "road:1", 3.0), ("metro:2", "road:4", 3.0)], "src string, dst string, minutes double")
    edges = routes.multimodal_graph({"road": (line((1, 2, 10.0), (2, 1, 5.0), (2, 3, 10.0), (3, 4, 10.0), (4, 4, 1.0), (1, 9, 0.0)), 30.0), "metro": (line((1, 2, 20.0)), 60.0)}, transfers)
    rows = {(r.src, r.dst): (r.minutes, r.mode) for r in edges.collect()}
    assert rows[("road:1", "road:2")] == (10.0, "road") and rows[("metro:1", "metro:2")] == (20.0, "metro") and rows[("metro:1", "road:1")] == (3.0, "transfer") and len(rows) == 6
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 0.0, 1.0)], "ward string, lon double, lat double")
    snapped = spark.createDataFrame([("a", "road:1"), ("b", "road:4")], "ward string, node string")
    got = {(r.src, r.dst): r.minutes for r in routes.travel_matrix(edges, places, snapped, key="ward").collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(26.0) and got[("a", "a")] == got[("c", "c")] == 0.0
    assert got[("a", "c")] == pytest.approx(222.0) and len(got) == 9


def sums(spark, edges, sources, kind="long", **options):
    index = routes.route_index(spark.createDataFrame(edges, f"src {kind}, dst {kind}, weight double"), **options)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], f"id {kind}")
    got = {r.id: (r.n, r.total) for r in routes.distance_sums(index, ids(sources), ids({b for _, b, _ in edges})).collect() if r.n}
    far = [(t, d) for s in sources for t, d in dijkstra(edges, s).items() if d > 0]
    want = {t: (sum(x == t for x, _ in far), sum(d for x, d in far if x == t)) for t in {t for t, _ in far}}
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    return index


def test_sums_of_distances_from_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(routes, "BLOCK", 30)  # several blocks and parts of them
    monkeypatch.setattr(routes, "CHUNK", 7)
    edges = grid(random.Random(6), 9) + [(5, 5, 1.0), (3, 4, 0.0), (1000, 1001, 2.0)]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {7777})
    index = sums(spark, edges, nodes, core=20)
    assert index.bounded and index.rounds > 0
    sums(spark, [(f"n{a}", f"n{b}", w) for a, b, w in edges if a < 40 or a > 100], [f"n{i}" for i in nodes[:30]], "string", core=6)
    deal = random.Random(1)
    assert not sums(spark, [(a, b, deal.random()) for a in range(12) for b in range(12) if a != b], range(12), core=4, growth=0.5).bounded


def test_closeness_query_takes_all_sites(spark):
    from urban_spark.plans import QUERIES
    from urban_spark.plans.base import Tables
    from urban_spark.plans.networks import _roads

    folder = "/root/testdata/sf0.01"
    t = Tables(spark, folder)
    edges, sites = [tuple(r) for r in _roads(t).collect()], [r.site for r in t.sites.collect()]
    far = {}
    for s in sites:
        for v, d in dijkstra(edges, s).items():
            if d > 0:
                far.setdefault(v, []).append(d)
    mean = {v: len(x) / sum(x) for v, x in far.items()}
    low, high = min(mean.values()), max(mean.values())
    got = {r.id: r.closeness for r in QUERIES["n8_closeness"](spark, folder).collect()}
    assert len(sites) > 50 and got.keys() == mean.keys() and all(got[v] == pytest.approx((x - low) / (high - low), abs=1e-6) for v, x in mean.items())
