"""What larger tables brought to light: plans that grow, copies at one place, work done again in every round."""

import hashlib

from pyspark.sql import functions as F

from urban_spark.functions import geo as g
from urban_spark.operators import access, cluster, graph, risk, routes, stats
from urban_spark.operators import spatial as s


def test_cell_ring_has_its_cell_once(spark):
    points = spark.createDataFrame([(77.5, 12.9)], "lon double, lat double")
    cell = g.cell_id(F.col("lon"), F.col("lat"), 2000)
    ring = points.select(cell.alias("cell"), g.cell_ring(cell, 2).alias("ring"))
    one = len(points.select(cell.alias("cell"))._jdf.queryExecution().analyzed().toString())
    assert len(ring._jdf.queryExecution().analyzed().toString()) < 4 * one + 4_000
    row = ring.first()
    q, r = map(int, row.cell.split(":"))
    assert sorted(row.ring) == sorted(f"{q + a}:{r + b}" for a in range(-2, 3) for b in range(-2, 3) if abs(a + b) <= 2)


def _crowd(spark, rows: int, places: int):
    k = F.col("id")
    return spark.range(rows).select(k.alias("k"), (77.5 + k % places * 7 % places / 100.0).alias("lon"), (12.9 + k % places * 3 % places / 100.0).alias("lat"))


def test_within_distance_takes_copies_at_one_place_as_lists_and_broadcasts_no_side(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 7)  # lists of several lengths
    rows = _crowd(spark, 200, 9)
    found = s.within_distance(rows, key="k", km=1.5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    a, b = (rows.select(*(F.col(c).alias(f"{c}{i}") for c in rows.columns)) for i in (1, 2))
    d = g.haversine_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    expected = a.crossJoin(b).where("k1 < k2").select("k1", "k2", d.alias("km")).where("km <= 1.5").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected)) and len(expected) > 2_000
    rounded = s.within_distance(rows, key="k", km=1.5, digits=2)
    assert sorted(rounded.select("km").distinct().collect()) == sorted(found.select(F.round("km", 2)).distinct().collect())
    assert s.within_distance(rows.limit(0), key="k", km=1.5).collect() == []


def test_pairs_of_two_lists_that_a_task_holds_at_once_are_few():
    assert s.SLICE**2 <= 4_096  # 65,536 took about three times as long where places are crowded


def test_nearest_looks_once_for_a_place(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "_cut", lambda df, cut=graph._cut: seen.append(cut(df)) or seen[-1])
    targets = _crowd(spark, 300, 10).withColumnRenamed("k", "t")
    points = _crowd(spark, 500, 30)
    found = {r.k: (r.t, r.km) for r in s.nearest(points, targets, key="k", target="t", broadcast_rows=5).collect()}
    assert max(df.count() for df in seen) <= 30
    d = g.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    every = points.crossJoin(targets.select("t", F.col("lon").alias("x"), F.col("lat").alias("y"))).groupBy("k").agg(F.min(F.struct(d.alias("km"), "t")).alias("b"))
    assert found == {r.k: (r.b.t, r.b.km) for r in every.collect()}


def test_neighbours_at_no_distance_have_no_slope(spark):
    edges = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (1, 3, 2.0), (3, 1, 2.0)], "src long, dst long, km double")
    cells = spark.createDataFrame([(1, 10.0), (2, 90.0), (3, 30.0)], "cell long, elevation double")
    assert {r.cell: r.slope for r in risk.slope(edges, cells).collect()} == {1: 0.01, 3: 0.01}


def test_dbscan_pairs_places_not_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cluster, "close_pairs", lambda df, *a, pairs=cluster.close_pairs, **k: seen.append(df.count()) or pairs(df, *a, **k))
    at = [0.0] * 3 + [1.0] * 2 + [1.9] + [9.0] * 2 + [20.0] * 4 + [None] * 5
    rows = spark.createDataFrame([(k, x, 0.0) for k, x in enumerate(at, 1)], "k long, x double, y double")
    found = {r.k: r.label for r in cluster.dbscan(rows, ["x", "y"], key="k", eps=1.0, least=4).collect()}
    assert found == {k: 1 for k in range(1, 7)} | {7: None, 8: None} | {k: 9 for k in range(9, 13)} | {k: None for k in range(13, 18)}
    assert seen == [5]
    assert {r.k: r.label for r in cluster.dbscan(rows, ["x", "y"], key="k", eps=0.1, least=1).collect()} == dict(zip(range(1, 18), [1, 1, 1, 4, 4, 6, 7, 7, 9, 9, 9, 9, 13, 14, 15, 16, 17], strict=True))


def test_only_the_largest_of_a_place_is_paired(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(s, "within_distance", lambda df, *a, pairs=s.within_distance, **k: seen.append(df.count()) or pairs(df, *a, **k))
    rows = _crowd(spark, 60, 9).withColumn("size", F.col("k") * 37 % 11)
    odd = spark.createDataFrame([(100, None, 12.9, 5), (101, 77.5, 12.9, None)], "k long, lon double, lat double, size long")
    kept, places = [], {r.k: r for r in rows.collect()}
    far = {(r.src, r.dst) for r in s.within_distance(rows, key="k", km=2.0).collect()}
    for k in sorted(places, key=lambda k: (-places[k]["size"], k)):
        if not any((min(k, o), max(k, o)) in far for o in kept):
            kept.append(k)
    seen.clear()
    found = access.suppress_near(rows.unionByName(odd), key="k", size="size", km=2.0)
    assert sorted(r.k for r in found.collect()) == sorted([*kept, 100, 101])
    assert seen == [9]


def test_permuted_effect_counts_rows_without_a_stratum(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("t"), F.lit(None).cast("long").alias("g"), (F.col("id") * 7 % 5).cast("double").alias("y"))
    order = lambda run: F.md5(F.concat_ws("-", F.col("k").cast("string"), run.cast("string")).cast("binary"))
    got = stats.permuted_att(rows, "y", treated="t", stratum="g", key="k", order=order, runs=9).first()
    digest = lambda k, run: hashlib.md5(f"{k}-{run}".encode()).hexdigest()
    treated = [{k for k in range(40) if k % 3 == 0}] + [set(sorted(range(40), key=lambda k: (digest(k, run), k))[:14]) for run in range(1, 10)]
    effect = [sum(k * 7 % 5 for k in t) / len(t) - sum(k * 7 % 5 for k in range(40) if k not in t) / (40 - len(t)) for t in treated]
    assert got.runs == 9 and abs(got.att - effect[0]) < 1e-9
    assert got.p == (sum(abs(e) >= abs(effect[0]) for e in effect[1:]) + 1) / 10


def test_spectral_radius_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def weight(k: int) -> float:
        made.add(1)
        return 1.0 + k % 2

    edges = spark.range(6).select(F.col("id").alias("src"), ((F.col("id") + 1) % 6).alias("dst"), F.udf(weight, "double")("id").alias("weight"))
    assert abs(graph.spectral_radius(edges, rounds=24) - 2**0.5) < 1e-6
    assert made.value <= 12  # a checkpoint computes its rows twice


def test_route_index_closes_its_core_as_one_block(spark, monkeypatch):
    monkeypatch.setattr(routes, "shortest_paths", None)  # no rounds over what is left
    edges = spark.createDataFrame([(k, k + 1, 1.0 + k % 3) for k in range(60)] + [(k, k + 7, 8.0) for k in range(50)], "src long, dst long, weight double")
    ends = spark.createDataFrame([(0,), (33,), (99,)], "id long")
    best = {0: 0.0}
    for k in range(1, 61):
        best[k] = min([best[k - 1] + 1.0 + (k - 1) % 3] + ([best[k - 7] + 8.0] if 7 <= k < 57 else []))
    for core in (45, 100):
        found = routes.distances(routes.route_index(edges, core=core), ends.where("id <> 33"), edges.select(F.col("dst").alias("id")).distinct())
        assert {(r.source, r.target): r.distance for r in found.collect()} == {(0, k): v for k, v in best.items() if k}


def test_estimates_of_sizes_do_not_grow_with_rounds(spark):
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    rows = spark.range(20).select(F.col("id").alias("a"), (F.col("id") % 19 + 1).alias("b"))
    for _ in range(4):  # each joins with itself, as ways do in an index
        rows = graph._cut(rows.join(rows.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
    assert rows.count() == 20 and bits(rows) < 20
    road = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "src long, dst long, weight double")
    index = routes.route_index(road, core=8)
    assert index.rounds > 2 and max(bits(df) for df in (index.out, index.into, index.core)) < 20
