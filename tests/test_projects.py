import pytest

from urban_spark.operators import access as q


def test_transit_extensions_by_hand(spark):
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.03, 0.04), (2, 0.3, 0.4), (3, 0.001, 0.0)], "ward int, lon double, lat double")
    times = spark.createDataFrame([(a, b, 0.0 if a == b else 60.0 if {a, b} != {0, 1} else 20.0) for a in range(4) for b in range(4)], "src int, dst int, minutes double")
    people = spark.createDataFrame([(0, 1000), (1, 2000), (2, 500), (3, 800)], "ward int, population int")
    demand = q.gravity_by_time(times, people, key="ward", population="population")
    got = {(r.src, r.dst): r.demand for r in demand.collect()}
    assert got[0, 1] == pytest.approx(1000 * 2000 / 21 * 1e-4) and got[2, 2] == 0.0 and got[3, 1] == pytest.approx(1600000 / 61 * 1e-4)
    rows = q.transit_extensions(demand, places, key="ward", share=1.0).collect()
    # 2 is farther than 15 km from all, 3 nearer than 1 km to 0.
    assert {(r.src, r.dst) for r in rows} == {(0, 1), (1, 3)}
    one = next(r for r in rows if (r.src, r.dst) == (0, 1))
    assert one.km == pytest.approx(5.55) and one.saved_min == pytest.approx(20 - 5.55 / 40 * 60)
    assert one.benefit == pytest.approx(2 * got[0, 1] * 1.2 * one.saved_min * 1000) and one.bc_ratio == pytest.approx(one.benefit / (5.55 * 150e6))
    assert [(r.src, r.dst) for r in q.transit_extensions(demand, places, key="ward", share=0.2).collect()] == [(0, 1)]
    assert [(r.src, r.dst) for r in q.transit_extensions(demand, places, key="ward", share=1.0, most=1).collect()] == [max(rows, key=lambda r: r.bc_ratio)[:2]]


def test_road_upgrades_by_hand(spark):
    edges = spark.createDataFrame([(1, 2, 10.0, 20.0, 2), (30, 20, 4.0, 8.0, 2), (2, 3, 1.0, 1.0, 8), (3, 4, 0.0, 5.0, 2)], "src int, dst int, km double, minutes double, lanes int")
    importance = spark.createDataFrame([(1, 2, 3.0), (20, 30, 6.0), (2, 3, 1.0)], "src int, dst int, betweenness double")
    demand = spark.createDataFrame([(1, 2, 5.0), (6, 7, 7.0), (7, 7, 100.0), (1, 8, 100.0), (30, 20, 2.0), (20, 30, 50.0)], "src int, dst int, demand double")
    got = {(r.src, r.dst): r for r in q.road_upgrades(edges, importance, demand).collect()}
    assert set(got) == {(1, 2), (30, 20), (3, 4)}
    pairs = 5 * 4 / 2
    a = got[1, 2]
    assert (a.importance, a.demand, a.saved_min) == (pytest.approx(3 / pairs), 12.0, pytest.approx(4.0)) and a.benefit == pytest.approx(3 / pairs * 12 * 4 * 1000)
    assert a.cost == 1e8 and a.bc_ratio == pytest.approx(a.benefit / 1e8)
    assert got[30, 20].demand == 2.0 and got[30, 20].importance == pytest.approx(6 / pairs) and got[3, 4].bc_ratio == 0.0 and got[3, 4].importance == 0.0
