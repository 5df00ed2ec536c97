import math
import random

import pytest
from pyspark.sql import functions as F

from urban_spark.operators import spatial as s

POLYGON = "{k} string, rings array<array<struct<x: double, y: double>>>"


def polygons(spark, shapes, key):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes.items()], POLYGON.format(k=key))


def square(x, y, half):
    return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]


ELL = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]


def test_boxes_that_meet_are_not_enough(spark):
    a = {"ell": [ELL], "frame": [square(20, 20, 5), square(20, 20, 4)], "far": [square(50, 50, 1)], "big": [square(80, 80, 9)]}
    b = {
        "in the notch": [square(2.5, 2.5, 1)], "on the arm": [square(3.5, 0.5, 0.2)], "touches a corner": [[(4, 1), (6, 1), (6, 3)]], "touches an edge": [[(-2, 2), (0, 1), (0, 3)]],
        "in the hole": [square(20, 20, 2)], "over the hole": [square(20, 20, 4.5)], "around": [square(20, 20, 9)], "fills the hole": [square(20, 20, 4)], "inside": [square(80, 80, 1)],
        "two parts": [square(60, 0, 1), square(80, 80, 2)], "slanted": [[(3, 6), (6, 3), (6.1, 3.1)]],
    }
    for size in (0.7, 3.0, 100.0):
        got = {(r.a, r.b) for r in s.polygons_meet(polygons(spark, a, "a"), polygons(spark, b, "b"), key="a", to="b", size=size).collect()}
        assert got == {
            ("ell", "on the arm"), ("ell", "touches a corner"), ("ell", "touches an edge"), ("frame", "over the hole"), ("frame", "around"), ("frame", "fills the hole"), ("big", "inside"), ("big", "two parts"),
        }


def meet(p, q):
    def segments(ring):
        return list(zip(ring, ring[1:] + ring[:1], strict=True))

    def turn(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    def cross(a, b, c, d):
        boxes = all(max(a[i], b[i]) >= min(c[i], d[i]) and max(c[i], d[i]) >= min(a[i], b[i]) for i in (0, 1))
        return boxes and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0

    def holds(ring, v):
        inside = False
        for (x1, y1), (x2, y2) in segments(ring):
            if (y1 > v[1]) != (y2 > v[1]) and v[0] < x1 + (v[1] - y1) / (y2 - y1) * (x2 - x1):
                inside = not inside
        return inside

    return any(cross(*e, *f) for e in segments(p) for f in segments(q)) or holds(p, q[0]) or holds(q, p[0])


def test_random_stars_as_brute_force(spark):
    deal = random.Random(6)

    def star():
        x, y, n = deal.uniform(0, 10), deal.uniform(0, 10), deal.randint(3, 9)
        return [(x + math.cos(2 * math.pi * i / n) * (r := deal.uniform(0.1, 1.5)), y + math.sin(2 * math.pi * i / n) * r) for i in range(n)]

    a, b = {str(i): [star()] for i in range(60)}, {str(i): [star()] for i in range(60)}
    want = {(i, j) for i in a for j in b if meet(a[i][0], b[j][0])}
    for size in (0.3, 2.0):
        got = {(r.a, r.b) for r in s.polygons_meet(polygons(spark, a, "a"), polygons(spark, b, "b"), key="a", to="b", size=size).collect()}
        assert got == want and len(want) > 50


def test_fallbacks(spark):
    # The centroid of a U lies outside of it, in the zone between its arms.
    a = {"u": [[(0, 0), (6, 0), (6, 9), (5.5, 9), (5.5, 0.5), (0.5, 0.5), (0.5, 9), (0, 9)]], "lost": [square(30, 30, 1)], "in": [square(3, 2.5, 0.1)]}
    b = {"between": [square(3, 4, 2)], "other": [square(60, 60, 1)]}
    table = polygons(spark, a, "ward"), polygons(spark, b, "zone")
    got = {(r.ward, r.zone, r.method) for r in s.join_meeting(*table, key="ward", to="zone").collect()}
    assert got == {("u", "between", "centroid"), ("lost", "UNMAPPED", "UNMAPPED"), ("in", "between", "intersects")}
    got = {(r.ward, r.zone, r.method) for r in s.join_meeting(*table, key="ward", to="zone", nearest_left=True).collect()}
    assert ("lost", "other", "nearest") in got and len(got) == 3
    empty = polygons(spark, {}, "zone")
    assert {r.method for r in s.join_meeting(table[0], empty, key="ward", to="zone").collect()} == {"UNMAPPED"}


def km(p, q):
    x1, y1, x2, y2 = map(math.radians, (*p, *q))
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))


@pytest.mark.parametrize(("k", "clumped"), [(1, False), (3, True), (5, True), (200, False)])
def test_nearest_pairs_as_brute_force(spark, k, clumped):
    deal = random.Random(k)
    points = [(deal.uniform(70, 80), deal.uniform(10, 20)) for _ in range(120)]
    if clumped:  # a third in one spot, some at one place, two far off
        points += [(75 + deal.gauss(0, 1e-4), 15 + deal.gauss(0, 1e-4)) for _ in range(100)] + [(71.5, 11.5)] * 30 + [(-120.0, 60.0), (-119.0, 61.0)]
    rows = list(enumerate(points))
    out = {}
    for r in s.nearest_pairs(spark.createDataFrame([(i, *p) for i, p in rows], "site int, lon double, lat double"), k, key="site").collect():
        out.setdefault(r.src, []).append((round(r.km, 9), r.dst))
    for i, p in rows:
        want = sorted((round(km(p, q), 9), j) for j, q in rows if j != i)[:k]
        got = sorted(out[i])
        assert len(got) == min(k, len(rows) - 1)
        assert [d for d, _ in got] == pytest.approx([d for d, _ in want], abs=1e-8)
        if not clumped:
            assert [j for _, j in got] == [j for _, j in want]


def test_nearest_pairs_of_few(spark):
    table = lambda rows: spark.createDataFrame(rows, "site int, lon double, lat double")
    assert s.nearest_pairs(table([]), 3, key="site").collect() == [] and s.nearest_pairs(table([(1, 5.0, 5.0)]), 3, key="site").collect() == []
    same = s.nearest_pairs(table([(i, 5.0, 5.0) for i in range(50)]), 2, key="site")
    assert {(r.src, r.dst) for r in same.where("src IN (0, 1, 40)").collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (40, 0), (40, 1)} and same.agg(F.count("*")).first()[0] == 100


def test_cell_shares_add_up_and_split_cells(spark):
    shapes = {"a": [square(77.50, 12.90, 0.03)], "b": [square(77.56, 12.90, 0.03)], "ell": [[(77.8, 12.9), (77.86, 12.9), (77.86, 12.91), (77.81, 12.91), (77.81, 12.96), (77.8, 12.96)]]}
    rows = s.cell_shares(polygons(spark, shapes, "ward"), key="ward", step=0.002, size=1500).collect()
    total, cells = {}, {}
    for r in rows:
        total[r.ward] = total.get(r.ward, 0.0) + r.share
        cells.setdefault(r.cell, set()).add(r.ward)
    assert total == {k: pytest.approx(1.0) for k in shapes} and any(v == {"a", "b"} for v in cells.values()) and max(r.share for r in rows) < 0.6
