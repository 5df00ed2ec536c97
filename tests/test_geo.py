import math
import random

from pyspark.sql import functions as F

from urban_spark.functions import geo as g
from urban_spark.operators import spatial as s

POLY = "key string, rings array<array<struct<x double, y double>>>"


def ring(*points):
    return [tuple(map(float, p)) for p in points]


L_SHAPE = [ring((0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10))]
HOLED = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (4, 2), (4, 4), (2, 4))]
TWO = [ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((20, 20), (21, 20), (21, 21), (20, 21))]


def test_measures(spark):
    df = spark.createDataFrame([("L", L_SHAPE), ("hole", HOLED)], POLY)
    out = {r.key: r for r in df.select("key", g.polygon_area(F.col("rings")).alias("area"), g.ring_centroid(F.col("rings")[0]).alias("c"), g.bounds(F.col("rings")).alias("b")).collect()}
    assert out["L"].area == 75 and out["hole"].area == 96 and tuple(out["hole"].c) == (5, 5) and tuple(out["L"].b) == (0, 0, 10, 10)
    assert abs(out["L"].c.x - (50 * 5 + 25 * 2.5) / 75) < 1e-9
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 4), (3, 5))))
    assert spark.range(1).select(g.line_length(line), F.size(g.segments(line))).collect()[0][:] == (6.0, 2)


def test_containment_is_half_open(spark):
    df = spark.createDataFrame([("L", L_SHAPE), ("hole", HOLED), ("two", TWO)], POLY)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 3), (7, 7), (3, 3), (1, 9), (20.5, 20.5), (0.5, 0.5)])], "point_id int, lon double, lat double")
    got = {(r.point_id, r.key) for r in s.points_in_polygons(points, df, size=2.5).collect()}
    assert got == {(0, "L"), (3, "L"), (4, "L"), (6, "L"), (0, "hole"), (2, "hole"), (4, "hole"), (6, "hole"), (0, "two"), (5, "two"), (6, "two")}
    left = s.points_in_polygons(points, df.where("key = 'two'"), how="left", size=2.5)
    assert {(r.point_id, r.key) for r in left.collect()} == {(i, "two" if i in (0, 5, 6) else None) for i in range(7)}


def test_clean_ring(spark):
    df = spark.createDataFrame([("x", [ring((0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, 0))])], POLY)
    assert [tuple(v) for v in df.select(g.clean_ring(F.col("rings")[0])).collect()[0][0]] == [(1, 0), (1, 1), (0, 1), (0, 0)]


def test_cells_hold_their_points(spark):
    rnd = random.Random(2)
    points = spark.createDataFrame([(77 + rnd.random(), 12 + rnd.random()) for _ in range(300)], "lon double, lat double").withColumn("cell", g.cell_id(F.col("lon"), F.col("lat"), 900))
    c = g.cell_center(F.col("cell"), 900)
    d = F.sqrt(F.pow(g.mercator_x(c["lon"]) - g.mercator_x(F.col("lon")), 2) + F.pow(g.mercator_y(c["lat"]) - g.mercator_y(F.col("lat")), 2))
    rows = points.select(d.alias("d"), F.size(g.cell_ring(F.col("cell"), 2)).alias("ring"), g.contains(F.array(g.cell_boundary(F.col("cell"), 900)), F.col("lon"), F.col("lat")).alias("inside"), (g.cell_id(c["lon"], c["lat"], 900) == F.col("cell")).alias("same")).collect()
    assert all(r.d <= 900.001 and r.ring == 19 and r.same for r in rows)
    assert sum(r.inside for r in rows) >= 297  # edges are straight in metres, not in degrees


def test_nearest_in_growing_cells(spark):
    rnd = random.Random(4)
    a = [(i, 77 + rnd.random() * 3, 12 + rnd.random() * 3) for i in range(60)] + [(99, 10.0, -40.0)]
    b = [(i, 77 + rnd.random(), 12 + rnd.random()) for i in range(40)]
    out = {r.k: r for r in s.nearest(spark.createDataFrame(a, "k int, lon double, lat double"), spark.createDataFrame(b, "t int, lon double, lat double"), key="k", target="t", broadcast_rows=5).collect()}

    def km(x1, y1, x2, y2):
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    for k, x, y in a:
        best = min((km(x, y, u, v), t) for t, u, v in b)
        assert out[k].t == best[1] and abs(out[k].km - best[0]) < 1e-6


def test_contiguity_and_assignment(spark):
    square = lambda x, y, n=1: [ring((x, y), (x + n, y), (x + n, y + n), (x, y + n))]
    df = spark.createDataFrame([("a", square(0, 0)), ("b", square(1, 0)), ("c", square(2, 1)), ("d", square(9, 9))], POLY)
    assert {tuple(r) for r in s.queen_neighbours(df, key="key").collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    large = spark.createDataFrame([("west", square(-1, -1, 2.75)), ("east", square(1.75, -1, 3))], "zone string, " + POLY.partition(", ")[2])
    out = {r.key: (r.zone, r.method) for r in s.assign_polygons(df, large, key="key", to="zone", step=0.05).collect()}
    assert out == {"a": ("west", "within"), "b": ("west", "overlap"), "c": ("east", "overlap") if out["c"][1] == "overlap" else ("east", "within"), "d": ("east", "nearest")}


def test_repair_contiguity(spark):
    areas = spark.createDataFrame([(i, z) for i, z in enumerate("AAABAABBBB")], "id int, zone string")
    edges = spark.createDataFrame([(i, j) for i in range(10) for j in range(10) if abs(i - j) == 1], "src int, dst int")
    out = "".join(r.zone for r in s.repair_contiguity(areas, edges).orderBy("id").collect())
    assert out in ("AAAAAABBBB", "AAABBBBBBB", "AAAABBBBBB", "AAAAABBBBB")


def test_segment_graph_snaps(spark):
    line = "l array<struct<x double, y double>>"
    df = spark.createDataFrame([(ring((0, 0), (1, 0), (2, 0)),), (ring((2.01, 0.01), (2, 3), (2, 3)),), (ring((1, 0), (0, 0.02)),)], line)
    nodes, edges = s.segment_graph(df, "l", 0.1)
    assert nodes.count() == 4 and edges.count() == 3


def test_wkb(spark):
    import struct

    from urban_spark.functions import geometry_text as gt

    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    flat = [v for p in ring for v in p]
    polygon = lambda sign: struct.pack(f"{sign}BIII8d", sign == "<", 3, 1, 4, *flat)
    rows = {
        1: polygon("<"), 2: polygon(">"), 3: struct.pack("<BII", 1, 6, 2) + polygon("<") + polygon(">"), 4: struct.pack("<BII3d", 1, 0x20000001 | 0x80000000, 4326, 7.0, 8.0, 9.0), 5: struct.pack("<BI3d", 1, 1001, 7.0, 8.0, 9.0),
        6: b"\x01\x02", 7: None, 8: struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1), 9: b"",
    }
    out = {r.k: (r.type, r.rings) for r in spark.createDataFrame([(k, v) for k, v in rows.items()], "k int, g binary").select("k", gt.decode_wkb("g").alias("s")).select("k", "s.*").collect()}
    plain = lambda rings: [[(v.x, v.y) for v in r] for r in rings]
    assert [(out[k][0], plain(out[k][1])) for k in (1, 2, 3)] == [("Polygon", [ring]), ("Polygon", [ring]), ("MultiPolygon", [ring, ring])]
    assert [(out[k][0], plain(out[k][1])) for k in (4, 5)] == [("Point", [[(7.0, 8.0)]])] * 2 and out[8][0] == "LineString"
    assert out[6] == out[7] == out[9] == (None, None)


def test_nearest_far_outside_and_in_clumps(spark):
    import random

    rnd = random.Random(3)
    targets = [(i, 77 + rnd.gauss(0, 0.001), 12 + rnd.gauss(0, 0.001)) for i in range(60)] + [(100 + i, 79 + rnd.random(), 14 + rnd.random()) for i in range(20)]
    points = [(i, rnd.uniform(70, 85), rnd.uniform(5, 20)) for i in range(80)] + [(200 + i, 77 + rnd.gauss(0, 0.002), 12.0) for i in range(20)]
    out = {r.k: (r.t, r.km) for r in s.nearest(spark.createDataFrame(points, "k int, lon double, lat double"), spark.createDataFrame(targets, "t int, lon double, lat double"), key="k", target="t", broadcast_rows=3).collect()}
    near = {r.k: r for r in s.nearest(spark.createDataFrame(points, "k int, lon double, lat double"), spark.createDataFrame(targets, "t int, lon double, lat double"), key="k", target="t").collect()}
    assert len(out) == 100 and all(out[k] == (near[k].t, near[k].km) for k in near)
